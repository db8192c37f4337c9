"""Validated parameters of the four phases."""

from __future__ import annotations

from dataclasses import dataclass

PATHS = ("dense", "sparse")
RADIUS_SCHEMES = ("per_fit", "decoupled")


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class SearchParams:
    rrf_k: int = 60
    per_path_limit: int = 20
    top_k: int = 10
    min_survivors: int = 5
    active_paths: tuple[str, ...] = PATHS
    min_chunk_chars: int = 50
    max_attempts: int = 3
    candidates_per_path: int = 3

    def __post_init__(self) -> None:
        for name in ("rrf_k", "per_path_limit", "top_k", "min_survivors", "max_attempts", "candidates_per_path"):
            _need(getattr(self, name) >= 1, f"{name} must be positive")
        _need(self.min_survivors <= self.top_k, "min_survivors must not exceed top_k")
        _need(len(self.active_paths) > 0, "active_paths must not be empty")
        _need(len(set(self.active_paths)) == len(self.active_paths), "active_paths must be unique")
        _need(set(self.active_paths) <= set(PATHS), f"active_paths must be among {PATHS}")

    @property
    def max_depth(self) -> int:
        """Per-path depth of the last auto-deepening attempt."""
        return self.per_path_limit * 2 ** (self.max_attempts - 1)


@dataclass(frozen=True)
class HarvestParams:
    min_fit: int = 15
    min_not_fit: int = 3
    precision_at_k: float = 0.8
    max_k: int | None = None  # rows per anchor; none: all
    s2c_outlier_multiple: float = 3.0
    radius_scheme: str = "per_fit"
    anchor_frequency_gate: int = 2
    t_quantile: float = 0.9
    median_floor: float = 0.005
    median_epsilon: float = 1e-3
    survivor_floor: int = 3
    healthy_share: float = 14 / 16
    failed_share: float = 8 / 16

    def __post_init__(self) -> None:
        for name in ("min_fit", "min_not_fit", "anchor_frequency_gate"):
            _need(getattr(self, name) >= 1, f"{name} must be positive")
        _need(self.max_k is None or self.max_k >= 1, "max_k must be positive")
        _need(0.0 <= self.precision_at_k <= 1.0, "precision_at_k must be in [0, 1]")
        _need(self.s2c_outlier_multiple > 1.0, "s2c_outlier_multiple must exceed 1")
        _need(self.radius_scheme in RADIUS_SCHEMES, f"radius_scheme must be among {RADIUS_SCHEMES}")


@dataclass(frozen=True)
class RatingParams:
    """How much of a session is shown again, and how large a change of precision counts as a trend."""

    compress_above: int = 8
    recent_turns: int = 5
    prior_spans: int = 5
    trend_band: float = 0.005


@dataclass(frozen=True)
class RefineParams:
    sample_size: int = 500
    n_bins: int = 10
    seed: int = 0
    max_fit_examples: int = 6
    max_not_fit_examples: int = 6
    auto_drop_known_intruders: bool = True
    max_retries: int = 2

    def __post_init__(self) -> None:
        for name in ("sample_size", "n_bins", "max_fit_examples", "max_not_fit_examples"):
            _need(getattr(self, name) >= 1, f"{name} must be positive")
        _need(self.sample_size % self.n_bins == 0, "sample_size must be divisible by n_bins")

    @property
    def per_bin(self) -> int:
        return self.sample_size // self.n_bins


@dataclass(frozen=True)
class ApplyParams:
    confidence_threshold: float = 0.7
    min_precision: float = 0.75
    n_splits: int = 5
    n_repeats: int = 5
    seed: int = 0
    embedding_dim: int = 1024
    n_bins: int = 10
    band: float = 0.05
    borderline_k: int = 10
    local_rows: int = 5_000  # sessions with more labelled rows are fitted by many tasks together

    def __post_init__(self) -> None:
        _need(0.0 <= self.confidence_threshold <= 1.0, "confidence_threshold must be in [0, 1]")
        _need(0.0 <= self.min_precision <= 1.0, "min_precision must be in [0, 1]")
        _need(self.n_splits >= 2, "n_splits must be at least 2")
        _need(self.n_repeats >= 1, "n_repeats must be at least 1")
        _need(self.embedding_dim >= 1, "embedding_dim must be positive")
        _need(self.local_rows >= 0, "local_rows must not be negative")
