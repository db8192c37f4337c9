"""Schemas of the JSON-lines logs and phase outputs, as DDL text.

Keys and session ids are opaque: text unless the caller names another type.
"""

from __future__ import annotations

KEY = "STRING"


def turn_log(key: str = KEY) -> str:
    common = (
        f"pk: {key}, chunk_id: STRING, chunk_content: STRING, sample_id: STRING, counselor_id: STRING, term: STRING, "
        "rating: STRING, span_line_indices: ARRAY<INT>, span_text: STRING"
    )
    result = f"STRUCT<rank: INT, {common}, source_paths: ARRAY<STRING>, scores: MAP<STRING, DOUBLE>>"
    candidate = f"STRUCT<rank_in_path: INT, {common}, score: DOUBLE>"
    return (
        "event STRING, ts STRING, turn INT, timestamp STRING, session_id STRING, scope STRING, query STRING, "
        "config STRUCT<rrf_k: INT, per_path_limit: INT, top_k: INT, active_paths: ARRAY<STRING>>, audit_turn BOOLEAN, "
        f"results ARRAY<{result}>, per_path_candidates MAP<STRING, ARRAY<{candidate}>>, "
        "metrics STRUCT<total: BIGINT, fit_count: BIGINT, not_fit_count: BIGINT, discard_count: BIGINT, "
        "precision_at_k: DOUBLE, seen_set_size: BIGINT>, progress_state STRING, reflection STRUCT<diagnose: STRING>"
    )


# ``turn`` is a number or a phase name.
DETAILS_LOG = (
    "turn STRING, timestamp STRING, session_id STRING, query STRING, "
    "search STRUCT<collection: STRING, embed_url: STRING, embed_model_id: STRING, seen_set_size: BIGINT>, "
    "reflection STRUCT<raw_response: STRING>"
)


def cohort(key: str = KEY, session: str = KEY) -> str:
    return (
        f"session_id {session}, pk {key}, nearest_fit_pk {key}, nearest_fit_label STRING, nearest_fit_distance DOUBLE, "
        f"passed_threshold BOOLEAN, threshold_T_prime DOUBLE, qualifying_fit_count INT, qualifying_fit_pks ARRAY<{key}>"
    )


def rubrics(session: str = KEY) -> str:
    return f"session_id {session}, rubric_version INT, rubric_text STRING"


def verdicts(key: str = KEY, session: str = KEY) -> str:
    return (
        f"session_id {session}, pk {key}, arm STRING, decile INT, nearest_fit_distance DOUBLE, verdict STRING, "
        "evidence_line_indices ARRAY<INT>, failed_check STRING, reason STRING, attempts INT, latency_ms DOUBLE, "
        "error_kind STRING, rubric_version INT, prompt_sha256 STRING"
    )


def labels(key: str = KEY, session: str = KEY) -> str:
    return f"session_id {session}, pk {key}, verdict STRING, p_keep DOUBLE"


def classifier(session: str = KEY) -> str:
    return (
        f"session_id {session}, coef ARRAY<DOUBLE>, intercept DOUBLE, classes ARRAY<INT>, scaler_mean DOUBLE, "
        "scaler_scale DOUBLE, threshold DOUBLE, prompt_sha256 STRING, rubric_version INT, n_train BIGINT, n_keep BIGINT, "
        "n_drop BIGINT"
    )


CLASSIFIER_FIELDS = tuple(field.split()[0] for field in classifier().split(", "))
VERDICT_FIELDS = tuple(field.split()[0] for field in verdicts().split(", "))
