"""Secrets in texts, with multipart credential linking (native expressions only).

Strong finds (assignments with long values, access ids, long hex runs) always count. Weak candidates
(short assigned values, further keywords, user names, endpoints) are reported only when a complementary part lies
in their scope: ``SCOPE`` code points to either side. The link is an interval join: every part is dealt to
the stretches of ``BUCKET`` code points that it reaches, and parts of one text and stretch are compared.
A stretch holds only as many parts as fit into it, so no key is hot, whatever the text.

Defined cases: null text counts as empty and has no spans; repeated rows are scanned each for itself (rows get their
own ids in a written table); empty tables give empty results; columns of the caller are carried in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_measured, packed, save, unpacked
from .spans import Pattern, masked, merged, placed, scanned, summed_up

SCOPE = 200
BUCKET = 400
MASK = "[SECRET]"

_KEYWORDS = "password|passwd|secret|token|api_?key"
_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

BASE = (
    Pattern("assign", f"(?i:({_KEYWORDS}))" + _ASSIGNED, 2, 12, None, ("passw", "secret", "token", "key")),
    Pattern("access", "AKIA[A-Z0-9]+", 0, 18, None, ("akia",)),
    Pattern("hex", "[0-9a-f]{16,}", 0, 16),
)
WEAK = (
    Pattern("short", f"(?i:({_KEYWORDS}))" + _ASSIGNED, 2, 6, 11, ("passw", "secret", "token", "key")),
    Pattern("credential", r"(?i:(pwd|auth|credential|private_?key))" + _ASSIGNED, 2, 6, None, ("pwd", "auth", "credential", "key")),
    Pattern("identifier", r"""(?i:(user(?:_?name)?|login|access_?key_?id|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 4, None, ("user", "login", "key", "client", "account")),
    Pattern("endpoint", r"https?://[A-Za-z0-9._:/?&=%-]+", 0, 12, None, ("http",)),
)
PATTERNS = BASE + WEAK
BASE_KINDS = tuple(p.kind for p in BASE)

#: Role of each kind, and the roles one of which must be near for a weak candidate of that role.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "short": "secret", "credential": "secret", "identifier": "id", "endpoint": "endpoint"}
COMPLEMENTS = {"secret": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}


def _reach(parts: DataFrame, margin: int) -> DataFrame:
    first = F.greatest(F.lit(0), F.floor((F.col("start") - margin) / BUCKET))
    last = F.floor((F.col("end") + margin) / BUCKET)
    return parts.withColumn("bucket_", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def linked(parts: DataFrame) -> DataFrame:
    """Base parts, and the weak ones that have a complementary part in scope."""
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    need = F.create_map(*[x for k, v in COMPLEMENTS.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    parts = parts.withColumn("role_", role[F.col("kind")])
    base = parts.filter(F.col("kind").isin(*BASE_KINDS))
    weak = parts.filter(~F.col("kind").isin(*BASE_KINDS)).withColumn("need_", need[F.col("role_")])
    a, b = _reach(weak, SCOPE).alias("a"), _reach(parts, 0).alias("b")
    near = (
        (F.col("a.rid") == F.col("b.rid"))
        & (F.col("a.bucket_") == F.col("b.bucket_"))
        & F.array_contains(F.col("a.need_"), F.col("b.role_"))
        & (F.col("b.start") < F.col("a.end") + SCOPE)
        & (F.col("b.end") > F.col("a.start") - SCOPE)
        & ((F.col("b.end") <= F.col("a.start")) | (F.col("b.start") >= F.col("a.end")))
    )
    columns = ["rid", "kind", "ord", "start", "end"]
    backed = a.join(b, near, "left_semi").select(*columns).distinct()
    return base.select(*columns).unionByName(backed)


def secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: ``rid`` and ``row_`` with the columns ``keep`` (all by default); spans: rid, kind, ord,
    start, end of every reported span."""
    scan = scanned(packed(docs), F.col("row_").getField(text), PATTERNS)
    if keep is not None:
        scan = scan.withColumn("row_", F.struct(*[F.col("row_").getField(c).alias(c) for c in keep]))
    scan = save(scan.withColumn("rid", F.monotonically_increasing_id()), "secret_scan")
    spans = save(linked(placed(scan, PATTERNS)), "secret_spans")
    return scan.select("rid", "row_"), spans


def report(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: ``keep``, counts per base kind, digest of the base spans, all spans."""
    rows, spans = secrets(docs, text, keep)
    found = broadcast_measured(summed_up(spans, BASE_KINDS))
    return rows.join(found, "rid", "left").select(
        *[F.col("row_").getField(c).alias(c) for c in keep],
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All documents, with every reported span replaced by ``MASK``; other columns unchanged."""
    rows, spans = secrets(docs, text)
    out = rows.join(broadcast_measured(merged(spans)), "rid", "left")
    body = masked(F.col("row_").getField(text), F.col("covered_"), MASK)
    return unpacked(out.withColumn("row_", F.col("row_").withField(text, body)), docs.columns)
