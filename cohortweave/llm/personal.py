"""Personal data in texts by weak supervision (native expressions only).

Candidates of every kind are found by pattern. Labelers vote on each: the strict form of its kind, gazetteers, words before it, words that
speak against it, and free-standing edges. The votes are counted per pattern of votes; expectation-maximisation on
these counts (a bounded table, however many spans there are) estimates how reliable each labeler is and how likely each
candidate is to be personal data. A logistic classifier over the votes, the kind and the length is
then trained on these likelihoods, again on counts, and decides. Base kinds are checked exactly and always stay; the
classifier adds spans of the further kinds.

Defined cases: null text counts as empty and has no spans; repeated rows are scanned each for itself; an empty table, or one without
candidates, trains nothing and gives only base spans; columns of the caller are carried in a struct.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_measured, packed, save, unpacked
from .spans import Pattern, masked, merged, placed, scanned, summed_up

CONTEXT = 48
MASK = "[PERSONAL]"

_LOCAL = "[A-Za-z0-9._%+-]"
# Possessive repeats keep long runs from recursing; a match can only begin where a run does, or where the last match ended.
BASE = (
    Pattern("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needles=("@",), context=CONTEXT),
    Pattern("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", context=CONTEXT),
    Pattern("card", r"[0-9](?:[\x20-]?[0-9])++", context=CONTEXT),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]", needles=("+",), context=CONTEXT),
)
FURTHER = (
    Pattern("local_phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", context=CONTEXT),
    Pattern("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", context=CONTEXT),
    Pattern("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", context=CONTEXT),
    Pattern("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?", context=CONTEXT),
    Pattern("birth", r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])", context=CONTEXT),
    Pattern("street", r"(?<![0-9])[0-9]{1,5}\x20[A-Z][a-z]+\x20(?:Street|Avenue|Road|Lane|Drive|Court|Boulevard)(?![a-z])", context=CONTEXT),
)
PATTERNS = BASE + FURTHER
BASE_KINDS = tuple(p.kind for p in BASE)

#: Words that speak for or against a kind when they stand shortly before a candidate.
FOR = {
    "email": "mail|contact|write|adress|correo",
    "ip": "ip|host|server|client|login",
    "card": "card|visa|credit|karte|carte|tarjeta|account",
    "phone": "phone|call|tel|mobile|fax|dial",
    "local_phone": "phone|call|tel|mobile|fax|dial",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|bank|account|konto",
    "name": "name|dear|contact|signed|from",
    "birth": "born|birth|dob|geboren|nacid|naissance",
    "street": "address|live|lives|street|ship|mail|at",
}
AGAINST = "version|isbn|invoice|order|page|section|article|figure|equation|line|release|build|serial"
#: Common endings of addresses, given names, country codes of accounts.
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|de|fr|es|uk|io)$",
    "ip": r"^(?!0\.|127\.|255\.|224\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": r"^\(?[2-9]",
    "ssn": r"^(?!000|666|9)",
    "iban": r"^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE)",
    "name": r"\x20(James|Mary|John|Anna|Peter|Maria|Paul|Laura|Hans|Marie|Jean|Pierre|Luis|Carmen|David|Sarah|Thomas|Julia|Michael|Elena)",
    "birth": r"(19[2-9][0-9]|20[01][0-9])",
    "street": r"\x20(Main|Oak|Park|High|Church|Mill|Station|King|Queen|Maple|Elm|Lake|Hill|Green)\x20",
}


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    parts = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(
            (2 * F.substring(turned, i, F.lit(1)).cast("int")) % 10 + F.floor(F.substring(turned, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    """The checks of the base kinds; other kinds pass."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    small = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(x, F.lit(3)), F.lit("999")).cast("int"), F.lit(0)) <= 255)
    return (
        F.when(kind == "ip", F.forall(F.split(hit, r"\."), small))
        .when(kind == "card", F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


@dataclass(frozen=True)
class Model:
    """Reliabilities by labeler: P(vote | personal), P(vote | not), votes in the order -1, 0, 1; and the classifier's weights."""

    reliabilities: np.ndarray
    intercept: float
    kinds: dict[str, float]
    votes: tuple[tuple[float, float, float], ...]
    lengths: tuple[float, ...]


LABELERS = ("form", "gazetteer", "context", "against", "edges")
LENGTHS = 4


def voted(spans: DataFrame) -> DataFrame:
    """Candidates with a vote of -1, 0 (abstains) or 1 per labeler, and a length class."""
    kind, hit = F.col("kind"), F.col("hit")
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.coalesce("after", F.lit(""))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    form = (
        F.when(kind.isin("email", "ip", "phone"), F.lit(1))
        .when(kind == "card", F.lit(1))
        .when(kind == "ssn", F.when(digits.rlike("^([0-9])\\1+$"), F.lit(-1)).otherwise(1))
        .when(kind == "local_phone", F.when(F.length(digits) == 10, F.lit(1)).otherwise(-1))
        .otherwise(0)
    )
    # The pattern depends on the row's kind, so it is chosen by kind and applied as a constant per branch.
    said = lambda table, text, edge: reduce(lambda c, kv: c.when((kind == kv[0]) & text.rlike(edge(kv[1])), F.lit(1)), list(table.items()), F.when(F.lit(False), F.lit(1)))
    whole = lambda words: rf"(?<![a-z])({words})[a-z]*[^a-z0-9]*(\S+[^a-z0-9]+){{0,2}}$"
    edges = F.when(before.rlike("[a-z0-9]$") | after.rlike("^[A-Za-z0-9]"), F.lit(-1)).otherwise(1)
    return spans.select(
        "*",
        form.cast("int").alias("form"),
        said(GAZETTEER, hit, str).otherwise(0).cast("int").alias("gazetteer"),
        said(FOR, before, whole).otherwise(0).cast("int").alias("context"),
        F.when(before.rlike(whole(AGAINST)), F.lit(-1)).otherwise(0).cast("int").alias("against"),
        edges.cast("int").alias("edges"),
        F.least(F.lit(LENGTHS - 1), F.floor(F.length(hit) / 8)).cast("int").alias("length_class"),
    )


def trained(counts: list[tuple], rounds: int = 60) -> Model:
    """Expectation-maximisation and the classifier, from rows (kind, votes..., length class, n)."""
    kinds = sorted({c[0] for c in counts})
    kind = np.array([kinds.index(c[0]) for c in counts])
    votes = np.array([c[1 : 1 + len(LABELERS)] for c in counts]) + 1
    length = np.array([c[-2] for c in counts])
    n = np.array([float(c[-1]) for c in counts])
    # Start from the majority of the votes; smoothing keeps every vote possible.
    likely = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    table = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        share = np.array([(n * likely)[kind == k].sum() + 1 for k in range(len(kinds))]) / np.array([n[kind == k].sum() + 2 for k in range(len(kinds))])
        for j in range(len(LABELERS)):
            for y, w in ((0, n * (1 - likely)), (1, n * likely)):
                table[j, y] = [w[votes[:, j] == v].sum() + 0.5 for v in range(3)]
                table[j, y] /= table[j, y].sum()
        odds = np.log(share / (1 - share))[kind]
        for j in range(len(LABELERS)):
            odds = odds + np.log(table[j, 1][votes[:, j]] / table[j, 0][votes[:, j]])
        likely = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    # Newton steps of a ridge logistic regression on the likelihoods.
    one = lambda values, size: np.eye(size)[values]
    x = np.hstack([np.ones((len(n), 1)), one(kind, len(kinds)), *[one(votes[:, j], 3) for j in range(len(LABELERS))], one(length, LENGTHS)])
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (likely - p)) - ridge * weights
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        weights += np.linalg.solve(hessian, gradient)
    at = 1 + len(kinds)
    return Model(
        table,
        float(weights[0]),
        {k: float(weights[1 + i]) for i, k in enumerate(kinds)},
        tuple(tuple(map(float, weights[at + 3 * j : at + 3 * j + 3])) for j in range(len(LABELERS))),
        tuple(map(float, weights[at + 3 * len(LABELERS) :])),
    )


def score(model: Model) -> Column:
    """The classifier's log odds of a voted candidate."""
    choose = lambda col, values: reduce(lambda c, v: c.when(col == v[0], F.lit(v[1])), values[1:], F.when(col == values[0][0], F.lit(values[0][1]))).otherwise(0.0)
    out = F.lit(model.intercept) + choose(F.col("kind"), list(model.kinds.items()))
    for name, values in zip(LABELERS, model.votes):
        out = out + choose(F.col(name), list(zip((-1, 0, 1), values)))
    return out + choose(F.col("length_class"), list(enumerate(model.lengths)))


def personal(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, Model | None]:
    """(rows, spans, model). rows: ``rid`` and ``row_`` with the columns ``keep`` (all by default); spans: rid, kind, ord, start, end."""
    scan = scanned(packed(docs), F.col("row_").getField(text), PATTERNS)
    if keep is not None:
        scan = scan.withColumn("row_", F.struct(*[F.col("row_").getField(c).alias(c) for c in keep]))
    scan = save(scan.withColumn("rid", F.monotonically_increasing_id()), "personal_scan")
    found = placed(scan, PATTERNS)
    candidates = save(voted(found.filter(valid(F.col("kind"), F.col("hit")))), "personal_votes")
    counts = candidates.groupBy("kind", *LABELERS, "length_class").agg(F.count(F.lit(1)).alias("n")).collect()
    is_base = F.col("kind").isin(*BASE_KINDS)
    model = trained(sorted(tuple(r) for r in counts)) if counts else None
    chosen = candidates.filter(is_base | (score(model) >= 0)) if model else candidates
    return scan.select("rid", "row_"), chosen.select("rid", "kind", "ord", "start", "end"), model


def report(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: ``keep``, counts per base kind, digest of the base spans, all spans."""
    rows, spans, _ = personal(docs, text, keep)
    found = broadcast_measured(summed_up(spans, BASE_KINDS))
    return rows.join(found, "rid", "left").select(
        *[F.col("row_").getField(c).alias(c) for c in keep],
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All documents, with every span replaced by ``MASK``."""
    rows, spans, _ = personal(docs, text)
    out = rows.join(broadcast_measured(merged(spans)), "rid", "left")
    body = masked(F.col("row_").getField(text), F.col("covered_"), MASK)
    return unpacked(out.withColumn("row_", F.col("row_").withField(text, body)), docs.columns)
