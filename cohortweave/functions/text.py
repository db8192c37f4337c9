"""Text, id and line-index expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERDICT_KEYS = ("verdict", "evidence_line_indices", "failed_check", "reason")


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def terms(text: Column) -> Column:
    """Lower-cased words: maximal runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")


def term_counts(words: Column) -> Column:
    """A list of words as an array of one struct (terms, weights): its different words in order, and how often each stands there; empty without
    words. The sorted list is bound as a lambda variable, so it is made once."""

    def runs(v: Column) -> Column:
        n = F.size(v)
        last = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(v, i - 1) != F.get(v, i)))
        return F.when(n > 0, F.element_at(F.transform(F.array(last), lambda e: counted(v, e)), 1))

    def counted(v: Column, e: Column) -> Column:
        times = F.transform(e, lambda i, k: (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("double"))
        return F.struct(F.transform(e, lambda i: F.get(v, i - 1)).alias("terms"), times.alias("weights"))

    return F.filter(F.transform(F.array(F.sort_array(words)), runs), lambda s: s.isNotNull())


def display_id(sample_id: Column, chunk_seq: Column, pk: Column, pk_is_text: bool = False) -> Column:
    """``{sample}_C{seq:07d}``; without a sequence number the key stands in."""
    fallback = pk.cast("string") if pk_is_text else F.format_string("%07d", pk.cast("long"))
    tail = F.when(chunk_seq.isNotNull(), F.format_string("%07d", chunk_seq.cast("long"))).otherwise(fallback)
    return F.concat(sample_id, F.lit("_C"), tail)


_PK_SHAPE = r"^([^-]*)-?(.*?)-[^-]*-[^-]*-[^-]*$"


def key_user(pk: Column) -> Column:
    return F.regexp_extract(pk, _PK_SHAPE, 1)


def key_counselor(pk: Column) -> Column:
    return F.regexp_extract(pk, _PK_SHAPE, 2)


def span_text(text: Column, indices: Column, strict: bool = False) -> Column:
    """Selected 0-based lines joined by newline.

    The strict form fails on an index past the last line, the lenient one skips it.
    """
    parts = lines(text)
    n = F.size(parts)
    inside = F.filter(indices, lambda i: i < n)
    chosen = F.array_join(F.transform(inside, lambda i: F.element_at(parts, (i + 1).cast("int"))), "\n")
    if not strict:
        return chosen
    bad = F.size(inside) < F.size(indices)
    return F.when(~bad, chosen).otherwise(F.raise_error(F.lit("span line index out of range")).cast("string"))


def number_lines(text: Column, first: int) -> Column:
    """Each line prefixed with its number in brackets."""
    return F.array_join(
        F.transform(
            lines(text),
            lambda line, i: F.concat(F.lit("["), (i + first).cast("string"), F.lit("] "), line),
        ),
        "\n",
    )


def first_lines(text: Column, n: int = 3) -> Column:
    """The first ``n`` non-empty lines joined by `` / ``."""
    kept = F.slice(F.filter(F.transform(lines(text), strip), lambda s: s != ""), 1, n)
    return F.when(F.size(kept) == 0, F.lit("(empty)")).otherwise(F.array_join(kept, " / "))


def ascending_unique(indices: Column) -> Column:
    return F.array_sort(F.array_distinct(indices)) == indices


def span_is_valid(indices: Column, text: Column, cap: int = 3) -> Column:
    n = F.size(lines(text))
    return (
        (F.size(indices) <= cap)
        & ascending_unique(indices)
        & F.forall(indices, lambda i: (i >= 0) & (i < n))
    )


def union_spans(left: Column, right: Column) -> Column:
    """Sorted distinct union of two index lists; null stands for a failed source."""
    both = F.array_sort(F.array_distinct(F.concat(left, right)))
    return F.when(left.isNotNull() & right.isNotNull(), both).otherwise(F.coalesce(left, right))


def merged_reason(left: Column, right: Column) -> Column:
    """Both reasons labelled by source, or the one of the source that answered."""
    both = F.concat(F.lit("[primary] "), left, F.lit(" || [secondary] "), right)
    return F.when(left.isNotNull() & right.isNotNull(), both).otherwise(F.coalesce(left, right))


def json_body(raw: Column) -> Column:
    """Answer text with reasoning blocks removed, cut to its outermost braces."""
    cleaned = strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    cutout = F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)
    return F.when(cleaned.startswith("{"), cleaned).otherwise(cutout)


def strict_object(body: Column) -> Column:
    """The JSON object that ``body`` is, as a variant; null when it is anything else or anything follows it."""
    alone = F.size(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})) == 1
    return F.when(alone & F.json_object_keys(body).isNotNull(), F.try_parse_json(body))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _lax_int(value: Column) -> Column:
    """An index as an int: whole numbers, also as text or with a zero fraction; null for anything else."""
    number, words = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    whole = _kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)") & (number == F.floor(number))
    spelled = (_kind(value) == "STRING") & words.rlike(r"^\s*[+-]?[0-9]{1,9}(\.0+)?\s*$")
    return F.when(whole & (F.abs(number) < 2**31), number.cast("int")).when(spelled, F.trim(words).cast("double").cast("int"))


def evidence_indices(parsed: Column, cap: int = 3) -> Column:
    """The evidence list as ints, null if an entry is none. Longer lists keep their first ``cap`` distinct ints, sorted."""
    raw = F.try_variant_get(parsed, "$.evidence_line_indices", "array<variant>")
    ints = F.transform(F.filter(raw, lambda v: _kind(v) == "BIGINT"), lambda v: F.try_variant_get(v, "$", "int"))
    lax = F.transform(raw, _lax_int)
    return F.when(F.size(raw) > cap, F.array_sort(F.slice(F.array_distinct(ints), 1, cap))).otherwise(
        F.when(~F.exists(lax, lambda i: i.isNull()), lax)
    )


def verdict_fields(parsed: Column) -> Column:
    """The fields of a parsed verdict; texts only where they are texts."""
    part = lambda name: F.try_variant_get(parsed, f"$.{name}", "variant")
    words = lambda name: F.when(_kind(part(name)) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string"))
    odd = ~_kind(part("failed_check")).isin("STRING", "VOID", "MISSING") | ~_kind(part("reason")).isin("STRING", "MISSING")
    return F.struct(
        words("verdict").alias("verdict"),
        evidence_indices(parsed).alias("evidence_line_indices"),
        words("failed_check").alias("failed_check"),
        F.coalesce(words("reason"), F.lit("")).alias("reason"),
        F.coalesce(odd, F.lit(False)).alias("odd"),
    )


def contract_breach(fields: Column, body: Column, text: Column, checks: Column) -> Column:
    """Why a parsed verdict is unacceptable, or null when it is fine."""
    idx = fields["evidence_line_indices"]
    n = F.size(lines(text))
    known = F.array(*[F.lit(k) for k in VERDICT_KEYS])
    return (
        F.when(strict_object(body).isNull(), "invalid_json")
        .when(F.size(F.array_except(F.json_object_keys(body), known)) > 0, "unknown_key")
        .when(fields["verdict"].isNull() | ~fields["verdict"].isin("KEEP", "DROP"), "bad_verdict")
        .when(fields["odd"], "bad_type")
        .when(idx.isNull() | (F.size(idx) < 1) | (F.size(idx) > 3), "evidence_length")
        .when(~F.forall(idx, lambda i: (i >= 1) & (i <= n)), "evidence_range")
        .when(~ascending_unique(idx), "evidence_order")
        .when((fields["verdict"] == "KEEP") & fields["failed_check"].isNotNull(), "keep_with_check")
        .when((fields["verdict"] == "DROP") & fields["failed_check"].isNull(), "drop_without_check")
        .when((fields["verdict"] == "DROP") & ~F.array_contains(checks, fields["failed_check"]), "unknown_check")
        .when(F.length(fields["reason"]) > 500, "reason_too_long")
    )


def zero_based(indices: Column) -> Column:
    return F.transform(F.filter(indices, lambda i: i >= 1), lambda i: i - 1)


def cache_key(model: Column, prompt_version: Column, query: Column, content: Column) -> Column:
    return F.sha2(F.to_json(F.array(model, prompt_version, query, content)), 256)


def int_keys(sparse: Column) -> Column:
    return F.transform_keys(sparse, lambda k, _v: k.cast("int"))


def seeded_order(seed: int, *parts: Column) -> Column:
    """Deterministic shuffle key shared with plain SQL engines."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
