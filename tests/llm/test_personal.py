"""Base spans against plain Python, further kinds on a fixture, awkward rows."""

import hashlib
import random
import re

from cohortweave.llm import personal
from cohortweave.llm.personal_query import op6_weak_supervision

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, hit):
    digits = [int(c) for c in hit if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(kind, m.group())]
    spans.sort()
    counts = [sum(s[2] == k for s in spans) for k in KINDS]
    return counts, ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def hold(rows, texts):
    for r in rows:
        counts, spelled = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts, texts[r["doc_id"]][:200]
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert set(filter(None, spelled.split(","))) <= set(r["spans"].split(","))


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_weak_supervision(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    hold(rows, texts)


def test_random_and_awkward_texts(spark):
    rng = random.Random(11)
    pool = ["a", "x.y", "@", ".", "b-c", "%", "+", "1", "23", "255", "256", "4111 1111 1111 1111", "-", " ", "(", ")", "é", "🙂", "4", "\n", "+1 (415) 555-0199", "me@x.org", "10.0.0.1"]
    texts = {i: "".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "1." * 20_000, 1003: "1" * 50_000, 1004: "a." * 30_000 + "@", 1005: "a@b" + ".c" * 20_000, 1006: "a@b.c%d@e.f", 1007: "1 " * 20_000, 1008: "+1" + "(" * 20_000}
    df = spark.createDataFrame([(k, v, 1, "r") for k, v in texts.items()], "doc_id long, text string, n_email int, row_ string")
    rows = personal.report(df.repartition(4), ["doc_id"]).collect()
    assert len(rows) == len(texts)
    hold(rows, texts)
    assert personal.report(df.limit(0), ["doc_id"]).count() == 0
    assert personal.report(df.filter("doc_id = 1000").union(df.filter("doc_id = 1000")), ["doc_id"]).count() == 2


def test_votes_decide_on_further_kinds(spark):
    good = [f"please call the phone {200 + i}-555-{1000 + i} soon" for i in range(40)] + [f"her ssn is {100 + i}-22-{3000 + i} there" for i in range(40)]
    bad = [f"see order number x{300 + i} 555-{1000 + i}y and isbn 12.34" for i in range(40)]
    mails = [f"mail user{i}@example.com now" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(good + bad + mails)), "doc_id long, text string")
    rows, spans, model = personal.personal(df)
    kinds = {r["kind"]: r["n"] for r in spans.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds["local_phone"] == 40 and kinds["ssn"] == 40 and kinds["email"] == 40
    assert (model.reliabilities.sum(axis=2).round(9) == 1).all()
    masked = {r["doc_id"]: r["text"] for r in personal.redacted(df).collect()}
    assert masked[0] == "please call the phone [PERSONAL] soon" and masked[120] == "mail [PERSONAL] now"
