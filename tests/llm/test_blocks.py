"""Blocks of codes are large rows: a reader, which takes a file's rows at once, meets few of them."""

from pyspark.sql import functions as F

from cohortweave.llm import collocation


def test_few_blocks_lie_in_a_file(spark, monkeypatch):
    kept = []

    def recorded(rows, name, *more, save=collocation.save):
        out = save(rows, name, *more)
        if name == "blocks":
            kept.append(out)
        return out

    monkeypatch.setattr(collocation, "save", recorded)
    docs = spark.createDataFrame([("en", " ".join(f"a b w{i} x{j}" for j in range(200_000))) for i in range(11)], "lang string, text string").coalesce(1)
    got = collocation.mined(docs, collocation.Options(longest=2)).collect()
    files = kept[0].groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(files) >= 3 and max(r["n"] for r in files) <= collocation.FILE_BLOCKS
    assert {r["phrase"]: r["a"] for r in got}["a b"] == 2_200_000
