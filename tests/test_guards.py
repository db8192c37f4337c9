"""Inputs that must be refused, and the guards of the phases."""

import json

import pytest
from pyspark.sql import functions as F

from cohortweave.functions import text
from cohortweave.operators import modelling as md
from cohortweave.params import ApplyParams
from cohortweave.plans import phases
from cohortweave.sources import batches, logs, stores
from cohortweave.workload import tables as t
from cohortweave.workload.apply_queries import AP, pinned_models
from cohortweave.workload.harvest_queries import cohort
from cohortweave.workload.refine_queries import rubrics

ROW = {"rank": 1, "pk": 7, "chunk_content": "text", "rating": "FIT", "scores": {"dense": 0.5}}
TURN = {
    "turn": 1, "timestamp": "2025-01-01T00:00:00Z", "query": "q", "results": [ROW],
    "config": {"rrf_k": 60, "per_path_limit": 20, "top_k": 10, "active_paths": ["dense"]},
    "per_path_candidates": {"sparse": [{"rank_in_path": 2, "pk": 8, "chunk_content": "c"}], "dense": []},
}


def write(folder, *lines, name="abc123.jsonl"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(folder)


def test_log_lines(spark, tmp_path):
    path = write(tmp_path / "a", TURN, "", {"event": "converged", "turn": 1, "ts": "x"}, {**TURN, "turn": 2})
    log = logs.read_turn_log(spark, path)
    assert [r["turn"] for r in logs.session_turns(log).orderBy("line_no").collect()] == [1, 2]
    assert log.orderBy(F.desc("line_no")).first()["session_id"] == "abc123"
    row = logs.flatten_evidence(logs.session_turns(log)).first()
    assert (row["score_dense"], row["score_sparse"], row["span_text"], row["span_line_indices"]) == (0.5, 0.0, "", [])
    assert {r["path"] for r in logs.flatten_candidates(logs.session_turns(log)).collect()} == {"sparse"}


@pytest.mark.parametrize("line", ["{broken", '{"turn": "one", "results": []}', "[1, 2]"])
def test_malformed_lines_fail(spark, tmp_path, line):
    log = logs.read_turn_log(spark, write(tmp_path / "b", TURN, line))
    with pytest.raises(Exception):
        logs.session_turns(log).collect()


def test_turn_without_number_fails(spark, tmp_path):
    log = logs.read_turn_log(spark, write(tmp_path / "c", {k: v for k, v in TURN.items() if k != "turn"}))
    with pytest.raises(Exception, match="integer turn"):
        logs.session_turns(log).collect()


def test_row_without_content_fails(spark, tmp_path):
    bare = {k: v for k, v in ROW.items() if k != "chunk_content"}
    log = logs.read_turn_log(spark, write(tmp_path / "d", {**TURN, "results": [bare]}))
    with pytest.raises(Exception, match="chunk_content"):
        logs.flatten_evidence(logs.session_turns(log)).collect()


@pytest.mark.parametrize(
    "change",
    [
        {"results": [{**ROW, "scores": {"bm25": 1.0}}]},
        {"per_path_candidates": {"bm25": []}},
        {"config": {**TURN["config"], "active_paths": ["dense", "bm25"]}},
    ],
)
def test_legacy_logs_fail(spark, tmp_path, change):
    log = logs.read_turn_log(spark, write(tmp_path / "e", {**TURN, **change}))
    with pytest.raises(Exception, match="legacy"):
        logs.reject_legacy(logs.session_turns(log)).collect()
    good = logs.read_turn_log(spark, write(tmp_path / "f", TURN))
    assert logs.reject_legacy(logs.session_turns(good)).count() == 1


def test_phase_lines_do_not_join_turns(spark, tmp_path):
    lines = [
        {"turn": 1, "timestamp": "a", "search": {"collection": "c", "seen_set_size": 3}},
        {"turn": "phase2", "timestamp": "b", "search": {"collection": "late"}},
    ]
    details = logs.read_details(spark, write(tmp_path / "g", *lines, name="abc123.details.jsonl"))
    turns = logs.session_turns(logs.read_turn_log(spark, write(tmp_path / "h", TURN)))
    assert logs.turn_details(turns, details).first()["seen_set_size"] == 3
    assert logs.search_pin(details).first()["collection"] == "c"


def test_lines_count_in_the_order_in_which_they_were_written(spark, tmp_path):
    """Equal timestamps throughout, a file of several blocks: first and last are first and last in the file."""
    lines = [
        {"turn": t, "timestamp": "same", "search": {"collection": f"c{t}.{i}", "seen_set_size": i}, "reflection": {"raw_response": "x" * 400 + str(i)}}
        for i in range(30)
        for t in (3, 1)
    ]
    path, turns = write(tmp_path / "j", *lines, name="abc123.details.jsonl"), write(tmp_path / "k", TURN)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "4096")
        details = logs.read_details(spark, path)
        assert details.rdd.getNumPartitions() > 3
        assert logs.search_pin(details).first()["collection"] == "c3.0"
        assert logs.turn_details(logs.session_turns(logs.read_turn_log(spark, turns)), details).first()["seen_set_size"] == 29
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_appending_a_batch_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(s, t, f"q{t}") for t in (2, 1) for s in "ab"], "session_id string, turn int, query string")
    assert stores.append_log(rows, path) and stores.append_log(rows.withColumn("turn", F.col("turn") + 2), path)
    read = lambda: [(r["session_id"], r["turn"]) for r in logs.read_turn_log(spark, path).orderBy("session_id", "place").collect()]
    want = [(s, t) for s in "ab" for t in (1, 2, 3, 4)]
    assert read() == want and batches.numbers(spark, path) == [0, 1]
    assert not stores.append_log(rows.withColumn("turn", F.lit(9)), path, 1)
    (tmp_path / "log" / "_writing" / "2-dead").mkdir(parents=True)
    (tmp_path / "log" / "_writing" / "2-dead" / "part.json").write_text('{"turn": 7}')
    assert read() == want
    assert stores.append_log(rows.limit(0), path, 2) and read() == want


@pytest.mark.parametrize("kind", ["BIGINT", "VARCHAR(64)"])
def test_content_from_a_database_equals_content_from_files(spark, tmp_path, kind):
    """Ranges of numbers and of text keys, keys with quotes, and a row without a key: each row once."""
    url, driver = f"jdbc:derby:memory:content{kind[0]};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    key = F.col("id") if kind == "BIGINT" else F.concat(F.lit("k'"), F.col("id") * 7919 % 1000)
    rows = spark.range(1000).select(key.alias("PK"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("text "), "id")).alias("ORIGINAL_CONTENT"))
    if kind == "BIGINT":  # text nulls cannot be written to a VARCHAR of this database
        rows = rows.unionByName(rows.limit(1).withColumn("PK", F.lit(None).cast("long")))
    rows.write.option("createTableColumnTypes", f"PK {kind}").jdbc(url, "CONTENT", "overwrite", {"driver": driver})
    rows.write.parquet(str(tmp_path / "content"))
    got = stores.read_content_jdbc(spark, url, "CONTENT", "PK", 8, driver=driver)
    assert got.rdd.getNumPartitions() == 8 and max(got.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 300
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(got) == order(spark.read.parquet(str(tmp_path / "content")))
    wanted = spark.createDataFrame([(r[0],) for r in rows.limit(20).collect()], f"pk {rows.schema['PK'].dataType.simpleString()}")
    named = lambda df: df.toDF("pk", "original_content")
    assert order(stores.content_lookup(named(got), wanted)) == order(stores.content_lookup(named(rows), wanted))


def test_no_keys_no_ranges(spark):
    assert stores.key_ranges(spark.createDataFrame([], "pk string"), "pk", 4) == ["1 = 1"]


def test_extractor_sees_query_and_earlier_spans(spark):
    from cohortweave.operators import judging

    rows = spark.createDataFrame([("s", 1, "q1", "a\nb"), ("s", 2, "q1", "a\nb"), ("t", 3, "q2", "c\nd"), ("t", 4, "q2", "cached\ne")], "session_id string, pk long, query string, chunk_content string")
    prior = spark.createDataFrame([("s", 2, "late"), ("s", 1, "early")], "session_id string, seq long, span_text string")
    known = rows.where("pk = 4").select(text.cache_key(F.lit("m"), F.lit("v"), F.col("query"), F.col("chunk_content")).alias("cache_key"), F.array(F.lit(1)).alias("span_line_indices"), F.lit("e").alias("span_text"))

    def extractor(prompts):
        seen = {"a\nb": ("q1", ["early", "late"]), "c\nd": ("q2", [])}
        return [json.dumps([0]) if seen[p["text"]] == (p["query"], p["prior_spans"]) else None for p in prompts]

    spans, fresh = judging.extract_spans(rows, known, extractor, "m", "v", prior)
    assert sorted((r["pk"], r["span_text"]) for r in spans.collect()) == [(1, "a"), (2, "a"), (3, "c"), (4, "e")]
    assert fresh.count() == 2 and judging.merged_cache(known, fresh).count() == 3
    again = judging.merged_cache(judging.merged_cache(known, fresh), fresh.withColumn("span_text", F.lit("other")))
    assert sorted(r["span_text"] for r in again.collect()) == ["a", "c", "e"]


def test_cohort_needs_distances(spark, tmp_path):
    path = write(tmp_path / "i", {"session_id": 1, "pk": 1}, name="x.json")
    with pytest.raises(Exception, match="nearest_fit_distance"):
        stores.read_cohort(spark, path).collect()


def test_empty_cohorts_and_drifted_models_fail(spark, tmp_path):
    (tmp_path / "j").mkdir()
    with pytest.raises(Exception, match="empty"):
        stores.read_cohort(spark, write(tmp_path / "j", "", name="x.json"))
    pins = spark.createDataFrame([("s", "c", "old")], "session_id string, collection string, embed_model_id string")
    now = lambda model: spark.createDataFrame([("c", model)], "collection string, current_model_id string")
    assert logs.require_no_drift(logs.model_drift(pins, now("old"))).first()["status"] == "match"
    with pytest.raises(Exception, match="changed from old to new"):
        logs.require_no_drift(logs.model_drift(pins, now("new"))).collect()


def test_calls_fail_prompt_by_prompt():
    from cohortweave.operators.judging import answers_of

    def fussy(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no answer to bad")
        return [p.upper() for p in prompts]

    answers, errors, spent = answers_of(["a", "bad", "c"] + ["d"] * 40, fussy)
    assert answers[:3] == ["A", None, "C"] and errors[:3] == [None, "no answer to bad", None] and answers[3:] == ["D"] * 40
    assert len(spent) == 43


def test_strict_span_text(spark):
    df = spark.createDataFrame([("a\nb", [0, 5])], "body string, idx array<int>")
    assert df.select(text.span_text(F.col("body"), F.col("idx"))).first()[0] == "a"
    with pytest.raises(Exception, match="out of range"):
        df.select(text.span_text(F.col("body"), F.col("idx"), strict=True)).collect()


def test_strip_covers_unicode_space(spark):
    df = spark.createDataFrame([("　 \n\ta b ",)], "s string")
    assert df.select(text.strip(F.col("s"))).first()[0] == "a b"


def test_stored_classifier_must_fit(spark, sf_dir):
    models = pinned_models(spark, sf_dir)
    assert md.checked_models(models, AP.embedding_dim).count() > 0
    with pytest.raises(Exception, match="malformed"):
        md.checked_models(models, 63).collect()


def test_reuse_needs_the_same_rubric(spark, sf_dir):
    other = rubrics(spark, sf_dir).withColumn("rubric_version", F.col("rubric_version") + 1)
    with pytest.raises(Exception, match="rubric_version"):
        phases.apply_reuse(
            cohort(spark, sf_dir), t.vectors(spark, sf_dir), pinned_models(spark, sf_dir), other, AP
        ).collect()


def test_low_precision_needs_the_override(spark):
    pool = spark.createDataFrame([("s", 1, 0, 0.9), ("s", 2, 1, 0.8)], "session_id string, pk int, label int, p_keep double")
    models = spark.createDataFrame([("s",)], "session_id string")
    scored = pool.select("session_id", "pk", "p_keep")
    a = phases.Applied(frame=pool, scaler=models, models=models, pool=pool, metrics=pool)
    with pytest.raises(ValueError, match="precision below"):
        phases.apply_finalize(a, scored, 0.5, ApplyParams())
    labels, decision = phases.apply_finalize(a, scored, 0.5, ApplyParams(), allow_low_precision=True)
    assert decision.first()["operator_decision"] == "override_low_precision" and labels.count() == 2


def test_dry_run_stops_before_the_corpus_pass(spark, sf_dir):
    nothing = spark.createDataFrame([], "session_id long, pk long")
    h = phases.run_harvest(t.anchors(spark, sf_dir), t.vectors(spark, sf_dir), nothing, nothing, dry_run=True)
    assert h.cohort.count() == 0 and h.verdict.count() > 0
