"""Hand-computed values on tiny tables."""

import pytest
from pyspark.sql import functions as F

from cohortweave.functions import text, vectors
from cohortweave.operators import evaluation as ev, harvest as hv, judging, ordering, ratings, reports, retrieval as rt, sampling
from cohortweave.params import ApplyParams, HarvestParams, RefineParams, SearchParams
from cohortweave.plans import phases


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rank_fusion_order_and_tie(spark):
    hits = spark.createDataFrame(
        [(1, "dense", "A", 3.0, 1), (1, "dense", "B", 2.0, 2), (1, "dense", "C", 1.0, 3),
         (1, "sparse", "B", 3.0, 1), (1, "sparse", "C", 2.0, 2), (1, "sparse", "D", 1.0, 3),
         (2, "dense", "A", 1.0, 1), (2, "sparse", "B", 1.0, 1)],
        "query_id int, path string, pk string, score double, rank int",
    )
    fused = rt.fuse(hits, 60).orderBy("query_id", "fused_rank").collect()
    assert [r["pk"] for r in fused if r["query_id"] == 1] == ["B", "C", "A", "D"]
    assert [r["pk"] for r in fused if r["query_id"] == 2] == ["A", "B"]
    assert fused[0]["source_paths"] == ["dense", "sparse"]


def test_cosine_distance(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], [2.0, 4.0]), (2, [1.0, 0.0], [0.0, 1.0]), (3, [0.0, 0.0], [1.0, 1.0])],
        "i int, a array<double>, b array<double>",
    )
    got = [r[1] for r in rows(df.withColumn("d", vectors.cosine_distance(F.col("a"), F.col("b"))), "i", "d")]
    assert got == pytest.approx([0.0, 1.0, 1.0])
    bad = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="dimensions differ"):
        bad.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()


def test_quantile_is_linear(spark):
    df = spark.createDataFrame([(float(i),) for i in range(15)], "v double")
    for small in (1_000_000, 1):
        got = ordering.quantiles(df, [], "v", {"p90": 0.9, "p50": 0.5}, small_group=small).first()
        assert got["p90"] == pytest.approx(12.6) and got["p50"] == pytest.approx(7.0) and got["n"] == 15


def angle(d):
    """A unit vector at cosine distance ``d`` of [1, 0]."""
    c = 1.0 - d
    return [c, (1.0 - c * c) ** 0.5]


def anchor_table(spark, items):
    return spark.createDataFrame(
        [("s", f"f{i}", i, f"c{i}", span, chunk) for i, (span, chunk) in enumerate(items, 1)],
        "session_id string, fit_pk string, fit_ord int, chunk_id string, span array<double>, chunk array<double>",
    )


def test_calibration_and_quality_gate(spark):
    spans = [[1.0, 0.0], angle(0.1), angle(0.3), angle(0.5)]
    chunks = [angle(0.01), angle(0.1), angle(0.3), [-1.0, 0.0]]
    a = anchor_table(spark, zip(spans, chunks))
    cal = {r["fit_pk"]: r for r in hv.calibrate(a).collect()}
    assert cal["f1"]["nearest_distance"] == pytest.approx(0.1)
    assert cal["f1"]["delta"] == pytest.approx(0.01)
    assert cal["f1"]["T_prime"] == pytest.approx(cal["f1"]["T"] + 0.01)
    assert cal["f1"]["T_prime_out"] == pytest.approx(cal["f1"]["T"], abs=1e-9)
    gate = {r["fit_pk"]: r for r in hv.quality_gate(hv.calibrate(a)).collect()}
    assert gate["f4"]["dropped"] and list(gate["f4"]["reasons"]) == ["exceeds_T", "exceeds_median_multiple"]
    assert gate["f1"]["survivors"] == 3 and gate["f1"]["thin"]
    with pytest.raises(Exception, match="at least two anchors"):
        hv.calibrate(a.where("fit_pk = 'f1'")).collect()
    with pytest.raises(Exception, match="frequency_gate exceeds"):
        hv.survivors(a, hv.quality_gate(hv.calibrate(a)), HarvestParams(anchor_frequency_gate=4)).collect()


def test_radius_join_and_attribution(spark):
    anchors = spark.createDataFrame(
        [("s", "A", 1, "cA", [1.0, 0.0], 0.25), ("s", "B", 2, "cB", [0.0, 1.0], 0.10)],
        "session_id string, fit_pk string, fit_ord int, chunk_id string, span array<double>, radius double",
    )
    corpus = spark.createDataFrame(
        [("cand1", angle(0.05)), ("cand2", angle(0.20)), ("cand3", angle(0.50)), ("cand4", angle(0.10)), ("A", [1.0, 0.0])],
        "pk string, dense array<double>",
    )
    hits = rows(hv.radius_join(anchors, corpus).where("fit_pk = 'A'"), "pk")
    assert hits == [("A",), ("cand1",), ("cand2",), ("cand4",)]
    wide = anchors.withColumn("radius", F.when(F.col("fit_pk") == "A", 0.99).otherwise(0.5))
    got = {r["pk"]: r for r in hv.cohort_pass(wide, corpus).collect()}
    assert got["cand3"]["nearest_fit_pk"] == "B" and list(got["cand3"]["qualifying_fit_pks"]) == ["A", "B"]
    assert got["A"]["is_anchor"] and not got["cand1"]["is_anchor"]
    plain = {r["pk"]: r for r in hv.attribute(hv.radius_join(wide, corpus), wide).collect()}
    assert {k: (v["nearest_fit_pk"], v["qualifying_fit_count"]) for k, v in plain.items()} == {
        k: (v["nearest_fit_pk"], v["qualifying_fit_count"]) for k, v in got.items()
    }


def test_equal_distance_goes_to_the_earliest_anchor(spark):
    anchors = spark.createDataFrame(
        [("s", "Z", 1, "cZ", [1.0, 0.0], 0.9), ("s", "A", 2, "cA", [1.0, 0.0], 0.9)],
        "session_id string, fit_pk string, fit_ord int, chunk_id string, span array<double>, radius double",
    )
    corpus = spark.createDataFrame([("p", [0.6, 0.8])], "pk string, dense array<double>")
    assert hv.cohort_pass(anchors, corpus).first()["nearest_fit_pk"] == "Z"


def test_recovery_verdicts(spark):
    spans = [[1.0, 0.0], [0.95, 0.31], [0.85, 0.53]]
    a = anchor_table(spark, [(s, spans[1]) for s in spans])
    near = spark.createDataFrame([(f"f{i}", spans[1]) for i in (1, 2, 3)], "pk string, dense array<double>")
    rec = hv.loo_recovery(a, near)
    assert rows(hv.loo_verdict(rec), "recovered", "total", "verdict") == [(3, 3, "HEALTHY")]
    far = spark.createDataFrame([("x", [-1.0, 0.0])], "pk string, dense array<double>")
    assert rows(hv.loo_verdict(hv.loo_recovery(a, far)), "recovered", "verdict") == [(0, "FAILED")]
    flagged = spark.createDataFrame([("s", i < 10) for i in range(16)], "session_id string, recovered boolean")
    assert hv.loo_verdict(flagged).first()["verdict"] == "FLAGGED"


def test_equal_count_bins_and_draw(spark):
    def cohort(n):
        return spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("pk"), (F.col("id") / n).alias("nearest_fit_distance"))

    for n, sizes in ((200, [40] * 5), (203, [40, 40, 40, 40, 43])):
        b = sampling.decile_bins(cohort(n), 5)
        assert [r[1] for r in rows(b.groupBy("decile").count(), "decile", "count")] == sizes
    few = sampling.decile_bins(cohort(3), 5)
    assert {r["decile"] for r in few.collect()} == {4}
    p = RefineParams(sample_size=50, n_bins=5)
    drawn = sampling.draw(sampling.decile_bins(cohort(200), 5), p)
    assert [r[1] for r in rows(drawn.groupBy("decile").count(), "decile", "count")] == [10] * 5
    assert rows(drawn, "pk") == rows(sampling.draw(sampling.decile_bins(cohort(200).repartition(7), 5), p), "pk")
    with pytest.raises(Exception, match="cohort too small"):
        sampling.draw(sampling.decile_bins(cohort(40), 5), p).collect()


def test_diverse_selection(spark):
    items = [(c * 3 + i, [float(c == k) + (0.001 * i if k == c else 0.0) for k in range(4)]) for c in range(4) for i in range(3)]
    df = spark.createDataFrame([("s", o, v) for o, v in items], "session_id string, ord int, vec array<double>")
    picks = [r["ord"] for r in sampling.diverse(df, 4).orderBy("pick").collect()]
    assert picks[0] == 0 and sorted(p // 3 for p in picks) == [0, 1, 2, 3]
    assert sampling.diverse(df.where("ord < 2"), 4).count() == 2
    with pytest.raises(ValueError):
        sampling.diverse(df, 0)


def test_precision_recall_and_projection(spark):
    y = [1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    p = [0.9, 0.8, 0.75, 0.7, 0.7, 0.6, 0.4, 0.3, 0.2, 0.1]
    pool = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(zip(y, p))], "session_id string, pk int, label int, p_keep double")
    got = ev.precision_recall_at(pool, 0.7).first()
    assert (got["precision"], got["recall"]) == (0.8, 1.0)
    none = ev.precision_recall_at(pool, 0.99).first()
    assert (none["precision"], none["recall"]) == (0.0, 0.0)
    scored = spark.createDataFrame(
        [("s", d, x) for x, d in [(0.9, 0), (0.8, 0), (0.4, 1), (0.3, 1), (0.95, 2), (0.2, 2)]],
        "session_id string, decile int, p_keep double",
    )
    proj = {r["decile"]: r for r in ev.project(scored, 0.5, 4).collect()}
    assert proj[0]["keep"] == 3 and [proj[i]["keep_rate"] for i in range(4)] == [1.0, 0.0, 0.5, None]


def test_threshold_selection_none(spark):
    pool = spark.createDataFrame([("s", 1, 0, 0.5), ("s", 2, 0, 0.6)], "session_id string, pk int, label int, p_keep double")
    assert ev.select_threshold(pool, 0.75).first()["threshold"] is None


EVENT = "session_id string, turn int, kind string, path string, pos int, pk string, rating string"


def event_rows(spark, items):
    return spark.createDataFrame([("s", *i) for i in items], EVENT)


def test_convergence_gates(spark):
    p = HarvestParams(min_fit=2, min_not_fit=1, precision_at_k=0.8)
    met = event_rows(spark, [
        (1, "row", None, 1, "a", "FIT"), (1, "row", None, 2, "n", "NOT_FIT"), (1, "row", None, 3, "d", "DISCARD"),
        (2, "row", None, 1, "a", "FIT"), (2, "candidate", "dense", 1, "b", "FIT"),
    ])
    got = ratings.convergence(met, p).first()
    assert got["converged"] and (got["latest_precision"], got["cumulative_fit"]) == (1.0, 2)
    assert not ratings.convergence(met.where("pk <> 'b'"), p).first()["converged"]
    assert not ratings.convergence(met.where("pk <> 'n'"), p).first()["converged"]
    assert ratings.precision_at_k(met.where("rating = 'DISCARD'")).first()["precision_at_k"] == 0.0


def test_candidate_not_fit_counts_only_for_refine(spark):
    base = event_rows(spark, [(1, "row", None, 1, "a", "FIT"), (2, "candidate", "dense", 1, "a", "NOT_FIT")])
    full = base.select("*", *[F.lit("x").alias(c) for c in ("chunk_id", "chunk_content", "span_text")], F.array(F.lit(0)).alias("span_line_indices"))
    assert ratings.fit_exemplars(full, "anchor").count() == 1
    assert ratings.fit_exemplars(full, "refine").count() == 0


STAGES = [
    ({"phase3.meta": "agree"}, "x", "APPLY_PENDING"), ({"phase3.meta": "agree", "phase4.labels": None}, "x", "DONE_VIEW"),
    ({"phase3.meta": "abort", "phase2.meta": None}, "x", "POST_HARVEST"), ({"phase3.rubric": None, "phase3.evidence": None}, "x", "POST_RUBRIC"),
    ({"phase3.rubric": None}, "converged", "POST_TUNING"), ({}, "converged", "POST_TUNING"), ({}, None, None),
]


def test_session_stages(spark):
    arts = [(i, a, dec) for i, (files, _, _) in enumerate(STAGES) for a, dec in files.items()]
    artifacts = spark.createDataFrame(arts, "session_id int, artifact string, operator_decision string")
    log = spark.createDataFrame([(i, 1, None) for i in range(len(STAGES))] + [(i, 2, e) for i, (_, e, _) in enumerate(STAGES)], "session_id int, line_no int, event string")
    got = dict(rows(reports.session_stage(artifacts, log).fillna("none"), "session_id", "stage"))
    assert got == {i: s or "none" for i, (_, _, s) in enumerate(STAGES)}


def test_export_ids(spark):
    df = spark.createDataFrame([("64094054-30006713-14-pre-p",), ("no-dashes-shape",), ("plain",)], "pk string")
    got = rows(df.select(text.key_user(F.col("pk")).alias("u"), text.key_counselor(F.col("pk")).alias("c")), "u", "c")
    assert got == [("", ""), ("", ""), ("64094054", "30006713")]


def test_judge_errors_are_rows(spark):
    sample = spark.createDataFrame([("s", 1, 0, "selected"), ("s", 2, 0, "selected"), ("s", 3, 0, "selected"), ("s", 4, 0, "auto_drop"), ("s", 5, 0, "selected")], "session_id string, pk int, decile int, arm string")
    content = spark.createDataFrame([(1, "good text"), (2, "bad"), (4, "known"), (5, "boom")], "pk int, original_content string")

    def answer(prompts):
        return [None if "boom" in p else "???" if "bad" in p else '{"verdict": "KEEP", "evidence_line_indices": [1]}' for p in prompts]

    got = {r["pk"]: r for r in judging.judge(sample, content, ["c"], answer, 1).collect()}
    assert got[1]["verdict"] == "KEEP" and got[1]["attempts"] == 1
    assert got[2]["verdict"] == "ERROR" and got[2]["error_kind"] == "parse" and got[2]["attempts"] == 2
    assert got[3]["verdict"] == "ERROR" and got[3]["reason"] == "empty_chunk_content" and got[3]["attempts"] == 0
    assert got[4]["failed_check"] == judging.AUTO_DROP and got[4]["verdict"] == "DROP"
    assert got[5]["error_kind"] == "api"


def test_parameters_are_checked():
    for build in (
        lambda: SearchParams(min_survivors=11), lambda: SearchParams(active_paths=()), lambda: SearchParams(active_paths=("bm25",)),
        lambda: HarvestParams(anchor_frequency_gate=0), lambda: HarvestParams(s2c_outlier_multiple=1.0), lambda: HarvestParams(radius_scheme="x"),
        lambda: RefineParams(sample_size=55), lambda: ApplyParams(n_splits=1), lambda: ApplyParams(confidence_threshold=1.5),
    ):
        with pytest.raises(ValueError):
            build()


def test_failed_recovery_stops_the_harvest(spark):
    a = anchor_table(spark, [([1.0, 0.0], [1.0, 0.0]), ([0.95, 0.31], [0.95, 0.31]), ([0.85, 0.53], [0.85, 0.53])])
    corpus = spark.createDataFrame([("x", [-1.0, 0.0])], "pk string, dense array<double>")
    nothing = spark.createDataFrame([], "session_id string, pk string")
    with pytest.raises(ValueError, match="recovery failed"):
        phases.run_harvest(a, corpus, nothing, nothing)
