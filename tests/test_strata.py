"""What is drawn from a cohort without writing it equals the same drawn from the written one."""

import pytest
from pyspark.sql import functions as F
from test_invariants import same

from cohortweave.operators import harvest as hv, sampling, strata as st
from cohortweave.params import RefineParams
from cohortweave.workload import load_all, tables as t
from cohortweave.workload.harvest_queries import HP, admitting, cohort
from cohortweave.workload.refine_queries import excluded

P = RefineParams(sample_size=40, n_bins=8)
COLUMNS = ["session_id", "pk", "decile", "nearest_fit_distance"]


@pytest.mark.parametrize("max_rows, parts", [(4096, 1), (7, 3)])
def test_pass_draws_what_the_written_cohort_gives(spark, sf_dir, max_rows, parts):
    rows, rated, vecs = cohort(spark, sf_dir), excluded(spark, sf_dir), t.vectors(spark, sf_dir).repartition(parts)
    drawn, binned = sampling.stratified_sample(rows, rated, None, P)
    got = st.stratified_pass(admitting(spark, sf_dir), vecs, HP.anchor_frequency_gate, rated, P, max_rows)
    same(got.drawn.select(COLUMNS), drawn.select(COLUMNS))
    same(got.edges.select("session_id", "edge", "value"), sampling.decile_edges(binned, P.n_bins).select("session_id", "edge", "value"))
    same(got.sizes, sampling.bin_sizes(binned))


@pytest.mark.parametrize("max_rows", [4096, 7])
def test_five_numbers_of_an_unwritten_cohort(spark, sf_dir, max_rows):
    rows = cohort(spark, sf_dir)
    gone = rows.where("pk % 3 = 0").select("session_id", "pk")
    discard = gone.unionByName(t.events(spark, sf_dir).where("rating = 'DISCARD'").select("session_id", "pk"))
    got = st.distance_summary_pass(admitting(spark, sf_dir), t.vectors(spark, sf_dir), HP.anchor_frequency_gate, discard, max_rows)
    same(got, hv.distance_summary(rows.where("pk % 3 <> 0")))


def tied(spark):
    """Two anchors and 300 rows at three distances, the middle one over the edges of most bins."""
    anchors = spark.createDataFrame(
        [("s", -1, 1, "a", [1.0, 0.0], 1.5), ("s", -2, 2, "b", [1.0, 0.0], 1.5)],
        "session_id string, fit_pk long, fit_ord long, chunk_id string, span array<double>, radius double",
    )
    near = F.when(F.col("id") < 20, F.array(F.lit(1.0), F.lit(0.1))).when(F.col("id") < 280, F.array(F.lit(1.0), F.lit(1.0)))
    return anchors, spark.range(300).select(F.col("id").alias("pk"), near.otherwise(F.array(F.lit(0.1), F.lit(1.0))).alias("dense"))


def test_equal_distances_are_ordered_by_key(spark):
    anchors, vecs = tied(spark)
    rows = hv.cohort_pass(anchors, vecs).where("qualifying_fit_count >= 2")
    drawn, binned = sampling.stratified_sample(rows, None, None, P)
    got = st.stratified_pass(anchors, vecs.repartition(4), 2, None, P)
    same(got.drawn.select(COLUMNS), drawn.select(COLUMNS))
    same(got.sizes, sampling.bin_sizes(binned))
    same(st.distance_summary_pass(anchors, vecs, 2, None), hv.distance_summary(rows))
    assert st.distance_summary_pass(anchors, vecs, 3, None).count() == 0


def test_too_small_a_cohort_is_an_error(spark):
    anchors, vecs = tied(spark)
    with pytest.raises(Exception, match="cohort too small"):
        st.stratified_pass(anchors, vecs.where("pk < 39"), 2, None, P)


@pytest.mark.parametrize("name", ["stratified_sample", "distance_summary", "live_verdicts", "classifier_roundtrip", "refine_run_meta"])
def test_no_cohort_is_written_for_what_is_drawn_from_it(spark, sf_dir, name, monkeypatch):
    from cohortweave import session

    def written(*_):
        raise AssertionError("the cohort is written")

    monkeypatch.setattr(session, "_STAGED", {})
    monkeypatch.setattr(hv, "cohort_pass", written)
    assert load_all()[0][name](spark, sf_dir).count() > 0


def test_gradients_move_each_row_once(spark, sf_dir):
    from cohortweave.workload.apply_queries import kfold_models

    plan = kfold_models(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "cogroup" in plan.lower()


def test_scores_are_of_the_nearest_admitting_anchor(spark):
    """Two sessions of unlike size in one block, each row under its session's own classifier."""
    anchors, vecs = tied(spark)
    more = anchors.where("fit_pk = -1").withColumn("session_id", F.lit("t"))
    model = spark.createDataFrame(
        [("s", [1.0, 0.0, 0.0], 0.0, 0.0, 1.0), ("t", [0.0, 0.0, 1.0], 0.0, 0.0, 1.0)],
        "session_id string, coef array<double>, intercept double, scaler_mean double, scaler_scale double",
    )
    got = {(r[0], r[1]): r[3] for r in hv.score_pass(anchors.unionByName(more), model, vecs, 1).collect()}
    assert len(got) == 600
    logistic = lambda z: 1 / (1 + 2.718281828459045 ** -z)
    assert got["s", 100] == pytest.approx(logistic(1.0)) and got["s", 290] == pytest.approx(logistic(0.1))
    assert got["t", 100] == pytest.approx(logistic(1 - 0.5**0.5))
