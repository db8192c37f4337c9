"""Cohort queries meet their rows where the vectors are read; the results equal those over the written cohort."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_invariants import same
from test_strata import tied

from cohortweave.operators import blocks, evaluation as ev, harvest as hv, ratings, sampling, strata as st
from cohortweave.plans import phases
from cohortweave.workload import load_all, tables as t
from cohortweave.workload.apply_queries import fixed_models, formula, scores
from cohortweave.workload.harvest_queries import HP, admitting, cohort, members, not_fit

NAMES = [
    "not_fit_intrusion", "score_params", "score_by_key", "score_pass", "reuse_classifier", "reuse_by_key", "apply_run", "cohort_projection",
    "calibrate", "borderline", "labelled_export", "export_csv",
]


def test_no_cohort_is_written_and_no_text_is_cut_into_words(spark, sf_dir, monkeypatch):
    from cohortweave import session

    def called(*_, **__):
        raise AssertionError("not needed")

    monkeypatch.setattr(session, "_STAGED", {})
    for module, name in ((hv, "cohort_pass"), (hv, "loo_recovery"), (t, "term_vectors"), (phases, "score_cohort")):
        monkeypatch.setattr(module, name, called)
    for name in NAMES:
        load_all()[0][name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def test_cohort_needs_no_ranks(spark, sf_dir, monkeypatch):
    from cohortweave.workload.harvest_queries import harvested

    want = harvested(spark, sf_dir).cohort
    monkeypatch.setattr(hv, "loo_recovery", None)
    discard = ratings.discarded(t.events(spark, sf_dir))
    same(phases.admitted_cohort(admitting(spark, sf_dir), t.vectors(spark, sf_dir), discard, HP), want)


def test_members_and_intruders_are_those_of_the_written_cohort(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    same(members(spark, sf_dir).select("session_id", "pk", "nearest_fit_distance"), rows.select("session_id", "pk", "nearest_fit_distance"))
    discard = ratings.discarded(t.events(spark, sf_dir))
    found = hv.intrusion_pass(admitting(spark, sf_dir), t.vectors(spark, sf_dir), HP.anchor_frequency_gate, not_fit(spark, sf_dir), discard)
    same(found, hv.intrusions(rows, not_fit(spark, sf_dir)))


def test_carried_columns_follow_their_row_in_small_batches(spark, monkeypatch):
    anchors, vecs = tied(spark)
    monkeypatch.setattr(blocks, "BATCH_BYTES", 1000)
    rows = vecs.withColumn("name", F.concat(F.lit("n"), F.col("pk").cast("string")))
    got = hv.member_pass(anchors, rows, 2, carried=("pk", "name")).collect()
    assert sorted(r["pk"] for r in got) == list(range(300)) and all(r["name"] == f"n{r['pk']}" for r in got)


@pytest.mark.parametrize("max_rows", [4096, 7])
def test_projection_of_an_unwritten_cohort(spark, sf_dir, max_rows):
    want = ev.project(sampling.decile_bins(cohort(spark, sf_dir).withColumn("p_keep", formula()), 10), 0.6)
    vecs = t.vectors(spark, sf_dir).withColumn("keep", formula() >= 0.6)
    discard = ratings.discarded(t.events(spark, sf_dir))
    same(st.projection_pass(admitting(spark, sf_dir), vecs, HP.anchor_frequency_gate, discard, 10, max_rows), want)


@pytest.mark.parametrize("n", [300, 10, 7])
def test_projection_of_equal_distances_and_of_fewer_rows_than_bins(spark, n):
    anchors, vecs = tied(spark)
    vecs = vecs.where(F.col("pk") < n)
    rows = hv.cohort_pass(anchors, vecs).withColumn("p_keep", (F.col("pk") % 3).cast("double"))
    got = st.projection_pass(anchors, vecs.withColumn("keep", F.col("pk") % 3 >= 1), 2, None, 10)
    same(got, ev.project(sampling.decile_bins(rows, 10), 1.0))


def test_rows_are_admitted_as_by_their_distances():
    rng = np.random.default_rng(5)
    s = np.concatenate([rng.uniform(-1.1, 1.1, 4000), np.repeat([1.0, -1.0, 0.0, np.nan], 50)])
    grid = np.round(s, 12)
    radius = np.concatenate([1.0 - grid[:3000], rng.uniform(-0.1, 2.1, 1200)])
    for shift in (0.0, 1e-13, -1e-13, 5e-13, -5e-13, 1e-12):
        distance = np.maximum(0.0, 1.0 - np.round(np.clip(s + shift, -1.0, 1.0), blocks.GRID))
        plain = distance <= radius + 10.0**-blocks.GRID
        assert ((s + shift >= blocks._admitted_from(radius)) == plain).all()


def test_a_table_in_one_file_is_dealt_to_all_cores(spark, sf_dir):
    vecs = t.vectors(spark, sf_dir).coalesce(1)
    assert blocks.dealt(vecs).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert "p_keep" in scores(spark, sf_dir, vecs).columns and fixed_models(spark, sf_dir).count() > 0
