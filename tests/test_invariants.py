"""The forms used beyond a size bound give the same rows as the ones below it."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.operators import blocks, harvest as hv, modelling as md, ordering, retrieval as rt, training as tr
from cohortweave.params import ApplyParams
from cohortweave.plans import phases
from cohortweave.session import laid_out, lies_by
from cohortweave.sources import stores
from cohortweave.workload import tables as t
from cohortweave.workload.apply_queries import fixed_models
from cohortweave.workload.harvest_queries import HP, cohort, placed


def same(a, b, places=9):
    """Equal rows, doubles within ``10**-places``; the other columns identify a row."""
    assert a.columns == b.columns
    left, right = a.collect(), b.collect()

    def exact(r):
        return repr([v for v in r if not isinstance(v, float)])

    left, right = sorted(left, key=exact), sorted(right, key=exact)
    assert [exact(r) for r in left] == [exact(r) for r in right]
    for x, y in zip(left, right):
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], abs=10**-places)


@pytest.fixture(scope="module")
def vecs(spark, sf_dir):
    return t.vectors(spark, sf_dir)


def test_fragmented_radius_join(spark, sf_dir, vecs):
    a = placed(spark, sf_dir)
    same(hv.radius_join(a, vecs), hv.radius_join(a, vecs, max_rows=7))


def test_fragmented_cohort_pass(spark, sf_dir, vecs):
    a = placed(spark, sf_dir)
    same(hv.cohort_pass(a, vecs), hv.cohort_pass(a, vecs, max_rows=7))
    same(hv.cohort_pass(a, vecs), hv.attribute(hv.radius_join(a, vecs.repartition(5)), a))


def test_fragmented_topk(spark, sf_dir, vecs):
    q, seen = t.queries(spark, sf_dir), t.seen(spark, sf_dir)
    same(rt.dense_topk(vecs, q, 15, seen), rt.dense_topk(vecs.repartition(3), q, 15, seen, max_rows=1))


def test_sparse_forms(spark, sf_dir):
    q, rows, seen = t.queries(spark, sf_dir), t.sparse(spark, sf_dir), t.seen(spark, sf_dir)
    plain = rt.sparse_topk(rows, q, 15, seen)
    same(plain, rt.sparse_topk(rows.repartition(3), q, 15, seen, max_rows=1))
    same(plain, rt.sparse_topk_postings(t.postings(spark, sf_dir), t.query_postings(spark, sf_dir), 15, seen))


def test_small_matrices_change_nothing(spark, sf_dir, vecs, monkeypatch):
    q, rows, a = t.queries(spark, sf_dir), t.sparse(spark, sf_dir), placed(spark, sf_dir)
    want = rt.sparse_topk(rows, q, 15).collect(), rt.dense_topk(vecs, q, 15).collect()
    cohort = hv.cohort_pass(a, vecs).count()
    monkeypatch.setattr(blocks, "MAX_CELLS", 150)
    assert (rt.sparse_topk(rows, q, 15).collect(), rt.dense_topk(vecs, q, 15).collect()) == want
    assert hv.cohort_pass(a, vecs).count() == cohort


def test_score_pass_equals_joining_back(spark, sf_dir, vecs):
    models = fixed_models(spark, sf_dir)
    passed = hv.score_pass(placed(spark, sf_dir), models, vecs, 2)
    rows = hv.cohort_pass(placed(spark, sf_dir), vecs).where("NOT is_anchor AND qualifying_fit_count >= 2")
    same(
        passed,
        phases.score_cohort(rows, vecs, models, 0.5).select("session_id", "pk", "nearest_fit_distance", "p_keep"),
    )


def test_fragmented_nearest_and_recovery(spark, sf_dir, vecs):
    a = t.anchors(spark, sf_dir)
    same(hv.loo_recovery(a, vecs, HP), hv.loo_recovery(a, vecs.repartition(3), HP, max_rows=5))


def test_expression_form_of_radius_join(spark, sf_dir, vecs):
    from cohortweave.functions.vectors import cosine_similarity, similarity_to_distance

    a = placed(spark, sf_dir)
    d = similarity_to_distance(cosine_similarity(F.col("span"), F.col("dense")))
    plain = a.select("session_id", "fit_pk", "span", "radius").join(vecs, F.lit(True)).withColumn("d", d).where("d <= radius")
    same(hv.radius_join(a, vecs), plain.select("session_id", "fit_pk", "pk", "d"))


def skewed(spark, n=3000):
    """A third of all rows in one group, a third of those with one value."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 9 == 0, 0.5).otherwise(F.col("id") * 7919 % n / n).alias("v"),
        F.col("id").alias("pk"),
        (F.col("id") % 5).alias("w"),
    )


def test_distributed_prefix(spark):
    df = skewed(spark)
    order = [F.col("v").asc(), F.col("pk").asc()]
    small = ordering.prefix(df, ["k"], order, {"run": "w"})
    same(small, ordering.prefix(df, ["k"], order, {"run": "w"}, small_group=10))
    same(ordering.prefix(df, [], order), ordering.prefix(df, [], order, small_group=10))


def test_distributed_quantiles_and_bins(spark):
    df = skewed(spark)
    same(ordering.five_number(df, "v", ["k"]), ordering.five_number(df, "v", ["k"], small_group=10))
    order = [F.col("v").asc(), F.col("pk").asc()]
    same(
        ordering.equal_count_bins(df, ["k"], order, 10),
        ordering.equal_count_bins(df, ["k"], order, 10, small_group=10),
    )


def test_distributed_cap(spark, sf_dir, vecs):
    hits = hv.radius_join(placed(spark, sf_dir), vecs)
    capped = hv.cap_hits(hits, 5)
    assert capped.groupBy("session_id", "fit_pk").count().agg(F.max("count")).first()[0] == 5
    assert hv.cap_hits(hits, 10**6) is hits


def test_capped_harvest_pass(spark, sf_dir, vecs):
    a = placed(spark, sf_dir)
    rows, budget = phases.attributed_pass(a, vecs, 5)
    assert budget.where("budget_exhausted").count() > 0
    assert rows.select(F.explode("qualifying_fit_pks").alias("f"), "session_id").groupBy("session_id", "f").count().agg(
        F.max("count")
    ).first()[0] <= 5


def gaussians(spark, n=200, sid="s"):
    rng = np.random.default_rng(7)
    rows = [(sid, i, i % 2, [float(x) for x in rng.normal(2.0 if i % 2 else -2.0, 0.3, 4)]) for i in range(n)]
    return spark.createDataFrame(rows, "session_id string, pk long, label int, features array<double>")


def mixed_sessions(spark):
    """Sessions of several sizes, one with a rare class, one whose single KEEP row leaves a fold without its class."""
    rng = np.random.default_rng(3)
    rows = []
    for sid, n, keep in (("a", 300, 150), ("b", 90, 9), ("c", 40, 1), ("d", 700, 350)):
        for i in range(n):
            label = int(i < keep)
            rows.append((sid, f"{sid}{i}", label, [float(x) for x in rng.normal(0.4 * label, 1.0, 70)]))
    return spark.createDataFrame(rows, "session_id string, pk string, label int, features array<double>")


def weights(models):
    return {(r["session_id"], r["rep"], r["fold"]): (np.append(r["coef"], r["intercept"]), r["n_train"], r["n_keep"]) for r in models.collect()}


def alike(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        assert a[k][1:] == b[k][1:] and np.abs(a[k][0] - b[k][0]).max() < 1e-6


@pytest.mark.parametrize("local_rows", [0, 100])
def test_distributed_steps_fit_the_same_models(spark, local_rows, monkeypatch):
    """Sessions over several tasks, Hessians in several bands, several waves: the weights of fitting in one task."""
    monkeypatch.setattr(tr, "WAVE_BYTES", 2 * 6 * 71 * 8)
    p = ApplyParams(n_splits=3, n_repeats=2)
    folded = tr.with_folds(mixed_sessions(spark), p).repartition(6).cache()
    one = weights(tr.kfold_models(folded, p))
    alike(weights(tr.kfold_models(folded, replace(p, local_rows=local_rows))), one)
    assert ("c", 1, 0) not in one and len(one) == 3 * 6 + 4  # the fold that holds the single row has no model
    full = tr.train(mixed_sessions(spark), p).withColumn("rep", F.lit(1)).withColumn("fold", F.lit(-1))
    many = tr.train(mixed_sessions(spark), replace(p, local_rows=local_rows)).withColumn("rep", F.lit(1)).withColumn("fold", F.lit(-1))
    alike(weights(many), weights(full))


def test_every_labelled_row_is_held_out_once_per_repeat(spark):
    rare = gaussians(spark).where("label = 1 OR pk < 12")
    pools = [tr.kfold_pool(rare, ApplyParams(n_splits=2, n_repeats=2, local_rows=n)).collect() for n in (0, 5000)]
    for pool in pools:
        assert len(pool) == 2 * 106 == len({(r["rep"], r["pk"]) for r in pool})
        assert all((r["label"] == 1) == (r["p_keep"] > 0.5) for r in pool)
    got, want = ({(r["rep"], r["pk"]): r["p_keep"] for r in pool} for pool in pools)
    assert got.keys() == want.keys() and all(abs(want[i] - got[i]) < 1e-6 for i in want)


def test_vectors_are_not_copied_per_repeat(spark):
    """No plan that shuffles vectors has repeats in it: folds are drawn on keys."""
    folded = tr.with_folds(mixed_sessions(spark), ApplyParams())
    assert folded.count() == mixed_sessions(spark).count() and folded.select(F.size("folds").alias("n")).distinct().collect() == [(5,)]


def test_kfold_pool(spark):
    frame = gaussians(spark)
    p = ApplyParams(n_splits=5, n_repeats=2)
    pool = tr.kfold_pool(frame, p).cache()
    assert pool.count() == 400
    assert pool.where("label = 1").agg(F.avg("p_keep")).first()[0] > 0.8
    assert pool.where("label = 0").agg(F.avg("p_keep")).first()[0] < 0.2


def test_folds_equal_fits_on_the_other_folds(spark):
    frame = gaussians(spark, 60)
    p = ApplyParams(n_splits=3, n_repeats=1)
    folds = tr.kfold_assign(frame, 3, 1, p.seed).cache()
    for k in range(3):
        model = tr.train(folds.where(F.col("fold") != k)).first()
        held = folds.where(F.col("fold") == k)
        want = {r["pk"]: 1 / (1 + np.exp(-(np.dot(r["features"], model["coef"]) + model["intercept"]))) for r in held.collect()}
        got = {r["pk"]: r["p_keep"] for r in tr.kfold_pool(frame, p).where(F.col("fold") == k).collect()}
        assert want.keys() == got.keys() and all(abs(want[i] - got[i]) < 1e-9 for i in want)


def test_no_anchor_loses_rows(spark, vecs, sf_dir):
    """More admissions than the budget of the reference, none of them dropped unless a budget is set."""
    one = t.anchors(spark, sf_dir).limit(1)
    wide = placed(spark, sf_dir).limit(1).withColumn("radius", F.lit(2.0))
    corpus = spark.range(210_000).select(F.col("id").alias("pk")).crossJoin(one.select(F.col("chunk").alias("dense")))
    rows, budget = phases.attributed_pass(wide, corpus)
    assert rows.count() == 210_000 and budget.first()["admitted"] == 210_000 and not budget.first()["budget_exhausted"]


def test_no_exchange_of_the_corpus(spark, sf_dir, vecs):
    joined = hv.radius_join(placed(spark, sf_dir), vecs, max_rows=3)
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == hv.radius_join(placed(spark, sf_dir), vecs).count()


def test_no_term_meets_its_queries_in_one_task(spark):
    rows = spark.range(3000).select(F.col("id").alias("pk"), F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 50))).alias("term"), (1.0 + F.col("id") % 7).alias("weight"))
    q = spark.createDataFrame([(1, "the", 2.0), (1, "w3", 1.0), (2, "the", 0.5), (3, "w9", 1.0), (3, "none", 1.0)], "query_id long, term string, query_weight double")
    cut_rows, asked = rt.sliced_terms(rows, q, 100)
    sizes = {(r["term"], r["slice"]): r["count"] for r in cut_rows.groupBy("term", "slice").count().collect()}
    assert max(sizes.values()) < 200 and len([k for k in sizes if k[0] == "the"]) == 30
    assert {(r["query_id"], r["slice"]) for r in asked.where("term = 'the'").collect()} == {(i, k) for i in (1, 2) for k in range(30)}
    wanted = q.withColumnRenamed("query_weight", "weight")
    same(rt.sparse_topk_postings(rows, wanted, 20), rt.sparse_topk_postings(rows, wanted, 20, slice_rows=100, broadcast_bytes=0))


def test_no_product_of_query_and_posting_moves(spark):
    """postings are gathered by key and meet the queries in the task; whole and broken weights give the same hits."""
    rows = spark.range(400).select(F.col("id").alias("pk"), F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 50), F.concat(F.lit("v"), F.col("id") % 7))).alias("term"), (1.0 + F.col("id") % 7).alias("weight"))
    q = spark.range(40).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id")), F.concat(F.lit("v"), F.col("id") % 7))).alias("term"), F.lit(2.0).alias("weight"))
    found = rt.sparse_topk_postings(rows, q, 9, slice_rows=100, broadcast_bytes=0)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    met = rows.join(q.withColumnRenamed("weight", "qw"), "term").groupBy("query_id", "pk").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    want = rt._top(met, 9).select("query_id", F.lit("sparse").alias("path"), "pk", "score", "rank")
    same(want, found)
    same(want, rt.sparse_topk_postings(rows, q, 9))
    same(want, rt.sparse_topk_postings(rows.withColumn("weight", F.col("weight") / 4), q, 9).withColumn("score", F.col("score") * 4))


def test_words_are_counted_where_they_stand(spark):
    """Vectors of texts need no shuffle, except where a key is repeated."""
    from cohortweave.functions import text

    texts = spark.createDataFrame([(1, "b a, B c"), (2, None), (3, " 12 "), (4, "z")], "pk long, body string")
    got = rt.term_vectors(texts, "pk", text.terms(F.col("body")))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pk, list(r.terms), list(r.weights)) for r in got.collect()) == [(1, ["a", "b", "c"], [1.0, 2.0, 1.0]), (4, ["z"], [1.0])]
    twice = texts.unionByName(spark.createDataFrame([(4, "a z"), (None, "n")], texts.schema))
    got = {r.pk: (list(r.terms), list(r.weights)) for r in rt.term_vectors(twice, "pk", text.terms(F.col("body"))).collect()}
    assert got == {1: (["a", "b", "c"], [1.0, 2.0, 1.0]), 4: (["a", "z"], [1.0, 2.0]), None: (["n"], [1.0])}
    assert rt.posted(rt.term_vectors(texts, "pk", text.terms(F.col("body"))), "pk").count() == 4


def test_closest_rows_without_the_whole_join(spark, vecs, sf_dir, monkeypatch):
    """what is written for a budget is a top per anchor and task, not every admission."""
    a, written = placed(spark, sf_dir).withColumn("radius", F.lit(1.5)), []
    kept = hv.cut
    monkeypatch.setattr(hv, "cut", lambda df: written.append(kept(df)) or written[-1])
    same(hv.cap_hits(hv.radius_join(a, vecs), 5), hv.closest_join(a, vecs.coalesce(1), 5))
    assert written[0].count() <= 5 * a.count()
    same(hv.cap_hits(hv.radius_join(a, vecs), 5), hv.closest_join(a, vecs.repartition(3), 5, max_rows=3))


def test_decoupled_attribution_moves_no_hits(spark, sf_dir):
    """rows are attributed where they are read."""
    from cohortweave.workload.harvest_queries import harvest_attribution_decoupled

    assert "Exchange" not in harvest_attribution_decoupled(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def exchanged(df, column):
    """Whether a shuffle or broadcast of the physical plan carries ``column``."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, todo = False, [plan]
    while todo:
        node = todo.pop()
        if "Exchange" in node.getClass().getSimpleName():
            found |= f"{column}#" in node.output().mkString(" ")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_scoring_moves_no_vectors(spark, sf_dir, vecs):
    """Few rows are broadcast to the vectors, many go to their buckets; a plain join of two large tables would move them."""
    rows = spark.range(40).select(F.lit("s").alias("session_id"), F.col("id").alias("pk"), F.lit(0.5).alias("nearest_fit_distance"))
    by_key = laid_out(vecs.select("pk", "dense"), "pk", 8)
    assert lies_by(by_key, "pk") and not lies_by(vecs, "pk") and exchanged(rows.hint("merge").join(vecs, "pk"), "dense")
    few, many, unsorted = md.with_embeddings(rows, vecs), md.with_embeddings(rows, by_key, limit=0), md.with_embeddings(rows, vecs, limit=0)
    for df in (few, many, unsorted):
        assert not exchanged(df, "dense") and df.columns == [*rows.columns, "dense"]
    same(few, many)
    same(few, unsorted)


def test_the_smaller_side_is_hashed(spark):
    """A cohort larger than the vectors streams past their buckets; hashing it would take memory that grows with the cohort."""
    vecs = spark.range(500).select(F.col("id").alias("pk"), F.array_repeat(F.rand(1).cast("float"), 64).alias("dense"))
    by_key = laid_out(vecs, "pk", 8)
    row = lambda n: spark.range(n).select(F.lit("s").alias("session_id"), (F.col("id") % 600).alias("pk"), F.col("id").alias("n"))
    for n, side in ((40, "BuildLeft"), (200_000, "BuildRight")):
        df = md.with_embeddings(row(n), by_key, limit=0)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and side in plan and not exchanged(df, "dense")
        assert df.count() == sum(i % 600 < 500 for i in range(n))


def test_the_cohort_is_written_once(spark, sf_dir, tmp_path):
    """The cohort is read off the attributed rows, not from a second copy; its lines are compressed."""
    rows = cohort(spark, sf_dir)
    assert any("is_anchor" in spark.read.parquet(f).columns for f in rows.inputFiles())
    stores.write_cohort(rows, str(tmp_path / "cohort"))
    assert list((tmp_path / "cohort").glob("*.json.gz")) and not list((tmp_path / "cohort").glob("*.json"))
    assert stores.read_cohort(spark, str(tmp_path / "cohort"), "BIGINT", "BIGINT").count() == rows.count()


def test_exported_texts_are_compressed(spark, tmp_path):
    text = "line one\n\"quoted\", comma\n" + " ".join(f"w{i * 7919 % 1009}" for i in range(500))
    rows = spark.range(1000).select(F.lit("u").alias("user_id"), F.lit("c").alias("counselor_id"), F.lit(text).alias("original_content"), F.lit("KEEP").alias("label"))
    stores.write_export(rows, str(tmp_path / "export"))
    assert sum(f.stat().st_size for f in (tmp_path / "export").glob("part-*")) < 1000 * len(text) / 10
    back = spark.read.csv(str(tmp_path / "export"), header=True, multiLine=True, escape='"')
    assert back.count() == 1000 and [r[0] for r in back.select("original_content").distinct().collect()] == [text]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from cohortweave.session import scratch_root

    conf = {"spark.master": "spark://host:7077"}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: conf.get(k, default)), sparkContext=SimpleNamespace(applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(cluster)
    conf["spark.checkpoint.dir"] = "hdfs://shared/x"
    assert scratch_root(cluster) == "hdfs://shared/x"


def test_one_class_is_an_error(spark):
    with pytest.raises(Exception, match="both KEEP and DROP"):
        tr.train(gaussians(spark).where("label = 1")).collect()
