"""Every stage of the pipeline on its own input: against the operators' SQL, and packing against the tokenizers library."""

import re

import duckdb
import pyarrow as pa
import pytest
from test_packing import check

import corpus_pipeline
from cohortweave.llm import queries, secret_scan
from cohortweave.llm.common import save

SQL = queries.load_all()[1]
WORD = re.compile("[^\x20\x09-\x0d]")


def rows_of(docs):
    return {r["doc_id"]: r.asDict() for r in docs.collect()}


def by_sql(name, docs):
    con = duckdb.connect()
    names = list(next(iter(docs.values())))
    documents = pa.table({c: [d[c] for d in docs.values()] for c in names})
    con.register("documents", documents)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    return {r[columns.index("doc_id")]: dict(zip(columns, r)) for r in cursor.fetchall()}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(save(f(spark, out[-1], sf_dir), "stage"))
    return out


def test_columns(stages):
    assert [s.columns for s in stages[1:5]] == [stages[0].columns] * 4


def test_quality(stages):
    docs = rows_of(stages[0])
    kept = {k for k, r in by_sql("op10_host_rules", docs).items() if r["kept"]}
    got = rows_of(stages[1])
    assert set(got) == kept and all(got[k] == docs[k] for k in kept)


def test_lines(stages):
    docs, got = rows_of(stages[1]), rows_of(stages[2])
    want = by_sql("op7_line_join", docs)
    for k, d in docs.items():
        if k not in got:
            assert want[k]["n_removed"] > 0
        else:
            assert WORD.search(got[k]["text"]) or want[k]["n_removed"] == 0
            assert len(got[k]["text"].split("\n")) == max(1, want[k]["n_lines"] - want[k]["n_removed"])
            assert got[k]["n_chars"] == len(got[k]["text"])
            assert set(got[k]["text"].split("\n")) <= set(d["text"].split("\n"))


def test_near_copies(stages):
    docs, got = rows_of(stages[2]), rows_of(stages[3])
    assert set(got) == {k for k, r in by_sql("op9_metric_jaccard", docs).items() if r["component_id"] == k}
    assert all(got[k] == docs[k] for k in got)


def test_secrets(stages):
    docs, got = rows_of(stages[3]), rows_of(stages[4])
    want = by_sql("op4_credential_links", docs)
    assert set(got) == set(docs)
    for k, d in docs.items():
        text, spans = d["text"], sorted(tuple(map(int, s.split(":")[1:])) for s in want[k]["spans"].split(",") if s)
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [text[at:s], secret_scan.MASK]
                at = e
            elif e > at:
                at = e
        assert got[k]["text"] == "".join(out) + text[at:]


def test_packing(stages):
    texts = {k: r["text"] for k, r in rows_of(stages[4]).items()}
    check(stages[5].collect(), texts)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id", "doc_tokens").count().collect())
    assert len(pieces(corpus_pipeline.run(spark, sf_dir).select(columns))) == len(pieces(stages[5].select(columns)))
