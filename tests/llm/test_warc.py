"""Archives: exact round trips, revisits, rolling, recovery, awkward rows."""

import os

from cohortweave.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, path string, shard_ int")


def run(spark, df, **options):
    directory = warc.new_directory(spark)
    manifest = warc.write_archive(df, directory, options=warc.Options(**options))
    return directory, manifest, warc.read_archive(manifest, directory).collect()


def test_round_trip_revisits_and_rolling(spark):
    body = {i: f"<p>{i % 7} {'x' * (i % 7 * 300)}</p>" for i in range(200)}
    df = pages(spark, [(i, f"http://a/{i}", b, "p", i) for i, b in body.items()]).repartition(7)
    directory, manifest, rows = run(spark, df, shard_bytes=20_000, roll_bytes=1_500)
    assert {r["page_id"] for r in rows} == set(body) and len(rows) == 200
    for r in rows:
        first = r["page_id"] % 7
        assert r["payload_bytes"] == len(body[r["page_id"]]) and r["payload_digest"] == warc.digest_of(body[first].encode())
        if r["page_id"] < 7:
            assert r["record_type"] == "response" and r["payload"].decode() == body[r["page_id"]] and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first and r["payload"] is None
    assert manifest.count() > 3
    _, root = warc.opened(directory)
    assert not os.path.exists(f"{root}/_temporary")
    again = run(spark, df.repartition(3), shard_bytes=20_000, roll_bytes=1_500)[1]
    plain = lambda m: sorted((r["path"], r["sha256"]) for r in m.collect())
    assert plain(manifest) == plain(again)


def test_awkward_rows(spark):
    rows = [(None, None, None, None, None), (None, "u\r\nX: y", "a", None, None), (5, "é 漢", "a", None, None), (5, "é 漢", "a", None, None), (5, "v", "b\r\n\r\nc", None, None), (9, None, "", None, 1), (8, None, None, None, 1)]
    _, _, got = run(spark, pages(spark, rows))
    seen = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=repr)
    assert seen == sorted([(None, "response", None, 0), (None, "response", None, 1), (5, "response", None, 1), (5, "revisit", 5, 1), (5, "response", None, 6), (9, "revisit", 8, 0), (8, "response", None, 0)], key=repr)
    _, manifest, got = run(spark, pages(spark, []))
    assert got == [] and manifest.count() == 0


def test_least_revisit(spark):
    _, _, got = run(spark, pages(spark, [(1, None, "aa", None, None), (2, None, "aa", None, None), (3, None, "aaaa", None, None), (4, None, "aaaa", None, None)]), least_revisit=3)
    assert {r["page_id"]: r["record_type"] for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_stray_files_of_lost_tasks_are_ignored(spark):
    directory = warc.new_directory(spark)
    store, root = warc.opened(directory)
    store.create_dir(f"{root}/_temporary/lost", recursive=True)
    with store.open_output_stream(f"{root}/_temporary/lost/pages-000000-0000.warc.gz") as out:
        out.write(b"half a file")
    manifest = warc.write_archive(pages(spark, [(1, "u", "x", None, None)]), directory)
    assert [r["page_id"] for r in warc.read_archive(manifest, directory).collect()] == [1]
