"""Sharded WARC archives: a deterministic writer with manifests, and a reader.

Pages are dealt to shards by ranges of their id (bounds from a sample chosen by a hash of the id, so the same
pages always give the same shards), sorted inside a shard and written as gzip members, a new file beginning when the
compressed size reaches ``roll_bytes``. Headers and digests are made anew. A page whose payload an earlier id
has too becomes a revisit without a payload.

Tasks write below ``_temporary`` under names of their own and report finished files; only reported files are moved to
their final names, and the manifest, written last, lists exactly these. A task that is lost or runs twice leaves
a file that no manifest names.

Defined cases: a null payload is an empty one; a null id comes first, is always a response, and is written with an empty id; repeated
rows of one id and payload after the first revisit that id; control characters and blanks in an address are
percent-encoded; an empty table gives an empty manifest; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import broadcast_measured, save

ID = "urn:x-page"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: At most about so many ids are sampled for the bounds of the shards.
SAMPLE = 100_000

MANIFEST = "shard long, part long, temporary string, path string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


@dataclass(frozen=True)
class Options:
    shard_bytes: int = 32 << 20  # of payload
    roll_bytes: int = 16 << 20  # of a compressed file
    level: int = 6
    least_revisit: int = 0  # payloads of fewer bytes are always written in full
    date: str = "1970-01-01T00:00:00Z"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The shared file system that a task or the driver reaches ``path`` by."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _bounds(narrow: DataFrame, shards: int) -> list[int]:
    total = narrow.count()
    every = max(1, total // SAMPLE)
    ids = narrow.filter((F.pmod(F.xxhash64("id_"), F.lit(every)) == 0) & F.col("id_").isNotNull()).select("id_")
    ids = sorted(r[0] for r in ids.collect())
    return sorted({ids[len(ids) * i // shards] for i in range(1, shards)}) if ids else []


def _shard(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key; two levels, so many shards stay cheap."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    coarse = F.coalesce(below(array([g[0] for g in groups])), F.lit(0))
    fine = F.get(F.array(*[array(g) for g in groups]), coarse - 1)
    return F.when(key.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + below(fine))


def revisits(narrow: DataFrame, least: int) -> DataFrame:
    """(id_, digest_, refers_to_) of pages that have an earlier page's payload; counts before it joins, so that a
    payload of a third of all pages is one row of each task."""
    firsts = narrow.filter(F.col("bytes_") >= least).groupBy("digest_").agg(F.min("id_").alias("refers_to_"), F.count(F.lit(1)).alias("n_"))
    firsts = firsts.filter((F.col("n_") > 1) & F.col("refers_to_").isNotNull()).drop("n_")
    return narrow.join(broadcast_measured(firsts), "digest_").filter(F.col("id_") > F.col("refers_to_")).select("id_", "digest_", "refers_to_").distinct()


class _Writer:
    """Records of one task, in files of one shard at a time."""

    def __init__(self, directory: str, options: Options):
        self.options, self.directory = options, directory
        self.fs, self.root = opened(directory)
        self.own = f"_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/{self.own}", recursive=True)
        self.shard = self.stream = None
        self.done: list[tuple] = []

    def _member(self, headers: list[tuple[str, str]], block: bytes) -> None:
        head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
        gz = zlib.compressobj(self.options.level, zlib.DEFLATED, 31)
        data = gz.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + gz.flush()
        self.stream.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def _open(self, shard: int, part: int) -> None:
        self.shard, self.part, self.records, self.bytes, self.hash = shard, part, 0, 0, hashlib.sha256()
        self.name = f"pages-{shard:06d}-{part:04d}.warc.gz"
        self.stream = self.fs.open_output_stream(f"{self.root}/{self.own}/{self.name}")
        info = b"software: cohortweave\r\nformat: WARC File Format 1.1\r\n"
        self._member(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Date", self.options.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
            info,
        )

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((self.shard, self.part, f"{self.own}/{self.name}", self.name, self.records, self.bytes, self.hash.hexdigest()))
            self.stream = None

    def write(self, shard: int, page_id: int | None, repeat: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> None:
        if self.stream is None or self.shard != shard:
            self.close()
            self._open(shard, 0)
        elif self.bytes >= self.options.roll_bytes:
            part = self.part + 1
            self.close()
            self._open(shard, part)
        http = (HTTP % len(payload)).encode()
        block = http if refers_to is not None else http + payload
        headers = [
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<{ID}:{'' if page_id is None else page_id}:{repeat}>"),
            ("WARC-Date", self.options.date),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ]
        if url is not None:
            headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
        if refers_to is not None:
            headers += [("WARC-Refers-To", f"<{ID}:{refers_to}:0>"), ("WARC-Profile", PROFILE)]
        self._member(headers, block)
        self.records += 1


def write_archive(pages: DataFrame, directory: str, page_id: str = "page_id", url: str = "url", payload: str = "html", options: Options = Options()) -> DataFrame:
    """Write all pages below ``directory`` and return the manifest (also kept there as a table)."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    source = pages.select(F.col(f"`{page_id}`").cast("long").alias("id_"), F.col(f"`{url}`").cast("string").alias("url_"), body.alias("body_"))
    narrow = save(source.select("id_", F.sha1("body_").alias("digest_"), F.octet_length("body_").cast("long").alias("bytes_")), "page_digests")
    total = narrow.agg(F.sum("bytes_")).first()[0] or 0
    shards = max(1, -(-total // options.shard_bytes))
    bounds = _bounds(narrow, shards)
    references = save(revisits(narrow, options.least_revisit), "page_revisits")
    # A page and its reference meet by sorting into the same shard: payloads are shuffled once.
    rows = source.select("id_", F.sha1("body_").alias("digest_"), F.lit(1).alias("kind_"), "url_", "body_", F.lit(None).cast("long").alias("refers_to_"))
    rows = rows.unionByName(references.withColumn("kind_", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumn("shard_", _shard(F.col("id_"), bounds).cast("long"))
    rows = rows.repartitionById(shards, F.col("shard_").cast("int")).sortWithinPartitions("shard_", "id_", "digest_", "kind_", "url_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, last, target, repeat = None, None, None, 0
        seen: set[str] = set()
        for batch in batches:
            columns = [batch.column(n) for n in ("shard_", "id_", "digest_", "kind_", "url_", "body_", "refers_to_")]
            for i in range(batch.num_rows):
                shard, key, digest, kind, url_, body_, refers = (c[i].as_py() for c in columns)
                if (shard, key) != last:
                    last, repeat, seen = (shard, key), 0, set()
                if kind == 0:
                    target = (key, digest, refers)
                    continue
                writer = writer or _Writer(directory, options)
                to = target[2] if target is not None and target[:2] == (key, digest) else None
                if to is None and key is not None and digest in seen and len(body_) >= options.least_revisit:
                    to = key
                writer.write(shard, key, repeat, url_, body_, base64.b32encode(bytes.fromhex(digest)).decode(), to)
                seen.add(digest)
                repeat += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*writer.done)], schema=_arrow(MANIFEST))

    reported = save(rows.mapInArrow(run, MANIFEST), "warc_files")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(directory)
        for batch in batches:
            for temporary, name, size in zip(*(batch.column(n).to_pylist() for n in ("temporary", "path", "bytes"))):
                there, waiting = store.get_file_info([f"{root}/{name}", f"{root}/{temporary}"])
                if waiting.type == fs.FileType.File:
                    store.move(waiting.path, there.path)
                elif there.type != fs.FileType.File or there.size != size:
                    raise FileNotFoundError(f"{name}: neither written nor committed")
            yield batch

    reported.mapInArrow(commit, MANIFEST).write.mode("overwrite").parquet(f"{directory}/manifest")
    store, root = opened(directory)
    if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def members(stream) -> Iterator[bytes]:
    """Decompressed gzip members, one at a time."""
    data = b""
    while data or (data := stream.read(1 << 20)):
        gz, out = zlib.decompressobj(31), []
        while not gz.eof:
            if not data and not (data := stream.read(1 << 20)):
                raise EOFError("the file ends inside a record")
            out.append(gz.decompress(data))
            data = gz.unused_data
        yield b"".join(out)


def parsed(record: bytes) -> tuple | None:
    """A response or revisit as a row of RECORDS; digests and lengths are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    number = lambda urn: int(x) if (x := urn.strip("<>").split(":")[2]) else None
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    refers = number(fields["WARC-Refers-To"]) if revisit else None
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], None if revisit else payload, size, digest, refers


def read_archive(manifest: DataFrame, directory: str, payloads: bool = True) -> DataFrame:
    """Records of the files that the manifest names; one file is one unit of work."""
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(directory)
        schema = _arrow(RECORDS)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}") as stream:
                    for record in members(stream):
                        row = parsed(record)
                        if row is None:
                            continue
                        rows.append(row if payloads else (*row[:3], None, *row[4:]))
                        held += len(record)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(run, RECORDS)


def new_directory(spark: SparkSession) -> str:
    """A fresh folder for an archive in the shared folder."""
    return scratch_path(spark, "warc")
