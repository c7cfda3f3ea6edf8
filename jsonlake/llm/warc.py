"""Deterministic sharded WARC writer and reader.

Records are range-sorted by an integer key. Shard limits come from a histogram
of payload bytes over the key range, refined where buckets are too full, so they
depend on the data only and not on how Spark deals it out. Each task writes the
files of its shards: one gzip member per record, a new file as soon as the
compressed size passes ``roll_bytes``. Headers, lengths and digests are made
anew. A file is written under a temporary name and then renamed; every shard
ends with a manifest, and a Parquet table of all files, written last, commits
the whole. A task that runs again writes the same bytes under the same names, so
its rename may replace the file of an earlier attempt (the file system must allow
that, as local and object stores do); what dead attempts left under temporary
names is removed after the commit.

Records whose payloads are equal, of at least ``min_revisit_bytes`` bytes: the
one with the smallest key is a response, the others are revisits of it.

Payloads cross one shuffle. The map from copies to their first record holds
digests and keys only and joins the payload rows by a sort within the shard.

Edge cases: null html is an empty payload; a null url is written as ``urn:none``
and read back as null; line breaks in a url are percent-encoded. Rows with a
null key are not written. If a key repeats, its rows with equal payloads are one
response and revisits of it. All rows of one key are in one shard. An empty
table gives an archive without files. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove_dir, remove_matching, stored

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_TYPE = "shard int, file string, n_records bigint, bytes bigint, first_key bigint, last_key bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{copy}')}>"


def make_record(key: int, copy: int, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC record, not compressed. ``first``: the key of the record that this one revisits."""
    uri = "urn:none" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, 0)}", f"X-Refers-To-Key: {first}"]
    head += [f"X-Key: {key}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Shards are as large as it takes to need no more than so many.
MOST_SHARDS = 100_000


def _place_in(sent):
    """Of a key: the first key of its range and of its bucket there, for the broadcast (first, last, width) of the ranges."""

    @F.pandas_udf(T.StructType([T.StructField("range", T.LongType()), T.StructField("first", T.LongType())]))
    def place(keys: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lows, highs, widths = sent.value
        for k in keys:
            k = k.to_numpy()
            at = np.maximum(np.searchsorted(lows, k, side="right") - 1, 0)
            low, width = lows[at], widths[at]
            # Differences of keys as unsigned numbers: they may be beyond the signed range.
            first = low + ((k.view(np.uint64) - low.view(np.uint64)) // width.view(np.uint64)).view(np.int64) * width
            inside = (k >= low) & (k <= highs[at])
            yield pd.DataFrame({"range": pd.Series(low).astype("Int64"), "first": pd.Series(first).astype("Int64").where(inside)})

    return place


def shard_limits(sizes: DataFrame, target: int, buckets: int = 2048) -> list[int]:
    """Ascending first keys of the shards after the first. ``sizes``: key, bytes, stored.

    A histogram over the key range; all of its buckets that are too full are refined together, in one job a level,
    so the number of jobs depends on how unevenly keys lie and not on the size of the input. The sums that come to
    the driver number some four a shard.
    """
    span = sizes.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("bytes").alias("n")).first()
    if span.lo is None:
        return []
    target = max(target, span.n // MOST_SHARDS)
    # Ranges to look into: first key, last key, width of their buckets.
    active = [(span.lo, span.hi, max(1, -(-(span.hi - span.lo + 1) // buckets)))]
    found: list[tuple[int, int]] = []
    while active:
        width_of = {first: (last, width) for first, last, width in active}
        lows, highs, widths = (np.array(c, dtype=np.int64) for c in zip(*sorted(active), strict=True))
        sent = sizes.sparkSession.sparkContext.broadcast((lows, highs, widths))
        rows = sizes.select(_place_in(sent)("key").alias("p"), "bytes").where("p.first IS NOT NULL").groupBy("p.range", "p.first").agg(F.sum("bytes").alias("n")).collect()
        active = []
        for r in rows:
            last, width = width_of[r.range]
            if r.n > 2 * target and width > 1:
                last = min(last, r.first + width - 1)
                parts = min(buckets, max(16, 4 * r.n // target))
                active.append((r.first, last, max(1, -(-(last - r.first + 1) // parts))))
            else:
                found.append((r.first, r.n))
    limits, filled = [], 0
    for first, n in sorted(found):
        if filled and filled + n > target:
            limits.append(first)
            filled = 0
        filled += n
    return limits


class _Shard:
    """Writes the files of one shard."""

    def __init__(self, fs, folder: str, shard: int, roll_bytes: int):
        self.fs, self.folder, self.shard, self.roll = fs, folder, shard, roll_bytes
        self.seq, self.out, self.files = 0, None, []

    def add(self, key: int, record: bytes, level: int) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.folder}/_temporary-{uuid.uuid4().hex}"
            self.out, self.size, self.n, self.first = self.fs.open_output_stream(self.temp, compression=None), 0, 0, key
        member = gzip.compress(record, level, mtime=0)
        self.out.write(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, key
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.folder}/{self.name}")
            self.files.append((self.shard, self.name, self.n, self.size, self.first, self.last))
            self.seq, self.out = self.seq + 1, None

    def finish(self) -> list[tuple]:
        self.close()
        temp = f"{self.folder}/_temporary-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as f:
            f.write(json.dumps([dict(zip(("shard", "file", "records", "bytes", "first", "last"), x, strict=True)) for x in self.files], indent=1).encode())
        self.fs.move(temp, f"{self.folder}/part-{self.shard:06d}.manifest.json")
        return self.files


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, min_revisit_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write all rows below ``folder`` (a URI that all machines can open); returns the committed table of files."""
    from pyarrow import fs as pafs

    spark = pages.sparkSession
    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    facts = stored(rows.select("key", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("bytes")), f"{folder}/facts")
    limits = np.array(shard_limits(facts.select("key", (F.col("bytes") + 400).alias("bytes")), shard_bytes), dtype=np.int64)
    sent = spark.sparkContext.broadcast(limits)

    @F.pandas_udf(T.IntegerType())
    def shard_of(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(np.searchsorted(sent.value, k.to_numpy(), side="right").astype(np.int32))

    shared = facts.where(F.col("bytes") >= min_revisit_bytes)
    firsts = shared.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copies = shared.join(firsts, "digest").select("key", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first")
    whole = rows.select("key", F.lit(1).alias("tag"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"))
    every = copies.distinct().unionByName(whole).withColumn("shard", shard_of("key"))
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{base}/data", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        out: _Shard | None = None
        at, first_of, written, copy = None, {}, set(), 0
        done: list[tuple] = []
        for batch in batches:
            names = ("shard", "key", "tag", "url", "html", "digest", "first")
            for row in zip(*(batch.column(c) for c in names), strict=True):
                shard, key, tag, url, html, digest, first = (x.as_py() for x in row)
                if out is None or out.shard != shard:
                    done += out.finish() if out else []
                    out, at = _Shard(fs, f"{base}/data", shard, roll_bytes), None
                if key != at:
                    at, first_of, written, copy = key, {}, set(), 0
                if tag == 0:
                    first_of[digest] = first
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                raw = hashlib.sha1(payload).digest()
                own = raw.hex()
                first = first_of.get(own)
                refers = None if first is None or (first == key and own not in written) else first
                written.add(own)
                out.add(key, make_record(key, copy, url, payload, base64.b32encode(raw).decode(), refers, date), level)
                copy += 1
        done += out.finish() if out else []
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "n_records", "bytes", "first_key", "last_key"), x, strict=True)) for x in done], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]))

    # Task k holds shard k and no other.
    sorted_ = every.repartitionById(len(limits) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "tag", "url", "html")
    sorted_.mapInArrow(run, FILE_TYPE).write.mode("overwrite").parquet(f"{folder}/manifest")
    remove_dir(spark, f"{folder}/facts")
    remove_matching(spark, f"{folder}/data/_temporary-*")
    return spark.read.schema(FILE_TYPE).parquet(f"{folder}/manifest")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a record is cut short")
        yield head, block


RECORD_TYPE = "key bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, file string"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of a committed archive, digests of blocks and payloads checked while reading."""
    files = spark.read.schema(FILE_TYPE).parquet(f"{folder}/manifest").select("file", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        kind = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/data/{name}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as text:
                    for head, block in parse_records(text):
                        if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"block digest of {head['warc-record-id']} in {name}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and (digest != base32_sha1(payload) or length != len(payload)):
                            raise ValueError(f"payload digest of {head['warc-record-id']} in {name}")
                        uri = head["warc-target-uri"]
                        rows.append((int(head["x-key"]), None if uri == "urn:none" else uri, head["warc-type"], payload if with_payload and not revisit else None, length, digest, int(head["x-refers-to-key"]) if revisit else None, name))
                        size += len(block) + 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return files.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file").mapInArrow(run, RECORD_TYPE)
