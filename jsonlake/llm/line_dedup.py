"""Line dedup on levelled sorted runs of line hashes.

Texts are read once to hash their lines: one stored row per document and distinct
key, with the line numbers of the key, dealt into batches by a hash of doc_id.

Runs are tables bucketed and sorted by line hash. A batch's lines are summed by
hash and merge-anti-joined with every run: the lines that no run holds become a
new run of level 0 with their counts, so a hash stands in exactly one run. The
lines that a run holds already go, as increments, to a table of their own. A
level that holds ``fanout`` runs is compacted into one run of the next level, one
file a bucket. As all tables share their buckets, the anti-joins do not shuffle
runs; compactions do, a line once a level, and so do the sums at the end.

The number of documents of a line is the count of its entry plus its increments.
A line of ``min_docs`` or more documents goes from all of them except the one
with its largest doc_id.

Only hashes, ids and line numbers are shuffled to find the lines; counting is a
partial aggregation, so a line that a third of all rows hold is summed before the
shuffle, and the join that brings counts back to documents can be split (AQE).
Everything lives in the shared checkpoint folder, so a lost executor loses
nothing.

There are at least ``LEAST`` batches, so that runs are compacted over two levels
however small the input is, and one for each ``batch_bytes`` beyond that. From
``MOST`` on batches grow instead: each reads the keys of all runs, so work would
else grow with the square of the input. No row is left out by either bound.

Edge cases: a null or empty text is one empty line and stays (a null text comes
back as the empty text); keys shorter than ``min_chars`` always stay; lines that
repeat within a document count once and go together; rows that repeat a doc_id
are one document for the counts, and each loses its own lines. A null doc_id is
no document for the counts and keeps all its lines. All other columns pass
through untouched; columns named ``__n_lines`` or ``__n_dropped`` are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, remove_dir, stored, work_dir

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = {c: c + 32 for c in range(65, 91)}
KEY = ["h1", "h2"]
#: Parts of a batch's stored lines.
SLICES = 64
FANOUT = 4
#: Batches, unless the caller says how many: two and three full levels.
LEAST, MOST = FANOUT**2, FANOUT**3


def line_key(line: str) -> str:
    """The line without white space at both ends, A-Z lower-cased."""
    return line.strip(BLANK).translate(_LOWER)


def keyed_lines(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """doc_id, row (hash of the text), batch, h1, h2, at: line numbers of each distinct long key of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in parts:
            for start in range(0, whole.num_rows, 2000):
                part = whole.slice(start, 2000)
                owner, low, high, at, ends = [], [], [], [], [0]
                for i, x in enumerate(part.column("text")):
                    own: dict[bytes, list[int]] = {}
                    for k, line in enumerate((x.as_py() or "").split("\n")):
                        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                            own.setdefault(key.encode("utf-8", "surrogatepass"), []).append(k)
                    for key, places in own.items():
                        h = xxhash.xxh3_128_intdigest(key)
                        owner.append(i)
                        low.append(h & 0xFFFFFFFFFFFFFFFF)
                        high.append(h >> 64)
                        at += places
                        ends.append(len(at))
                signed = lambda v: pa.array(v, pa.uint64()).view(pa.int64())
                took = pa.array(owner, pa.int64())
                columns = [*(part.column(c).take(took) for c in ("doc_id", "row", "batch")), signed(low), signed(high), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "batch", "h1", "h2", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, batch int, h1 bigint, h2 bigint, at array<int>")


class LineIndex:
    """Levelled sorted runs in a shared folder: h1, h2, n (documents when it was new), top (largest doc_id)."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        #: Tables of increments: h1, h2, n, top.
        self.more: list[str] = []
        self.tag, self.made = uuid.uuid4().hex[:12], 0

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, df: DataFrame) -> str:
        """A table bucketed and sorted by hash; ``df`` is dealt by hash already or will be."""
        name = f"line_run_{self.tag}_{self.made:05d}"
        self.made += 1
        dealt = df.select(*KEY, "n", "top").repartition(self.buckets, *KEY)
        dealt.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_dir(self.spark, f"{self.folder}/{name}")

    def _union(self, names: list[str]) -> DataFrame:
        """The tables one after another.

        Spark takes a union of plain scans of equally bucketed tables for bucketed, but runs it columnar,
        partition after partition: sums would be split and joins fail. With a filter, which no row fails,
        the union counts as not bucketed, so sums and joins shuffle it.
        """
        out = None
        for name in names:
            rows = self.spark.table(name).where(F.col("h1").isNotNull())
            out = rows if out is None else out.unionByName(rows)
        return out

    def add(self, batch: DataFrame) -> None:
        """``batch``: h1, h2, n, top, one row per line. Its new lines become a run, the others increments."""
        runs = self.runs()
        if not runs:
            self._place(self._write(batch), 0)
            return
        own = self._write(batch)
        fresh = self.spark.table(own)
        for name in runs:
            fresh = fresh.join(self.spark.table(name).select(*KEY), KEY, "left_anti")
        new = self._write(fresh)
        # What is not new is known: the runs are read once for both.
        self.more.append(self._write(self.spark.table(own).join(self.spark.table(new).select(*KEY), KEY, "left_anti")))
        self._place(new, 0)
        self._drop([own])
        if len(self.more) >= self.fanout:
            merged = self._write(_sums(self._union(self.more)))
            self._drop(self.more)
            self.more = [merged]

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._write(_sums(self._union(old)))
            self.levels[level] = []
            self._place(merged, level + 1)
            self._drop(old)

    def counts(self) -> DataFrame | None:
        """h1, h2, n, top of every line: its entry and its increments."""
        if not self.levels:
            return None
        entries = self._union(self.runs())
        if not self.more:
            return entries
        added = _sums(self._union(self.more)).select(*KEY, F.col("n").alias("__n"), F.col("top").alias("__top"))
        both = entries.join(added, KEY, "left")
        return both.select(*KEY, (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"), F.greatest("top", "__top").alias("top"))

    def close(self) -> None:
        self._drop([*self.runs(), *self.more])
        self.levels, self.more = [], []


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of a table; 0 if it has none."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(int(str(size)), 1 << 62)


def batches_for(docs: DataFrame, batch_bytes: int) -> int:
    """One batch for each ``batch_bytes`` of the input, within LEAST and MOST; LEAST for an unknown size."""
    size = input_bytes(docs)
    return max(LEAST, min(MOST, -(-size // batch_bytes))) if size < 1 << 61 else LEAST


def build_index(lines: DataFrame, folder: str, batches: int, fanout: int = FANOUT) -> LineIndex:
    """Index of stored ``lines`` (the columns of ``keyed_lines``), batch after batch."""
    index = LineIndex(lines.sparkSession, folder, fanout)
    for b in range(batches):
        # A document counts once for a line, however many rows it has; all of them are in one batch.
        own = lines.where(F.col("batch") == b).select("doc_id", *KEY).distinct()
        index.add(own.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")))
    return index


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, batch_bytes: int = 1 << 30) -> DataFrame:
    """``docs`` with the text reduced to its kept lines, plus ``__n_lines`` and ``__n_dropped``."""
    if {"__n_lines", "__n_dropped"} & set(docs.columns):
        raise ValueError("columns __n_lines and __n_dropped are results")
    spark, names = docs.sparkSession, docs.columns
    folder = work_dir(spark, "lines")
    batches = batches or batches_for(docs, batch_bytes)
    found = keyed_lines(docs, min_chars, batches)
    # A batch's rows are brought together first, in SLICES parts, so that the number of files does not grow with tasks x batches.
    found.repartition("batch", F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.lit(SLICES))).write.partitionBy("batch").parquet(f"{folder}/keys")
    lines = spark.read.schema(found.schema).parquet(f"{folder}/keys")
    index = build_index(lines, f"{folder}/runs", batches)
    counts = index.counts().where(F.col("n") >= min_docs)
    common = stored(counts.select(F.col("h1").alias("__a"), F.col("h2").alias("__b"), "top"), f"{folder}/common")
    index.close()
    gone = lines.join(common, (F.col("h1") == F.col("__a")) & (F.col("h2") == F.col("__b")) & (F.col("doc_id") != F.col("top")))
    # Equal rows give their line numbers once each.
    gone = gone.groupBy("doc_id", "row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("__gone"))
    doc, row, key, cells, cut = (free(names, n) for n in ("__doc", "__row", "__key", "__lines", "__cut"))
    gone = stored(gone.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("__gone").alias(cut)), f"{folder}/gone")
    remove_dir(spark, f"{folder}/keys")
    remove_dir(spark, f"{folder}/common")
    joined = docs.select(*names, F.xxhash64("text").alias(key)).join(gone, (F.col("doc_id") == F.col(doc)) & (F.col(key) == F.col(row)), "left")
    joined = joined.withColumn(cells, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    # What lies between two dropped lines stays: linear in the lines, whatever is dropped.
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(cut, k - 1) + 1)
    after = lambda k: F.coalesce(F.get(cut, k), F.size(cells))
    spans = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda k: F.slice(cells, before(k) + 1, after(k) - before(k)))
    kept = F.when(F.col(cut).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(spans), "\n"))
    out = joined.withColumn("__n_lines", F.size(cells).cast("long")).withColumn("__n_dropped", F.coalesce(F.size(cut), F.lit(0)).cast("long"))
    return out.select(*(kept.alias("text") if c == "text" else F.col(c) for c in names), "__n_lines", "__n_dropped")
