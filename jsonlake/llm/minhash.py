"""MinHash near-dedup with min-max hashing.

A document is the set of its distinct 5-word shingles (one shingle of all its
words if it has fewer). Under each of ``perms`` hash permutations both the
minimum and the maximum are kept, so half as many evaluations give the
signature. ``bands`` of ``rows`` values each make bucket keys.

Documents with equal sets become one representative. Candidates come from the
buckets without listing their pairs: in two star rounds every document is
compared with one centre of its buckets (the smallest, then the largest id that
is not yet in its component), which joins large groups of near copies at a cost
linear in their size. A last round takes the buckets that still hold several
components and compares all their members across components, in pairs of blocks
of ``BLOCK`` documents, by sparse products of the full sets; it returns links
that join components, not pairs. So no candidate link between components is
lost. Every link is confirmed on the full shingle sets, made again from the
whole texts.

With perms=48 and 24 bands of 4 values a pair of large sets of similarity 0.75
shares a bucket with probability 0.9999. In small sets minimum and maximum depend
on each other, so sets of few shingles have exact buckets as well: any two sets of
similarity 0.75 share one of their first n - ceil(0.75 n) + 1 shingles in hash
order, and each of these is a bucket for sets of up to ``SMALL`` / 0.75 shingles.
No pair with a set of at most ``SMALL`` shingles is lost.

Counts by bucket are stored before they are joined back, so the join of a bucket
that very many documents hold can be split (AQE). Blocks are bounded by documents
and by their shingles.

Edge cases: null or blank texts have an empty set, link with nothing and are
kept; case differs only in A-Z; null doc_id rows are ignored for links, have no
component and are kept. Rows that repeat a doc_id are one node; if their texts
differ, the smallest text is the one that candidates are confirmed on. Other
columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, remove_dir, stored, work_dir
from .components import merge_components, roots_of

SHINGLE = 5
PERMS, BANDS, ROWS = 48, 24, 4
BLOCK = 1024
#: Sets of so many shingles have exact buckets.
SMALL = 16
#: Shingles of a block of documents.
BLOCK_SHINGLES = 2_000_000
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE[_IS_SPACE] = 0
_P = 0xA0761D6478BD642F | 1
_P_INV = pow(_P, -1, 1 << 64)
_MUL = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_BAND = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    for k, base in enumerate((_P, _P_INV)):
        have = _POWERS[k]
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[k] = have
    return _POWERS[0], _POWERS[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    word = ~_IS_SPACE[raw]
    starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = len(raw)
    with np.errstate(over="ignore"):
        up, down = _powers(n)
        sums = np.add.reduceat(_VALUE[raw] * up[:n], starts)
        words = _mix(sums * down[starts])
        if len(words) < SHINGLE:
            return _mix(np.array([sum(int(w) * int(m) for w, m in zip(words, _MUL, strict=False)) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64) + np.uint64(len(words)))
        m = len(words) - SHINGLE + 1
        total = words[:m] * _MUL[0]
        for k in range(1, SHINGLE):
            total = total + words[k : k + m] * _MUL[k]
        return np.unique(_mix(total))


def signature(s: np.ndarray, step: int = 4096) -> np.ndarray:
    """Minimum and maximum of the set under each permutation: PERMS x 2 values."""
    low = np.full(PERMS, np.uint64(0xFFFFFFFFFFFFFFFF))
    high = np.zeros(PERMS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), step):
            h = s[i : i + step, None] * _A + _B
            low = np.minimum(low, h.min(axis=0))
            high = np.maximum(high, h.max(axis=0))
    return np.stack([low, high], axis=1)


def bands(sig: np.ndarray) -> np.ndarray:
    v = sig.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        return _mix((_mix(v) * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def prefix(s: np.ndarray, share: int) -> np.ndarray:
    """The shingles of a small set of which it shares one with any set that is similar enough; none for a large set."""
    n = len(s)
    if not n or n * share > SMALL * 100:
        return np.zeros(0, dtype=np.int64)
    return s[: n - -(-share * n // 100) + 1].view(np.int64)


def sketches(docs: DataFrame, share: int = 75) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (128-bit fingerprint of the set; null: empty set), bands (and then the prefix of a small set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 2000):
                batch = whole.slice(at, 2000)
                n, f1, f2, keys, ends = [], [], [], [], [0]
                for x in batch.column("text"):
                    s = shingles(x.as_py())
                    n.append(len(s))
                    if len(s):
                        d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                        f1.append(int(d[0]))
                        f2.append(int(d[1]))
                        keys.append(np.concatenate([bands(signature(s)), prefix(s, share)]))
                    else:
                        f1.append(None)
                        f2.append(None)
                    ends.append(ends[-1] + (len(keys[-1]) if len(s) else 0))
                flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, share: int, chunk: int = 64) -> DataFrame:
    """Of pairs (a, b) of ids, those with 100 * intersection >= share * union. ``texts``: doc_id, text.

    The texts of at most ``chunk`` partners travel to a task together with the
    one text of their centre ``a``, so a centre with very many partners is
    spread over tasks and no set is stored.
    """
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    dealt = pairs.join(sized, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    members = dealt.join(texts, dealt["b"] == texts["doc_id"]).select("a", "part", "b", "text")
    centres = dealt.select("a", "part").distinct().join(texts, F.col("a") == texts["doc_id"]).select("a", "part", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, part, b, text in zip(*(batch.column(c) for c in ("a", "part", "b", "text")), strict=True):
                a, part, b = a.as_py(), part.as_py(), b.as_py()
                if (a, part) != group:
                    group, centre = (a, part), None
                s = shingles(text.as_py())
                if b is None:
                    centre = s
                elif centre is not None:
                    small, large = sorted((len(s), len(centre)))
                    if 100 * small >= share * large:
                        both = len(np.intersect1d(s, centre, assume_unique=True))
                        if 100 * both >= share * (small + large - both):
                            out_a.append(a)
                            out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, batch.schema.field("a").type), pa.array(out_b, batch.schema.field("b").type)], ["a", "b"])

    together = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return together.mapInArrow(run, f"a {kind}, b {kind}")


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections. Shingles of one set only are left out; the others are multiplied in slices."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float32)
    flat = np.concatenate(sets)
    docs = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count > 1
    column = (np.cumsum(often) - 1)[inverse]
    held = often[inverse]
    column, docs = column[held], docs[held]
    order = np.argsort(column, kind="stable")
    column, docs = column[order], docs[order]
    total = int(often.sum())
    for c in range(0, total, width):
        a, b = np.searchsorted(column, [c, min(c + width, total)])
        rows, local = np.unique(docs[a:b], return_inverse=True)
        m = np.zeros((len(rows), width), dtype=np.float32)
        m[local, column[a:b] - c] = 1
        out[np.ix_(rows, rows)] += m @ m.T
    return out


def block_roots(sets: list[np.ndarray], comps: np.ndarray, side: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different components of one pair of blocks, as (row, root row) of a spanning forest.

    side: 0 and 1 for rows of two different blocks, all 2 within one block.
    """
    size = np.array([len(s) for s in sets], dtype=np.float64)
    both = shared_counts(sets).astype(np.float64)
    link = 100 * both >= share * (size[:, None] + size[None, :] - both)
    link &= comps[:, None] != comps[None, :]
    if (side != 2).all():
        link &= side[:, None] != side[None, :]
    rows = np.flatnonzero(link.any(axis=1))
    root = np.arange(len(rows))
    own = link[np.ix_(rows, rows)]
    while len(rows):
        new = np.minimum(root, np.where(own, root[None, :], len(rows)).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(rows))
    return rows[moved], rows[root[moved]]


def remaining_links(buckets: DataFrame, comps: DataFrame, texts: DataFrame, share: int, block: int, folder: str) -> DataFrame:
    """Links (a, b) between components that share a bucket; every pair across components is compared."""
    placed = with_component(buckets, comps, f"{folder}/third")
    least = F.greatest(F.count("*") / block, F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = stored(placed.groupBy("band", "key").agg(F.ceil(least).cast("int").alias("blocks")), f"{folder}/sizes")
    dealt = placed.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp")
    keys = ["band", "key", "i", "j"]
    kind = buckets.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> tuple[list, list]:
            i, j = held[0][0][2:]
            comps = np.array([h[2] for h in held])
            if len(held) < 2 or (comps == comps[0]).all():
                return [], []
            side = np.full(len(held), 2) if i == j else (np.array([h[4] for h in held]) == j).astype(int)
            rows, roots = block_roots([h[3] for h in held], comps, side, share)
            return [held[r][1] for r in rows], [held[r][1] for r in roots]

        kind_ = None
        for batch in batches:
            kind_ = batch.schema.field("rep").type
            out_a, out_b = [], []
            columns = [batch.column(k).to_pylist() for k in keys]
            for key, rep, comp, own, text in zip(zip(*columns, strict=True), *(batch.column(c) for c in ("rep", "comp", "own", "text")), strict=True):
                if held and held[0][0] != key:
                    a, b = close()
                    out_a += a
                    out_b += b
                    held = []
                held.append((key, rep.as_py(), comp.as_py(), shingles(text.as_py()), own.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, kind_), pa.array(out_b, kind_)], ["a", "b"])
        if held:
            a, b = close()
            yield pa.RecordBatch.from_arrays([pa.array(a, kind_), pa.array(b, kind_)], ["a", "b"])

    whole = dealt.join(texts, F.col("rep") == F.col("doc_id")).select(*keys, "own", "rep", "comp", "text")
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, share: int = 75, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    folder = work_dir(spark, "minhash")
    sketch = stored(sketches(docs, share), f"{folder}/sketch")
    whole = sketch.where(F.col("f1").isNotNull() & F.col("doc_id").isNotNull())
    # Equal sets: the smallest id stands for all. Bands of equal sets are equal, so any will do.
    same = stored(whole.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")), f"{folder}/same")
    entries = same.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key")).withColumn("band", F.least("band", F.lit(BANDS)))
    low = stored(entries.groupBy("band", "key").agg(F.min("rep").alias("c"), F.max("rep").alias("last")).where("c != last").select("band", "key", "c"), f"{folder}/low")
    buckets = stored(entries.join(low, ["band", "key"]), f"{folder}/buckets")
    wanted = buckets.select(F.col("rep").alias("__need")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("__need"), "left_semi")
    texts = stored(texts.groupBy("doc_id").agg(F.min("text").alias("text")), f"{folder}/texts")
    # First star: the smallest id among all bucket mates is the only parent of a document, so links form a forest.
    pairs = buckets.where("rep != c").groupBy(F.col("rep").alias("b")).agg(F.min("c").alias("a"))
    first = stored(confirmed(stored(pairs.select("a", "b"), f"{folder}/pairs0"), texts, share), f"{folder}/links0")
    comps = roots_of(first.select(F.col("b").alias("node"), F.col("a").alias("parent")), f"{folder}/comps0")
    # Second star: the largest id of the buckets that still hold several components.
    placed = with_component(buckets, comps, f"{folder}/second")
    high = placed.groupBy("band", "key").agg(F.max(F.struct("rep", "comp")).alias("m")).select("band", "key", F.col("m.rep").alias("c"), F.col("m.comp").alias("ccomp"))
    high = stored(high, f"{folder}/high")
    pairs = placed.join(high, ["band", "key"]).where("comp != ccomp").groupBy(F.col("rep").alias("b")).agg(F.max("c").alias("a"))
    second = stored(confirmed(stored(pairs.select("a", "b"), f"{folder}/pairs1"), texts, share), f"{folder}/links1")
    comps = merge_components(comps, second, f"{folder}/comps1")
    third = stored(remaining_links(buckets, comps, texts, share, block, folder), f"{folder}/links2")
    if not third.isEmpty():
        comps = merge_components(comps, third, f"{folder}/comps2")
    for name in ("buckets", "texts", "second", "third", "low", "high", "sizes", "pairs0", "pairs1"):
        remove_dir(spark, f"{folder}/{name}")
    of_set = same.select(F.col("f1").alias("__1"), F.col("f2").alias("__2"), "rep").join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("__1", "__2", F.coalesce("comp", "rep").alias("comp"))
    out = sketch.join(of_set, (F.col("f1") == F.col("__1")) & (F.col("f2") == F.col("__2")), "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def with_component(buckets: DataFrame, comps: DataFrame, folder: str) -> DataFrame:
    """Members of buckets that hold more than one component, each with its component."""
    placed = buckets.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("rep", "n_shingles", "band", "key", F.coalesce("comp", "rep").alias("comp"))
    placed = stored(placed, f"{folder}/placed")
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("band", "key")
    return placed.join(stored(mixed, f"{folder}/mixed"), ["band", "key"])


def keep_one(docs: DataFrame, share: int = 75) -> DataFrame:
    """The rows of ``docs`` whose document is kept, all columns as they were.

    Rows with a null doc_id all stay; of rows that repeat a kept doc_id the one with the smallest hash of its text stays.
    """
    own, times = free(docs.columns, "__keep"), free(docs.columns, "__rows")
    kept = near_duplicates(docs, share).where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(times))
    kept = stored(kept, work_dir(docs.sparkSession, "minhash-kept"))
    same = F.col("doc_id") == F.col(own)
    once = docs.join(kept.where(F.col(times) == 1), same, "left_semi")
    # Only repeated ids are sorted out by id, so whole texts are not shuffled for the others.
    again = docs.join(kept.where(F.col(times) > 1), same, "left_semi")
    again = again.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("__row")).select("__row.*")
    return once.unionByName(again).unionByName(docs.where(F.col("doc_id").isNull()))
