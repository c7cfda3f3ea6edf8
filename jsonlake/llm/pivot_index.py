"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its ``prefix`` nearest reference points (pivots) in
order. Inverted lists by (label, pivot) give, for every pair of a list, how many
pivots the two share; pairs that share ``min_shared`` or more are candidates, and
only candidates are then verified, by cosine in double precision. A pair is
handled in the list of its smallest shared pivot only, so it is verified once.
A verified link is never given up.

A list is cut into blocks of about ``block`` rows and every pair of blocks is
counted and verified by itself, so a list of any length is worked off in bounded memory.
Blocks return link counts and a spanning forest of their links, never pairs, so
a group of near copies costs no more rows than it has members.

Pivots are a bounded sample, taken by a hash of vec_id: one per ``rows_per_pivot``
vectors up to 4,096 pivots, beyond that 4 times the square root of the number of
vectors (finding the nearest pivots and comparing the lists then grow alike), and
at most ``pivot_bytes`` of them. All vectors are indexed.

Edge cases: a null, empty or zero vector, or one with null or non-finite
components, and a vector with a null label, links with nothing (0 links, its
own component, kept). Vectors of different lengths are never compared. Equal
vectors of one label are one representative whose copies count as links of each
other. Null vec_id rows link with nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, work_dir
from .components import connected_components


def sample_pivots(vectors: DataFrame, count: int, closest: float = 0.8) -> dict[int, np.ndarray]:
    """Unit pivots by vector length, no two with a cosine of ``closest`` or more; ``vectors``: rep, embedding."""
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(count).select("embedding").toArrow()  # bounded by pivot_count
    flat, offsets = _matrix(rows.column("embedding"))
    sizes = np.diff(offsets)
    out = {}
    for d in np.unique(sizes).tolist():
        m = flat[offsets[:-1][sizes == d][:, None] + np.arange(d)].astype(np.float64)
        unit = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
        kept = 0
        for x in unit:  # a large group of near copies must not fill the pivots
            if not kept or (unit[:kept] @ x).max() < closest:
                unit[kept] = x
                kept += 1
        out[d] = unit[:kept]
    return out


def pivot_count(n: int, width: int, rows_per_pivot: int, least: int, pivot_bytes: int) -> int:
    """Pivots for ``n`` vectors of ``width`` numbers."""
    many = max(least, min(n // rows_per_pivot, max(4096, int(4 * n**0.5))))
    return max(1, min(many, pivot_bytes // (4 * max(width, 1))))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def signatures(vectors: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """rep, label, copies, embedding and sig: the nearest pivots, nearest first (one list -1 where a length has no pivots)."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _matrix(batch.column("embedding"))
            sizes = np.diff(offsets)
            sigs: list[list[int]] = [[-1]] * batch.num_rows
            for d, p in sent.value.items():
                rows = np.flatnonzero(sizes == d)
                for i in range(0, len(rows), 2048):
                    part = rows[i : i + 2048]
                    x = flat[offsets[part][:, None] + np.arange(d)].astype(np.float64)
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                    near = -(x @ p.T)
                    k = min(prefix, len(p))
                    top = np.argpartition(near, k - 1, axis=1)[:, :k]
                    top = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
                    for r, t in zip(part, top.tolist(), strict=True):
                        sigs[r] = t
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "label", "copies", "embedding")), pa.array(sigs, pa.list_(pa.int32()))], ["rep", "label", "copies", "embedding", "sig"])

    s = vectors.schema
    return vectors.select("rep", "label", "copies", "embedding").mapInArrow(run, f"rep {s['rep'].dataType.simpleString()}, label {s['label'].dataType.simpleString()}, copies bigint, embedding {s['embedding'].dataType.simpleString()}, sig array<int>")


def shared_pivots(sigs: list[list[int]], pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """By pair of rows: the number of pivots shared, and whether one of them is smaller than ``pivot``."""
    n = len(sigs)
    counts, before = np.zeros((n, n), dtype=np.uint8), np.zeros((n, n), dtype=bool)
    names = np.concatenate([np.asarray(x, dtype=np.int64) for x in sigs])
    rows = np.repeat(np.arange(n), [len(x) for x in sigs])
    order = np.argsort(names, kind="stable")
    names, rows = names[order], rows[order]
    cuts = np.flatnonzero(np.diff(names)) + 1
    for group, name in zip(np.split(rows, cuts), names[np.concatenate([[0], cuts])], strict=True):
        if len(group) > 1:
            at = np.ix_(group, group)
            counts[at] += 1
            if name < pivot:
                before[at] = True
    return counts, before


def block_links(x: np.ndarray, copies: np.ndarray, sigs: list[list[int]], side: np.ndarray, pivot: int, threshold: float, min_shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one pair of blocks: summed copies of linked vectors by row, and for each row the smallest row it is connected to.

    side: 0 and 1 for rows of two different blocks, all 2 within one block.
    """
    n = len(x)
    shared, before = shared_pivots(sigs, pivot)
    need = np.minimum(min_shared, np.array([len(s) for s in sigs]))
    wanted = np.triu((shared >= np.minimum(need[:, None], need[None, :])) & ~before, 1)
    if (side != 2).all():
        wanted &= side[:, None] != side[None, :]
    a, b = np.nonzero(wanted)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    counts, root = np.zeros(n, dtype=np.int64), np.arange(n)
    if len(a) > n * n // 8:  # most pairs are candidates: one product is cheaper
        close = (unit @ unit.T)[a, b] >= threshold
    else:
        close = np.concatenate([np.zeros(0, dtype=bool), *(np.einsum("ij,ij->i", unit[a[i : i + 65_536]], unit[b[i : i + 65_536]]) >= threshold for i in range(0, len(a), 65_536))])
    a, b = a[close], b[close]
    np.add.at(counts, a, copies[b])
    np.add.at(counts, b, copies[a])
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return counts, root


def linked(signed: DataFrame, threshold: float, min_shared: int, block: int) -> DataFrame:
    """rep, other (a representative connected to it, or itself) and links, one row per row of a block with links."""
    lists = signed.select("rep", "label", "copies", "embedding", "sig", F.explode("sig").alias("pivot"), F.size("embedding").alias("dim"))
    sizes = lists.groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).where("n > 1").select("label", "dim", "pivot", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = lists.join(sizes, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", "pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "embedding", "sig")
    keys = ["label", "dim", "pivot", "i", "j"]
    kind = signed.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def close():
            reps = np.array([h[5] for h in held])
            own, (i, j) = np.array([h[4] for h in held]), held[0][0][3:]
            side = np.full(len(held), 2) if i == j else (own == j).astype(int)
            counts, root = block_links(np.array([h[1] for h in held], dtype=np.float64), np.array([h[2] for h in held], dtype=np.int64), [h[3] for h in held], side, held[0][0][2], threshold, min_shared)
            hit = np.flatnonzero(counts)
            return reps[hit], reps[root[hit]], counts[hit]

        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(k).to_pylist() for k in keys]
            flat, offsets = _matrix(batch.column("embedding"))
            sigs, copies, owns, reps = (batch.column(c).to_pylist() for c in ("sig", "copies", "own", "rep"))
            for r, key in enumerate(zip(*columns, strict=True)):
                if held and held[0][0] != key:
                    if len(held) > 1:
                        found.append(close())
                    held = []
                held.append((key, flat[offsets[r] : offsets[r + 1]], copies[r], sigs[r], owns[r], reps[r]))
            if found:
                a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field("rep").type), pa.array(b, batch.schema.field("rep").type), pa.array(c, pa.int64())], ["rep", "other", "links"])
        if len(held) > 1:
            a, b, c = close()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int64())], ["rep", "other", "links"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"rep {kind}, other {kind}, links bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, prefix: int = 8, min_shared: int = 2, block: int = 1024, rows_per_pivot: int = 32, least_pivots: int = 32, pivot_bytes: int = 64 << 20) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; ``vectors``: vec_id, embedding (an array of float or double), label."""
    spark = vectors.sparkSession
    folder = work_dir(spark, "pivots")
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists(e, lambda v: v != 0)
    fit = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & nonzero, F.lit(False))
    rows = vectors.select("vec_id", "label", e, F.xxhash64(e).alias("k1"), F.xxhash64(F.lit("second"), e).alias("k2"), fit.alias("fit"))
    reps = stored(rows.where("fit").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")), f"{folder}/reps")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    pivots = sample_pivots(reps, pivot_count(size.n, size.width or 0, rows_per_pivot, least_pivots, pivot_bytes))
    links = stored(linked(signatures(reps, pivots, prefix), threshold, min_shared, block), f"{folder}/links")
    comps = connected_components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")), folder=f"{folder}/comps")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = reps.select("label", "k1", "k2", "rep", "copies").join(counts, "rep", "left").join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    of_rep = of_rep.select(F.col("label").alias("__l"), F.col("k1").alias("__1"), F.col("k2").alias("__2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("vec_id", "label", "k1", "k2", "fit").join(of_rep, F.col("fit") & (F.col("label") == F.col("__l")) & (F.col("k1") == F.col("__1")) & (F.col("k2") == F.col("__2")), "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"), (comp == F.col("vec_id")).alias("kept"))
