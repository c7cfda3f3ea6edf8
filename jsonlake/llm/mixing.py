"""Soft-membership mixing to target weights, in DataFrame operations only.

A classifier learned from a table of labelled documents gives every document a
posterior over domains. Non-negative document rates are then fitted by
projected-gradient least squares, so that the expected tokens of each domain,
sum(rate * tokens * posterior), match their targets.

Classifier: log odds of word pieces. A distinct word of a text counts once, with
its whole form (the last sign of a word counts as its shape) and its beginnings
of ``SHORTEST`` to ``LONGEST`` letters, so that languages that build words from
few roots are learned as well. Counts come from a bounded sample of
``sample_rows`` labelled documents; equal texts of one domain count once. A
piece speaks for a domain if it is at least e**``least_ratio`` times as common
there as elsewhere; its smoothed log odds are shrunk by their standard error,
1 - (``least_deviation`` / deviation)**2, where a document's repeated use of a
piece widens the error. Of pieces that begin with each other only the one that
deviates most stays, so a word has at most one. Words without a piece of a
domain speak against it, by as much as they are rarer there. At most
``most_words`` pieces have weights, so the table that is broadcast to score all
documents has a fixed bound.

Solver: minimise half the squared distance of the domains' tokens from their
targets over rates in 0..max_rate. Steps are projected gradient steps in the
metric of tokens, in which clipping each rate is the projection; the plain step
is 1/L with L the largest eigenvalue of the domains' Gram matrix, and rates that
are not held at a bound also get a step scaled by the inverse Gram matrix of
these rates (two-metric projection). One distributed sum evaluates all steps at
several lengths, the best one is taken, so the distance never grows. The same
sum gives the duality gap sum(gradient * rate) - min over rates, a bound of how
far the distance is from its least value; the solver stops when that gap is at
most ``tolerance`` of half the squared distance, the distance is next to 0, or
no step lowers it within the precision of sums; it warns if ``most_steps`` do
not suffice, and the misfit is part of every result. Rates live in a stored
table; only sums by domain come to the driver. Domains are few (at most 64,
checked).

Edge cases: a document without words has 0 tokens and the prior as posterior and
rate 1; null labels do not train; without labelled rows all posteriors are
equal; a domain without tokens gets none; ties do not occur (rates are a
function of tokens and posterior). A row is scored by its own text, whatever its
doc_id: null doc_id rows and rows that repeat a doc_id with other texts keep
their own posteriors, and equal rows get equal results, one each.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, remove_dir, stored, work_dir

#: Signs that stand for a word's shape when they end it.
SHAPES = list("!*#$%&|")
SHORTEST, LONGEST = 3, 8
#: Parts of the labelled texts while their pieces are counted. Spark would join the small texts to a few parts, though each text has thousands of pieces.
PARTS = 64
#: Pieces that the driver looks at for each one it keeps.
CANDIDATES = 15


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words_of(F.lower(text)))


def word_token(word: Column) -> Column:
    """The word as it is counted; ``word`` is in lower case."""
    end = F.substring(word, -1, 1)
    return F.when(end.isin(SHAPES), end).otherwise(F.rtrim(word, F.lit(".,;:")))


def word_pieces(token: Column) -> list[Column]:
    """The beginnings of a token and the whole token, which ends in NUL; null where the token is too short."""
    return [*(F.when(F.char_length(token) > k, F.substring(token, 1, k)) for k in range(SHORTEST, LONGEST + 1)), F.concat(token, F.lit("\0"))]


def head_of(plain: str) -> str:
    """What every word with this piece begins with."""
    return plain[:SHORTEST]


#: A word that no text has; it stands for the row itself.
ROW = "\0"


class DomainModel:
    """Log priors by domain; by 64-bit hash of a piece, what it says for each domain; what any word says against it; how pieces begin."""

    def __init__(self, domains: list[str], priors: list[float], buckets: list[tuple], rest: list[float], heads: list[str] | None = None):
        self.domains, self.priors, self.buckets, self.rest, self.heads = domains, priors, buckets, rest, heads or []


def label_domain() -> Column:
    """The domain of a row of ``labels``: low quality, else toxic, else clean."""
    return F.when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 1), "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = 12_000, most_words: int = 4_000, least_deviation: float = 3.0, least_ratio: float = 2.0, folder: str | None = None) -> DomainModel:
    """``labelled``: doc_id, domain."""
    if not 1 <= len(domains) <= 64:
        raise ValueError("between 1 and 64 domains")
    each = range(len(domains))
    sample = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample_rows).select(F.col("doc_id").alias("__id"), "domain")
    rows = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(rows.values()) + len(domains)
    priors = [math.log((rows.get(d, 0) + 1) / total) for d in domains]
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("domain", "text", F.xxhash64("text").alias("key"))
    texts = stored(texts.dropDuplicates(["key", "domain"]), f"{folder or work_dir(docs.sparkSession, 'mix')}/labelled")
    sums = texts.agg(*(F.sum(F.when(F.col("domain") == d, F.size(distinct_words(F.col("text"))))).alias(f"t{k}") for k, d in enumerate(domains))).first()
    words = np.array([float(sums[f"t{k}"] or 0) for k in each])
    if not words.sum():
        return DomainModel(domains, priors, [], [0.0] * len(domains))
    tokens = texts.repartition(PARTS, "key").select("key", "domain", F.explode(distinct_words(F.col("text"))).alias("w")).select("key", "domain", word_token(F.col("w")).alias("w"))
    pieces = tokens.select("key", "domain", F.explode(F.array(*word_pieces(F.col("w")))).alias("piece")).where("piece IS NOT NULL")
    # By document first: the variance of a piece's count is the sum of its squared counts by document.
    by = pieces.groupBy("key", "domain", "piece").agg(F.count("*").alias("c"))
    by = by.groupBy("piece").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), *(F.sum(F.when(F.col("domain") == d, F.col("c")).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)))
    n, seen = F.col("n"), [F.col(f"n{k}") for k in each]
    share = words / words.sum()
    far = [(o - n * float(share[k])) / F.sqrt(F.col("sq") * float(share[k]) + 1.0) for k, o in enumerate(seen)]
    odds = [F.log((o + 0.5) / (n - o + 0.5)) - math.log((words[k] + 1) / (words.sum() - words[k] + 1)) for k, o in enumerate(seen)]
    strong = [F.when((x >= least_ratio) & (z > least_deviation), z).otherwise(0.0) for x, z in zip(odds, far, strict=True)]
    best = F.greatest(*strong) if len(strong) > 1 else strong[0]
    chosen = by.select("piece", *seen, *(z.alias(f"z{k}") for k, z in enumerate(strong)), *(x.alias(f"r{k}") for k, x in enumerate(odds)), best.alias("best"), F.xxhash64("piece").alias("bucket"))
    chosen = chosen.where("best > 0").orderBy(F.desc("best"), F.char_length("piece"), "piece").limit(CANDIDATES * most_words)
    kept, inside = {}, set()
    for r in chosen.collect():
        plain = r.piece.rstrip("\0")
        heads = [plain[:k] for k in range(SHORTEST, len(plain) + 1)]
        if r.piece not in inside and not any(h in kept for h in heads):
            kept[r.piece] = r
            inside.update(heads)
            if len(kept) == most_words:
                break
    rest = []
    for k in each:
        own = [r for r in kept.values() if r[f"z{k}"] > 0]
        here = words[k] - sum(r[f"n{k}"] for r in own)
        away = words.sum() - words[k] - sum(r[f"n{j}"] for r in own for j in each if j != k)
        rest.append(min(0.0, math.log((here + 1) / (words[k] + 1)) - math.log((away + 1) / (words.sum() - words[k] + 1))))
    # A word with a piece of the domain is not one of the rest.
    weight = [lambda r, k=k: r[f"r{k}"] * (1 - (least_deviation / r[f"z{k}"]) ** 2) - rest[k] if r[f"z{k}"] > 0 else 0.0 for k in each]
    return DomainModel(domains, priors, [(r.bucket, *(float(w(r)) for w in weight)) for r in kept.values()], rest, sorted({head_of(p.rstrip("\0")) for p in kept}))


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, tokens, p0..pk of every row."""
    spark, n = docs.sparkSession, range(len(model.domains))
    key = F.xxhash64("text").alias("tkey")
    # Lower case leaves the number of words as it is, so all sizes come from one split.
    split = docs.select("doc_id", key, words_of(F.lower(F.col("text"))).alias("ws")).select("doc_id", "tkey", F.size("ws").cast("long").alias("tokens"), F.array_distinct("ws").alias("ws"))
    words = split.select("doc_id", "tkey", "tokens", F.size("ws").alias("own"), F.explode(F.concat(F.array(F.lit(ROW)), "ws")).alias("w"))
    words = words.select("doc_id", "tkey", "tokens", "own", word_token(F.col("w")).alias("w"))
    # Most words begin like no piece; both small tables are bounded by the number of pieces.
    heads = spark.createDataFrame([(h,) for h in {*model.heads, ROW}], "head string")
    words = words.join(F.broadcast(heads), F.substring("w", 1, SHORTEST) == F.col("head"), "left_semi")
    # The hash of null is its seed, not null.
    hashes = words.select("doc_id", "tkey", "tokens", "own", F.explode(F.array(*(F.when(p.isNotNull(), F.xxhash64(p)) for p in word_pieces(F.col("w"))))).alias("bucket"))
    table = spark.createDataFrame([(b, *w, 0) for b, *w in model.buckets], "b bigint, " + "".join(f"r{k} double, " for k in n) + "is_row int")
    own_row = spark.range(1).select(F.xxhash64(word_pieces(F.lit(ROW))[-1]).alias("b"), *(F.lit(0.0).alias(f"r{k}") for k in n), F.lit(1).alias("is_row"))
    scored = hashes.join(F.broadcast(table.unionByName(own_row)), F.col("bucket") == F.col("b"))
    # Equal rows are scored together and then told apart again.
    base = scored.groupBy("doc_id", "tkey").agg(F.max("tokens").alias("tokens"), F.max("own").alias("own"), F.sum("is_row").alias("rows"), *(F.sum(f"r{k}").alias(f"s{k}") for k in n))
    logits = [F.lit(model.priors[k]) + F.col(f"s{k}") / F.col("rows") + F.col("own") * F.lit(float(model.rest[k])) for k in n]
    base = base.select("doc_id", "tokens", "rows", *(x.alias(f"l{k}") for k, x in enumerate(logits)))
    top = F.greatest(*(F.col(f"l{k}") for k in n)) if len(model.domains) > 1 else F.col("l0")
    base = base.select("doc_id", "tokens", "rows", *(F.exp(F.col(f"l{k}") - top).alias(f"e{k}") for k in n))
    total = sum((F.col(f"e{k}") for k in n), F.lit(0.0))
    base = base.withColumn("__total", total).withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return base.select("doc_id", "tokens", *((F.col(f"e{k}") / F.col("__total")).alias(f"p{k}") for k in n))


class Mixture(NamedTuple):
    """Rates by row and what they reach; ``gap`` bounds how far the distance from the targets is above its least value."""

    table: DataFrame
    target: list[float]
    reached: list[float]
    misfit: float
    gap: float
    steps: int


#: Lengths of the plain and of the scaled steps that are tried in each round.
PLAIN, SCALED = (1.0, 8.0, 64.0), (1.0, 0.5, 0.25, 0.1, 0.05, 0.02, 0.01, 0.003)
#: Distance from the targets, as a share of the mixture, that counts as none.
CLOSE = 2e-4
#: Rounds between two stored tables of rates.
STORE_EVERY = 4


def solve(table: DataFrame, weights: list[float], total: float | None, anchor: int | None, max_rate: float, folder: str, most_steps: int = 60, tolerance: float = 1e-2) -> Mixture:
    """Projected gradient on rates over ``table`` (tokens, p0..pk, more columns pass): adds the column ``rate``."""
    n = range(len(weights))
    t, rate = F.col("tokens").cast("double"), F.col("rate")
    p = [F.col(f"p{k}") for k in n]
    pairs = [(i, j) for i in n for j in n if i <= j]
    first = table.agg(F.sum(t).alias("all"), *(F.sum(t * p[k]).alias(f"m{k}") for k in n), *(F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    mass = np.array([float(first[f"m{k}"] or 0) for k in n])
    share = np.array(weights, dtype=float) / sum(weights)
    whole = float(first["all"] or 0) if total is None else float(total)
    if anchor is not None and share[anchor] > 0:
        whole = mass[anchor] / share[anchor]
    target = share * whole

    def gram_of(row) -> np.ndarray:
        return np.array([[float(row[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in n] for i in n])

    def product(v: np.ndarray) -> Column:
        return sum((p[k] * float(v[k]) for k in n), F.lit(0.0))

    top = max(float(np.linalg.eigvalsh(gram_of(first))[-1]), 1e-300)
    clip = lambda x: F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), x))
    state = table.withColumn("rate", F.lit(min(1.0, float(max_rate))))
    reached = mass * min(1.0, float(max_rate))
    steps, made = 0, None
    while True:
        residual = reached - target
        distance = float(residual @ residual)
        # One pass: the duality gap and the Gram matrix of the rates that their gradient does not hold at a bound.
        slope = product(residual)
        held = ((rate <= 1e-9) & (F.col("__slope") > 0)) | ((rate >= max_rate - 1e-9) & (F.col("__slope") < 0))
        sloped = state.withColumn("__slope", slope).withColumn("__held", held)
        free = F.when(~F.col("__held"), t).otherwise(0.0)
        row = sloped.agg(F.sum(t * (F.col("__slope") * rate - F.least(F.lit(0.0), F.col("__slope")) * float(max_rate))).alias("gap"), *(F.sum(free * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
        gap = float(row["gap"] or 0)
        # distance / 2 is at most gap above its least value.
        if distance <= (CLOSE * max(whole, 1.0)) ** 2 or gap <= tolerance * distance / 2:
            break
        if steps == most_steps:
            warnings.warn(f"the rates did not settle in {most_steps} steps: duality gap {gap:.4g} at {distance / 2:.4g}", RuntimeWarning, stacklevel=2)
            break
        own = gram_of(row)
        scaled = np.linalg.pinv(own + np.eye(len(weights)) * 1e-12 * top, hermitian=True) @ residual
        moves = [clip(rate - F.col("__slope") * (a / top)) for a in PLAIN]
        moves += [F.when(F.col("__held"), rate).otherwise(clip(rate - product(scaled) * a)) for a in SCALED]
        tried = sloped.select("tokens", *(f"p{k}" for k in n), *(m.alias(f"x{j}") for j, m in enumerate(moves)))
        sums = tried.agg(*(F.sum(t * p[k] * F.col(f"x{j}")).alias(f"s{j}_{k}") for j in range(len(moves)) for k in n)).first()
        ends = [np.array([float(sums[f"s{j}_{k}"] or 0) for k in n]) for j in range(len(moves))]
        best = min(range(len(moves)), key=lambda j: float(((ends[j] - target) ** 2).sum()))
        if float(((ends[best] - target) ** 2).sum()) >= distance:
            break  # no step helps within the precision of sums
        state = sloped.select(*table.columns, moves[best].alias("rate"))
        reached = ends[best]
        steps += 1
        if steps % STORE_EVERY == 0:
            before, made = made, f"{folder}/rates{steps}"
            state = stored(state, made)
            if before:
                remove_dir(table.sparkSession, before)
    return Mixture(state, target.tolist(), reached.tolist(), math.sqrt(distance) / max(whole, 1.0), gap, steps)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total_tokens: float | None = None, anchor: str | None = None, max_rate: float = 8.0, **how) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate, copies, misfit of every row.

    ``targets``: weight by domain. ``total_tokens``: size of the mixture (default: that of the input).
    ``anchor``: instead, the size at which this domain keeps its expected tokens. ``copies`` rounds the rate
    up or down by a hash of doc_id and tokens, so its expectation is the rate. ``misfit`` is the same in all
    rows: the distance of the reached from the target tokens of the domains over the size of the mixture.
    """
    domains = list(targets)
    folder = work_dir(docs.sparkSession, "mix")
    model = train(docs, labelled, domains, folder=folder, **how)
    table = stored(posteriors(docs, model), f"{folder}/posteriors")
    got = solve(table, [targets[d] for d in domains], total_tokens, domains.index(anchor) if anchor else None, max_rate, folder)
    uniform = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("tokens")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("rate") + uniform).cast("int")
    return got.table.select("doc_id", "tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)), "rate", copies.alias("copies"), F.lit(got.misfit).alias("misfit"))


def resample(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``plan`` (doc_id, copies) says, all columns as they were.

    Rows with a null doc_id have no copies of their own to look up: each stays once if ``plan`` has such rows.
    """
    names = docs.columns
    own, times, each = (free(names, n) for n in ("__id", "__copies", "__k"))
    once = plan.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(times))
    joined = docs.join(once.where(F.col(times) > 0), F.col("doc_id") == F.col(own))
    drawn = joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
    planned = plan.where("doc_id IS NULL").select(F.lit(True).alias("__planned")).limit(1)
    return drawn.unionByName(docs.where("doc_id IS NULL").crossJoin(F.broadcast(planned)).select(*names))
