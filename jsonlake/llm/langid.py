"""Language identification by segmentation-marginalised unigrams.

Each language has a probability per piece of a fixed public vocabulary. The
likelihood of a word is the sum over all of its segmentations, computed by a
forward algorithm; the log-likelihood of a text is the sum over its words.
Words are runs of letters in lower case, written with a leading space mark.

Training is expectation-maximisation on word counts of a bounded, documented
sample: of each language ``sample_docs`` documents by a hash of doc_id, and of
these the ``sample_words`` most frequent words of each language, so a rare
language is learned like any other. Words of more than 40 letters are counted
there in consecutive parts of 40. Scoring reads every whole text and sums all
segmentations of words of any length.

Edge cases: a null text, or one without a letter, is ``und`` with score 0.
Null
doc_id and repeated rows are scored like any other row. With no training rows
every text is ``und``. Ties between languages go to the first in sorted order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, stored, work_dir
from .lattice import SPACE, Numbers, PieceTable, by_length, read_vocabulary

LETTERS = re.compile(r"[^\W\d_]+")
MAX_WORD = 40
#: ASCII bytes that are no letters become spaces; what else parts words is sorted out once per word.
_ASCII_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
CACHE_WORDS = 700_000
#: Languages and ids of sampled documents that are broadcast at most; more (over a thousand languages) are joined.
MOST_BROADCAST = 1_000_000


def parts_of(word: str) -> str | list[str]:
    """A word, or its parts of ``MAX_WORD`` letters, as training counts them."""
    return SPACE + word if len(word) <= MAX_WORD else [(SPACE if i == 0 else "") + word[i : i + MAX_WORD] for i in range(0, len(word), MAX_WORD)]


class LangModel:
    """Piece log-probabilities by language, as an array (pieces + 1, languages); the last row is an unknown character."""

    def __init__(self, langs: list[str], table: PieceTable, probs: np.ndarray):
        self.langs, self.table, self.probs = langs, table, probs
        self.cache, self.values, self.words = Numbers(), np.zeros((0, len(langs))), np.zeros(0, dtype=np.int64)

    def __getstate__(self):
        return {"langs": self.langs, "table": self.table, "probs": self.probs}

    def __setstate__(self, state):
        self.__init__(**state)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log of the sum over all segmentations, by word and language."""
        out = np.zeros((len(words), len(self.langs)))
        unk = len(self.probs) - 1
        for i, word in enumerate(words):
            if len(word) > MAX_WORD + 1:
                out[i] = long_forward(self.table, word, self.probs, unk)
        short = np.array([i for i, word in enumerate(words) if len(word) <= MAX_WORD + 1], dtype=np.int64)
        for where, codes in by_length([words[i] for i in short]):
            where = short[where]
            alpha = forward(self.table, codes, self.probs, unk)[0]
            out[where] = np.log(np.maximum(alpha[:, -1, :], 1e-300))
        return out

    def text_scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-likelihoods and numbers of words; words are scored once per worker, within a bounded cache."""
        out, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            if len(self.cache) > CACHE_WORDS:
                self.cache.trim(CACHE_WORDS // 2)
                self.values, self.words = self.values[: len(self.cache)], self.words[: len(self.cache)]
            size, first, rows = 0, at, []
            while at < len(texts) and size < 8_000_000:
                raw = (texts[at] or "").lower().encode("utf-8", "surrogatepass")
                rows.append(self.cache.row(raw.translate(_ASCII_LETTERS).split()))
                size += len(raw)
                at += 1
            new = self.cache.settle()
            if new:
                flat, owner, found = [], [], np.zeros(len(new), dtype=np.int64)
                for i, w in enumerate(new):
                    for word in LETTERS.findall(w.decode("utf-8", "surrogatepass")):
                        if any(map(str.isalpha, word)):
                            found[i] += 1
                            flat.append(SPACE + word)
                            owner.append(i)
                scores = np.zeros((len(new), len(self.langs)))
                if flat:
                    np.add.at(scores, np.array(owner), self.word_scores(flat))
                self.values = np.concatenate([self.values, scores])
                self.words = np.concatenate([self.words, found])
            for i, ids in enumerate(rows):
                if len(ids):
                    out[first + i] = self.values[ids].sum(axis=0)
                    counts[first + i] = self.words[ids].sum()
        return out, counts


def forward(table: PieceTable, codes: np.ndarray, probs: np.ndarray, unk: int):
    """Forward sums (rows, positions, languages) and the edges used, ends ascending."""
    w, n = codes.shape
    alpha = np.zeros((w, n + 1, probs.shape[1]))
    alpha[:, 0, :] = 1.0
    edges = list(table.edges(codes))
    single = np.zeros((w, n), dtype=bool)
    for start, end, rows, _ in edges:
        if end == start + 1:
            single[rows, start] = True
    used, at = [], 0
    for end in range(1, n + 1):
        rows = np.flatnonzero(~single[:, end - 1])
        if len(rows):
            used.append((end - 1, end, rows, np.full(len(rows), unk)))
        while at < len(edges) and edges[at][1] == end:
            used.append(edges[at])
            at += 1
    for start, end, rows, ids in used:
        alpha[rows, end, :] += alpha[rows, start, :] * probs[ids]
    return alpha, used


def long_forward(table: PieceTable, word: str, probs: np.ndarray, unk: int) -> np.ndarray:
    """log of the sum over all segmentations of one long word; sums are scaled as they shrink."""
    starts, ends, ids = table.edges_of(word)
    n = len(word)
    alpha = np.zeros((n + 1, probs.shape[1]))
    alpha[0] = 1.0
    scale = np.zeros(probs.shape[1])
    cuts = np.searchsorted(ends, np.arange(1, n + 2))
    for end in range(1, n + 1):
        a, b = cuts[end - 1], cuts[end]
        s = starts[a:b]
        now = (alpha[s] * probs[ids[a:b]]).sum(axis=0)
        if not (s == end - 1).any():
            now = now + alpha[end - 1] * probs[unk]
        alpha[end] = now
        low = (now < 1e-100) & (now > 0)
        if low.any():
            window = slice(max(0, end - table.longest), end + 1)
            by = np.where(low, 1e100, 1.0)
            alpha[window] *= by
            scale -= np.log(by)
    return np.log(np.maximum(alpha[n], 1e-300)) + scale


def collect(expected: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Add weights by piece id and language, all parts of a group at once."""
    if parts:
        ids, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        for k in range(expected.shape[1]):
            expected[:, k] += np.bincount(ids, weights=values[:, k], minlength=len(expected))


def fit(counts: dict[str, dict[str, int]], table: PieceTable, n_pieces: int, rounds: int = 3) -> LangModel:
    """EM from word counts by language."""
    langs = sorted(counts)
    words: dict[str, int] = {}
    flat: list[str] = []
    weights: list[tuple[int, int, int]] = []
    for k, lang in enumerate(langs):
        for word, c in counts[lang].items():
            p = parts_of(word)
            for x in [p] if isinstance(p, str) else p:
                if x not in words:
                    words[x] = len(flat)
                    flat.append(x)
                weights.append((words[x], k, c))
    weight = np.zeros((len(flat), len(langs)))
    if weights:
        a = np.array(weights)
        np.add.at(weight, (a[:, 0], a[:, 1]), a[:, 2])
    # A start from the counts of every substring that is a piece, longer ones favoured.
    expected = np.zeros((n_pieces + 1, len(langs)))
    groups = [(where, codes) for where, codes in by_length(flat)]
    for where, codes in groups:
        collect(expected, [(ids, weight[where[rows]] * (end - start)) for start, end, rows, ids in table.edges(codes)])
    for _ in range(rounds + 1):
        total = expected.sum(axis=0)
        probs = (expected + 0.05) / (total + 0.05 * len(expected))
        probs[-1] = 1e-7
        if _ == rounds:
            break
        expected = np.zeros_like(expected)
        for where, codes in groups:
            alpha, used = forward(table, codes, probs, n_pieces)
            beta = np.zeros_like(alpha)
            beta[:, -1, :] = 1.0
            share = weight[where] / np.maximum(alpha[:, -1, :], 1e-300)
            got = []
            for start, end, rows, ids in reversed(used):
                through = probs[ids] * beta[rows, end, :]
                got.append((ids, alpha[rows, start, :] * through * share[rows]))
                beta[rows, start, :] += through
            collect(expected, got)
    return LangModel(langs, table, probs)


def train(docs: DataFrame, model_file: str, sample_docs: int = 1000, sample_words: int = 50_000) -> LangModel:
    """Fit on a bounded sample of rows that have text and lang: ``docs`` needs doc_id, text, lang."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # Only documents whose hash is low enough for their language are ranked: some 2 * sample_docs of each, however many there are.
    ids = rows.select("doc_id", "lang")
    folder = work_dir(docs.sparkSession, "languages")
    sizes = stored(ids.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("n")), f"{folder}/sizes")
    if sizes.count() <= MOST_BROADCAST:
        sizes = F.broadcast(sizes)
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    near = ids.join(sizes, F.col("lang") == F.col("__lang")).where(uniform < F.lit(2.0 * sample_docs) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = near.withColumn("k", rank).where(F.col("k") <= sample_docs).select(F.col("doc_id").alias("__id")).distinct()
    chosen = stored(chosen, f"{folder}/sample")
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    words = rows.join(chosen, F.col("doc_id") == F.col("__id"), "left_semi").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("k", place).where(F.col("k") <= sample_words)
    counts: dict[str, dict[str, int]] = {}
    for r in top.collect():  # at most sample_words rows a language
        counts.setdefault(r.lang, {})[r.word] = r.n
    pieces, _, plain, _ = read_vocabulary(model_file)
    return fit(counts, PieceTable(pieces, plain), len(pieces))


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred, score and n_words (runs of letters) of every row; score is the posterior at temperature sqrt(words)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 4000):
                part = batch.slice(at, 4000)
                sums, n = m.text_scores(part.column("text").to_pylist())
                if m.langs:
                    z = sums / np.sqrt(np.maximum(n, 1))[:, None]
                    z = np.exp(z - z.max(axis=1, keepdims=True))
                    z /= z.sum(axis=1, keepdims=True)
                    best = sums.argmax(axis=1)
                    score = np.where(n > 0, z[np.arange(len(best)), best], 0.0)
                    lang = [m.langs[b] if c else "und" for b, c in zip(best, n, strict=True)]
                else:
                    score, lang = np.zeros(part.num_rows), ["und"] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "lang_pred", "score", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_words bigint")


def identify(docs: DataFrame, model_file: str, folds: int = 5) -> DataFrame:
    """Fit on rows whose crc32 of doc_id modulo ``folds`` is not 0, then predict all rows."""
    model = train(docs.where(crc_mod(F.col("doc_id"), folds) != 0), model_file)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")
