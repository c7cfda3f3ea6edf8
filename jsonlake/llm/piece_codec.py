"""SentencePiece encoding and decoding with N-best segmentation.

A text is written as sentencepiece does it (a space mark for every space and
one in front) and cut where no piece of the vocabulary can cross: before a run
of space marks and around characters that occur in no longer piece. The piece
lattice of the text is the chain of the chunks' lattices, so its best
segmentation is the chain of their best ones.

Viterbi passes run over all new chunks of a batch together and also give each
chunk's loss for the second-best segmentation. The N best segmentations of a
text can differ from the best only in the N-1 occurrences with the smallest
losses, so A-star (``lattice.n_best``: forward Viterbi scores as exact
heuristics of a backward search) runs on those chunks, and a queue over sums of
their ranks gives the N best segmentations of the whole text with their pieces.

Characters outside the vocabulary become byte pieces. Decoding joins the pieces,
turns byte pieces into bytes and drops the mark in front; decode(encode(text))
is the text unless it contains the space mark itself.

Edge cases: a null text has null results; an empty text has no pieces, one
segmentation and score 0; ties between segmentations go to the first found,
so results do not depend on batches. Chunks may have any length. Extra columns
are kept by ``encode``; one that is named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back
from .lattice import SPACE, Numbers, PieceTable, best_and_gap, by_length, n_best, read_vocabulary

CACHE_CHUNKS = 500_000


def chunk_of(key: str) -> str:
    """The chunk that ``Codec.keys`` calls by this name."""
    return key if key[:1] in ("\n", SPACE) else key[1:] if key[:1] == "\0" else SPACE + key


class Codec:
    def __init__(self, model_file: str):
        self.pieces, self.scores, self.plain, self.byte_ids = read_vocabulary(model_file)
        self.table = PieceTable(self.pieces, self.plain)
        self._ready()

    def _ready(self) -> None:
        ids = np.flatnonzero(self.plain)
        self.index = {self.pieces[i]: int(i) for i in ids}
        self.unknown = float(self.scores[ids].min()) - 10.0
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece crosses a space")
        crossing = any("\n" in self.pieces[i] and len(self.pieces[i]) > 1 for i in ids)
        self.plain_breaks = not crossing
        # Line breaks stand alone unless a piece crosses them.
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if crossing else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
        self.text_of = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                self.text_of[i] = bytes([b])
        self.cache, self.names = Numbers(), []
        self.score, self.gap, self.size = (np.zeros(0) for _ in range(3))
        self.blobs: list[bytes] = []
        self.ranked: dict[int, tuple[list[float], list[bytes]]] = {}

    def _trim(self, keep: int) -> None:
        self.cache.trim(keep)
        self.score, self.gap, self.size = self.score[:keep], self.gap[:keep], self.size[:keep]
        del self.blobs[keep:], self.names[keep:]
        self.ranked = {k: v for k, v in self.ranked.items() if k < keep}

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("pieces", "scores", "plain", "byte_ids", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _fallback(self, ch: str) -> list[int]:
        return [int(self.byte_ids[b]) for b in ch.encode("utf-8", "surrogatepass")]

    def _learn(self, new: list[str]) -> None:
        """Best segmentation, score and loss of the second best for new chunks."""
        score, gap, size = np.zeros(len(new)), np.zeros(len(new)), np.zeros(len(new))
        blobs: list[bytes] = [b""] * len(new)
        for where, codes in by_length(new, 200_000):
            s, g, ids, starts, valid = best_and_gap(self.table, self.scores, self.unknown, codes)
            score[where], gap[where] = s, g
            flat, used = ids[::-1].T.astype("<i4"), valid[::-1].T
            counts = used.sum(axis=1)
            bad = ((flat < 0) & used).any(axis=1)
            data = flat[used].tobytes()
            ends = np.cumsum(counts) * 4
            begin = ends - counts * 4
            for k, (w, a, b) in enumerate(zip(where.tolist(), begin.tolist(), ends.tolist(), strict=True)):
                blob = data[a:b]
                if bad[k]:
                    out: list[int] = []
                    at = starts[::-1].T[k][used[k]]
                    for i, p in zip(np.frombuffer(blob, "<i4").tolist(), at.tolist(), strict=True):
                        out += [i] if i >= 0 else self._fallback(new[w][p])
                    blob = np.array(out, "<i4").tobytes()
                blobs[w] = blob
            size[where] = [len(blobs[w]) // 4 for w in where.tolist()]
        self.score, self.gap, self.size = (np.concatenate(x) for x in ((self.score, score), (self.gap, gap), (self.size, size)))
        self.blobs += blobs

    def keys(self, text: str) -> list[str]:
        """The chunks of a text under the names that the cache has for them.

        Where single spaces and line breaks part the words, splitting gives the chunks at once: a word
        stands for itself with a space mark in front, a word after a line break keeps the break instead.
        Other texts are cut by the pattern.
        """
        if not text:
            return []
        if self.plain_breaks and "  " not in text and " \n" not in text and text[0] != " " and SPACE not in text and "\0" not in text:
            return text.replace("\n", " \n").split(" ")
        return [c if c[0] in ("\n", SPACE) else "\0" + c for c in self.chunks.findall(SPACE + text.replace(" ", SPACE))]

    def rows(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """For each text the numbers of its chunks in the tables of this object; consume in order."""
        at = 0
        while at < len(texts):
            if len(self.cache) > CACHE_CHUNKS:
                self._trim(CACHE_CHUNKS // 2)
            size, found = 0, []
            while at < len(texts) and size < 6_000_000:
                text = texts[at]
                at += 1
                if text is None:
                    found.append(None)
                    continue
                size += len(text)
                found.append(self.cache.row(self.keys(text)))
            new = self.cache.settle()
            if new:
                self._learn([chunk_of(k) for k in new])
                # The cache's own strings: a second one for each chunk would be the largest part of this object.
                self.names += new
                give_back()
            yield from found

    def _ranked(self, k: int, n: int) -> tuple[list[float], list[bytes]]:
        """Losses and pieces of the ``n`` best segmentations of chunk ``k``; an infinite loss ends them where there are fewer."""
        got = self.ranked.get(k)
        if got is None or len(got[0]) < n and not math.isinf(got[0][-1]):
            name = chunk_of(self.names[k])
            found = n_best(name, self.index, self.scores, self.unknown, n, self.table.longest)
            losses = [found[0][0] - s for s, _ in found]
            blobs = []
            for _, path in found:
                ids: list[int] = []
                for start, _end, i in path:
                    ids += [i] if i >= 0 else self._fallback(name[start])
                blobs.append(np.array(ids, "<i4").tobytes())
            # Ties for the best may be found in another order than the Viterbi pass has them: its path comes first.
            first = self.blobs[k]
            if blobs[0] != first:
                if first in blobs:
                    blobs.remove(first)
                else:
                    blobs.pop()
                blobs.insert(0, first)
            got = losses + [math.inf] * (len(found) < n), blobs
            self.ranked[k] = got
        return got

    def n_best(self, ids: np.ndarray, n: int) -> tuple[list[float], list[bytes]]:
        """Scores and pieces (little-endian 32-bit ids) of the ``n`` best segmentations of a text, best first."""
        best = float(self.score[ids].sum())
        whole = b"".join(map(self.blobs.__getitem__, ids.tolist()))
        if n == 1:
            return [best], [whole]
        gaps = self.gap[ids]
        near = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= 64 else self._smallest(gaps, n - 1)
        near = np.sort(near[np.isfinite(gaps[near])])
        ends = np.cumsum(self.size[ids]).astype(np.int64) * 4
        places = [(int(ends[i]) - len(self.blobs[int(ids[i])]), int(ends[i])) for i in near]
        ranked = [self._ranked(int(ids[i]), n) for i in near]
        scores, paths, queue, seen = [], [], [(0.0, (0,) * len(ranked))], set()
        while queue and len(scores) < n:
            loss, state = heapq.heappop(queue)
            scores.append(best - loss)
            parts, at = [], 0
            for (start, end), (_, blobs), r in zip(places, ranked, state, strict=True):
                if r:
                    parts += [whole[at:start], blobs[r]]
                    at = end
            paths.append(b"".join([*parts, whole[at:]]) if parts else whole)
            for j, (losses, _) in enumerate(ranked):
                up = state[j] + 1
                if up < len(losses) and not math.isinf(losses[up]):
                    nxt = (*state[:j], up, *state[j + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(queue, (loss - losses[state[j]] + losses[up], nxt))
        return scores, paths

    @staticmethod
    def _smallest(gaps: np.ndarray, k: int) -> np.ndarray:
        part = np.argpartition(gaps, k - 1)[:k] if k else np.zeros(0, dtype=np.int64)
        if k:
            # All below the k-th value, then its first places: the same choice as a stable sort.
            bound = gaps[part].max()
            low = np.flatnonzero(gaps < bound)
            part = np.concatenate([low, np.flatnonzero(gaps == bound)[: k - len(low)]])
        return part

    def encode(self, texts: list[str | None], n: int = 1) -> Iterator[tuple[list[float], list[np.ndarray]] | None]:
        """(scores, piece ids) of the ``n`` best segmentations of each text, best first."""
        for ids in self.rows(texts):
            if ids is None:
                yield None
            else:
                scores, paths = self.n_best(ids, n)
                yield scores, [np.frombuffer(p, "<i4") for p in paths]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        raw = b"".join(map(self.text_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return raw.decode("utf-8", "surrogatepass")[1:]


RESULTS = {"n_pieces": ("bigint", pa.int64()), "best_score": ("double", pa.float64()), "n_found": ("int", pa.int32()), "second_loss": ("double", pa.float64()), "nth_loss": ("double", pa.float64()), "ids_sha256": ("string", pa.string()), "nbest_sha256": ("array<string>", pa.list_(pa.string())), "round_trip": ("boolean", pa.bool_()), "piece_ids": ("array<int>", pa.list_(pa.int32())), "segmentations": ("array<array<int>>", pa.list_(pa.list_(pa.int32())))}


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """One list for each array, without a Python object per number."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, "<i4"), pa.int32()))


def encode(docs: DataFrame, model_file: str, n: int = 4, text: str = "text", with_ids: bool = True, with_segmentations: bool = False, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (the text column only if ``with_text``), plus results of the whole text.

    n_pieces, best_score, n_found (segmentations found, at most ``n``), second_loss (null: only one),
    nth_loss (of the last one found), ids_sha256 (of the little-endian 32-bit ids of the best one),
    nbest_sha256 (of every one found), round_trip (every one found decodes to the text),
    piece_ids (the best one) if ``with_ids``, and segmentations (all that were found, best first) if ``with_segmentations``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Codec(model_file))
    extra = [c for c in RESULTS if (c != "piece_ids" or with_ids) and (c != "segmentations" or with_segmentations)]
    names = [c for c in docs.columns if c not in extra and (c != text or with_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 2000):
                batch = whole.slice(at, 2000)
                rows, best, every = [], [], []
                texts = batch.column(text).to_pylist()
                for t, got in zip(texts, codec.encode(texts, n), strict=True):
                    if got is None:
                        rows.append((None,) * 8)
                        continue
                    scores, paths = got
                    sums = [hashlib.sha256(p).hexdigest() for p in paths]
                    last = [scores[0] - scores[k] if len(scores) > 1 else None for k in (1 if len(scores) > 1 else 0, -1)]
                    same = all((codec.decode(p) if len(p) else "") == t for p in paths)
                    rows.append((len(paths[0]), scores[0], len(scores), *last, sums[0], sums, same))
                    if with_ids:
                        best.append(paths[0])
                    if with_segmentations:
                        every.append(paths)
                there = [r[0] is not None for r in rows]
                columns = [pa.array(c, RESULTS[k][1]) for c, k in zip(zip(*rows, strict=True), RESULTS, strict=False)] if rows else [pa.array([], RESULTS[k][1]) for k in list(RESULTS)[:8]]
                # A row without a text takes a null instead of a list.
                take = pa.array(np.cumsum(there) - 1, mask=~np.array(there, dtype=bool)) if rows else pa.array([], pa.int64())
                if with_ids:
                    columns.append(_lists(best).take(take))
                if with_segmentations:
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in every])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), _lists([p for paths in every for p in paths])).take(take))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *extra])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), *(f"{c} {RESULTS[c][0]}" for c in extra)])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, ids: str = "piece_ids", to: str = "text") -> DataFrame:
    """``encoded`` with the text of each row's piece ids as column ``to``; null ids give a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Codec(model_file))
    names = [c for c in encoded.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = sent.value
        for batch in batches:
            texts = [None if x is None else codec.decode(x) if len(x) else "" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, to])

    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names), f"`{to}` string"])
    return encoded.select(*dict.fromkeys([*names, ids])).mapInArrow(run, schema)
