"""Piece lattices over a fixed public vocabulary.

Strings of one length are handled together: one polynomial hash per prefix
gives the hash of every substring, a small presence table rules out most
substrings, a sorted table resolves the rest. The same edges serve the forward
algorithm of language identification and the Viterbi pass of piece encoding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 20
_SHIFT = np.uint64(64 - _BITS)
NEG = -1e300


def read_vocabulary(model_file: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, scores, a mask of ordinary pieces, and the ids of the 256 byte pieces (-1: none)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)], dtype=np.float64)
    plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
    bytes_ = np.full(256, -1, dtype=np.int32)
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            bytes_[int(p[3:5], 16)] = i
    return pieces, scores, plain, bytes_


def _hash(text: str) -> np.uint64:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(h)


class PieceTable:
    """Ordinary pieces by the hash of their text. Pickles as plain arrays."""

    def __init__(self, pieces: list[str], plain: np.ndarray):
        ids = np.flatnonzero(plain).astype(np.int32)
        keys = np.array([_hash(pieces[i]) for i in ids], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        if len(self.keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.longest = max((len(pieces[i]) for i in ids), default=1)
        self.there = np.zeros(1 << _BITS, dtype=bool)
        # Two direct tables of positions in ``keys``: the few keys whose first slot is taken use the second.
        self.slots = np.zeros((2, 1 << _BITS), dtype=np.int32)
        with np.errstate(over="ignore"):
            first = (self.keys * _SPREAD) >> _SHIFT
            self.there[first] = True
            self.slots[0][first] = np.arange(len(self.keys))
            left = np.flatnonzero(self.slots[0][first] != np.arange(len(self.keys)))
            second = (self.keys[left] * _SECOND) >> _SHIFT
            self.slots[1][second] = left
            if (self.slots[1][second] != left).any():
                raise ValueError("two pieces share both slots")
            powers = [np.uint64(1)]
            for _ in range(self.longest):
                powers.append(np.uint64((int(powers[-1]) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF))
        self.powers = powers

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, piece ids) of every piece in the rows of ``codes``, ends ascending."""
        w, n = codes.shape
        with np.errstate(over="ignore"):
            prefix = [np.zeros(w, dtype=np.uint64)]
            for i in range(n):
                prefix.append(prefix[-1] * _BASE + codes[:, i] + np.uint64(1))
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    key = prefix[end] - prefix[start] * self.powers[end - start]
                    slot = (key * _SPREAD) >> _SHIFT
                    rows = np.flatnonzero(self.there[slot])
                    if not len(rows):
                        continue
                    key = key[rows]
                    at = self.slots[0][slot[rows]]
                    hit = self.keys[at] == key
                    miss = np.flatnonzero(~hit)
                    if len(miss):
                        at[miss] = self.slots[1][(key[miss] * _SECOND) >> _SHIFT]
                        hit[miss] = self.keys[at[miss]] == key[miss]
                    if hit.any():
                        yield start, end, rows[hit], self.ids[at[hit]]

    def edges_of(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and piece ids of every piece in one string, ends ascending; all starts of a length at once."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(codes)
        prefix, h = np.zeros(n + 1, dtype=np.uint64), 0
        for i, c in enumerate(codes.tolist()):
            h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
            prefix[i + 1] = h
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, n) + 1):
                key = prefix[size:] - prefix[: n + 1 - size] * self.powers[size]
                at = np.searchsorted(self.keys, key)
                hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key))
                found.append((hit, hit + size, self.ids[at[hit]]))
        starts, ends, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ends, kind="stable")
        return starts[order], ends[order], ids[order]


class Numbers(dict):
    """Numbers strings in the order they are first asked for; ``new`` lists those since the last ``settle``.

    Bounded: ``trim`` keeps the first strings, which are the most frequent ones as a rule.
    """

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def settle(self) -> list[str]:
        new, self.new = self.new, []
        return new

    def trim(self, keep: int) -> None:
        first = list(self)[:keep]
        self.clear()
        self.update(zip(first, range(len(first)), strict=True))

    def row(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def by_length(words: list[str], most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, code points as a matrix) for words of one length, in bounded groups."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        n = int(lengths[group[0]]) if len(group) else 0
        if not n:
            continue
        step = max(1, most // n)
        for i in range(0, len(group), step):
            part = group[i : i + step]
            codes = np.frombuffer("".join([words[j] for j in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield part, codes.reshape(len(part), n).astype(np.uint64)


def best_and_gap(table: PieceTable, scores: np.ndarray, unknown: float, codes: np.ndarray):
    """Viterbi over rows of one length.

    Returns best scores, the loss of the second-best segmentation (inf: none),
    and for the best one, from its last piece to its first, matrices of piece
    ids (-1: a character outside the vocabulary), starts and a validity mask.

    The second-best path leaves the best one in some edge, so its score is the
    largest forward + piece + backward score over edges off the best path.
    """
    w, n = codes.shape
    fwd = np.full((w, n + 1), NEG)
    fwd[:, 0] = 0.0
    back_len = np.zeros((w, n + 1), dtype=np.int32)
    back_id = np.full((w, n + 1), -1, dtype=np.int32)
    edges = list(table.edges(codes))
    known = np.zeros((w, n), dtype=bool)
    for start, end, rows, _ in edges:
        if end == start + 1:
            known[rows, start] = True
    at = 0
    all_edges = []
    for end in range(1, n + 1):
        rows = np.flatnonzero(~known[:, end - 1])
        if len(rows):
            all_edges.append((end - 1, end, rows, None))
        while at < len(edges) and edges[at][1] == end:
            all_edges.append(edges[at])
            at += 1
    for start, end, rows, ids in all_edges:
        new = fwd[rows, start] + (unknown if ids is None else scores[ids])
        better = new > fwd[rows, end]
        won = rows[better]
        fwd[won, end] = new[better]
        back_len[won, end] = end - start
        back_id[won, end] = -1 if ids is None else ids[better]
    on_path = np.zeros((w, n + 1), dtype=bool)
    pos = np.full(w, n)
    out_ids, out_starts, valid = [], [], []
    every = np.arange(w)
    while (pos > 0).any():
        live = pos > 0
        on_path[every[live], pos[live]] = True
        valid.append(live)
        out_ids.append(np.where(live, back_id[every, pos], 0))
        pos = pos - np.where(live, back_len[every, pos], 0)
        out_starts.append(pos)
    bwd = np.full((w, n + 1), NEG)
    bwd[:, n] = 0.0
    second = np.full(w, NEG)
    for start, end, rows, ids in reversed(all_edges):
        new = bwd[rows, end] + (unknown if ids is None else scores[ids])
        bwd[rows, start] = np.maximum(bwd[rows, start], new)
        off = ~(on_path[rows, end] & (back_len[rows, end] == end - start))
        if off.any():
            r = rows[off]
            second[r] = np.maximum(second[r], new[off] + fwd[r, start])
    gap = np.where(second > NEG / 2, fwd[:, n] - second, np.inf)
    return fwd[:, n], gap, np.array(out_ids), np.array(out_starts), np.array(valid)


def n_best(text: str, pieces: dict[str, int], scores: np.ndarray, unknown: float, n: int, longest: int) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """The ``n`` best segmentations: (score, [(start, end, piece id or -1)]), best first.

    A forward Viterbi pass gives the exact best score of every prefix. An A-star
    search runs backward from the end of the text with those scores as its
    heuristic, so paths leave the queue in order of their total score. Ties go
    to the path found first, longer pieces before shorter ones.
    """
    size = len(text)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
    fwd = [0.0] + [NEG] * size
    for end in range(1, size + 1):
        for start in range(max(0, end - longest), end):
            i = pieces.get(text[start:end])
            if i is None:
                if start != end - 1:
                    continue
                i, s = -1, unknown
            else:
                s = float(scores[i])
            into[end].append((start, i, s))
            fwd[end] = max(fwd[end], fwd[start] + s)
    if not size:
        return [(0.0, [])]
    tick = 0
    queue: list[tuple[float, int, int, float, tuple | None]] = [(-fwd[size], 0, size, 0.0, None)]
    found = []
    while queue and len(found) < n:
        f, _, pos, g, path = heapq.heappop(queue)
        if pos == 0:
            steps = []
            while path is not None:
                steps.append(path[0])
                path = path[1]
            found.append((g, steps))
            continue
        for start, i, s in into[pos]:
            tick += 1
            heapq.heappush(queue, (-(g + s + fwd[start]), tick, start, g + s, ((start, pos, i), path)))
    return found
