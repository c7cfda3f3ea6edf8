"""Quality rules with cross-document line frequency.

Every line is normalised (white space stripped at both ends, A-Z lower-cased)
and hashed. A line that more distinct documents of one host hold than the limit
allows is boilerplate there and goes from all of them except the one with the
smallest doc_id, so that one copy of a widely copied text survives. The limits
are absolute, whatever the size of the host: ``short_docs`` documents for lines
of fewer than ``long_words`` words (menus, greetings), ``long_docs`` for longer
ones, which nobody writes twice. A document that loses ``max_lost`` or more of
its words is rejected as depleted, as is one that fails a base rule.

Texts are read once; line hashes with their word counts are stored and shuffled,
never texts. Counting is a partial aggregation, so a line or host that holds a
third of the rows is summed before the shuffle; the join that brings counts back
can be split (AQE). Lines are told apart by a 64-bit hash and their word count.

Edge cases: a null or blank text has no words and fails; a null host is a host
of its own; lines without a word are ignored. Every row is assessed by its own
whole text; rows that repeat a doc_id count as one holder of a line. A null
doc_id holds no line and loses none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, work_dir

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
EDGE = " \t\n\x0b\x0c\r"


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, inverse, count = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True, return_counts=True)
    hit = count[inverse.ravel()] > 1
    cover = np.zeros(n, dtype=bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at exactly these six white-space bytes
    blanks = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(EDGE)]
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(ids)


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_words(text: str | None) -> dict[bytes, tuple[int, int]]:
    """By normalised line with a word: its words, over all its places in the text and in one place."""
    own: dict[bytes, tuple[int, int]] = {}
    for line in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n"):
        n = len(line.split())
        if n:
            line = line.strip()
            own[line] = (own[line][0] + n if line in own else n, n)
    return own


def facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, row (hash of the text), host, base counts, lines (hash, words, each) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 2000):
                batch = whole.slice(at, 2000)
                counts, hashes, words, each, ends = [], [], [], [], [0]
                for x in batch.column("text"):
                    text = x.as_py()
                    counts.append(base_counts(text))
                    for line, (n, one) in line_words(text).items():
                        hashes.append(xxhash.xxh3_64_intdigest(line))
                        words.append(n)
                        each.append(one)
                    ends.append(len(hashes))
                got = np.array(counts, dtype=np.int64).reshape(-1, 5)
                lines = pa.StructArray.from_arrays([pa.array(hashes, pa.uint64()).view(pa.int64()), pa.array(words, pa.int64()), pa.array(each, pa.int64())], ["line", "words", "each"])
                columns = [*(batch.column(c) for c in ("doc_id", "row", "host")), *(pa.array(got[:, i]) for i in range(5)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "host", *COUNTS, "lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col(host).cast("string").alias("host"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, host string, {', '.join(f'{c} bigint' for c in COUNTS)}, lines array<struct<line:bigint,words:bigint,each:bigint>>")


def assess(docs: DataFrame, host: str = "source", short_docs: int = 10, long_docs: int = 2, long_words: int = 10, max_lost: float = 0.7, min_words: int = 50) -> DataFrame:
    """One result per row: doc_id, base counts, base_failed, lost_words, kept."""
    every = stored(facts(docs, host), work_dir(docs.sparkSession, "rules") + "/facts")
    lines = every.where(F.col("doc_id").isNotNull()).select("doc_id", "row", "host", F.explode("lines").alias("x")).select("doc_id", "row", "host", "x.*")
    # Rows that repeat a doc_id are one holder of a line.
    holders = lines.select("doc_id", "host", "line", "each").distinct().groupBy("host", "line", "each").agg(F.count("*").alias("__n"), F.min("doc_id").alias("__first"))
    over = holders.where(F.col("__n") > F.when(F.col("each") >= long_words, long_docs).otherwise(short_docs))
    over = over.select(F.col("host").alias("__h"), F.col("line").alias("__l"), F.col("each").alias("__e"), "__first")
    cut = lines.join(over, (F.col("line") == F.col("__l")) & (F.col("each") == F.col("__e")) & F.col("host").eqNullSafe(F.col("__h")) & (F.col("doc_id") != F.col("__first")))
    # Equal rows have equal lines; they count once for each of these rows.
    lost = cut.groupBy("doc_id", "row", "host", "line", "each").agg(F.max("words").alias("words")).groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.col("host").alias("__h")).agg(F.sum("words").alias("__lost"))
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return (
        every.drop("lines")
        .join(lost, (F.col("doc_id") == F.col("__doc")) & (F.col("row") == F.col("__row")) & F.col("host").eqNullSafe(F.col("__h")), "left")
        .withColumn("lost_words", F.coalesce("__lost", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") < F.lit(max_lost) * F.col("n_words")))
        .select("doc_id", *COUNTS, "base_failed", "lost_words", "kept")
    )
