"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; ``run`` writes every stage as Parquet in the shared
checkpoint folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonlake.llm import line_dedup, minhash, mixing, piece_codec, quality_model
from jsonlake.llm.common import remove_dir, stored, work_dir
from jsonlake.llm.queries import PIECES, QUALITY_THRESHOLD, labelled_domains, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects. Learns from all labelled documents but the held-out quarter."""
    model = quality_model.train_held_out(docs, table(spark, sf_dir, "labels"))
    return quality_model.keep(docs, model, QUALITY_THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that three or more documents hold from all but the last of them; n_chars follows the text."""
    names = docs.columns
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample toxic and low-quality text down to its share of a mixture that keeps all clean text."""
    targets = {"clean": 0.97, "toxic": 0.02, "low": 0.01}
    return mixing.resample(docs, mixing.mix(docs, labelled_domains(spark, sf_dir), targets, anchor="clean", max_rate=1.0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add piece ids and the results of encoding to every document."""
    return piece_codec.encode(docs, PIECES, n=4)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_copies),
    ("mixing to target weights", mixture),
    ("sentencepiece encoding", encoded),
]

#: The classifier and the piece lattice are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if k:
            remove_dir(spark, f"{folder}/{k - 1}")
    return docs
