"""Shared helpers: durable intermediate tables, word rules, document keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all machines share.

    Only where that setting is absent (local tests) a temporary folder of this
    machine takes its place; a cluster master without the setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lake-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_matching(spark: SparkSession, pattern: str) -> None:
    """Delete the files that a path with wildcards matches."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(where) or []:
        fs.delete(found.getPath(), True)


def give_back() -> None:
    """Return memory that Python and Arrow have freed to the machine.

    Spark uses Python workers again, so what one task leaves in their pools counts against its executor
    in all later ones. Only glibc has pools that must be asked; elsewhere just Arrow's are emptied.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free(names: list[str], wanted: str) -> str:
    """``wanted``, or the same with a tail where a column has that name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def key_pair(col: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string: together a 128-bit key."""
    return F.xxhash64(col), F.xxhash64(F.lit("second"), col)
