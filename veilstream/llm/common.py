"""Helpers shared by the training-data operators: table access, shared folder, sizing, interval and hash kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions: blank and the bytes 9 to 13.
ASCII_SPACE = r"[\x20\x09-\x0D]"
#: What parts words, as a Java pattern.
ASCII_APART = ASCII_SPACE + "+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as can run at once, where a table has too few parts for that (one row group is one
    task).  Larger tables have more parts and stay as they are."""
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= want else df.repartition(want)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one of its own in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def n_words(text: Column) -> Column:
    """How many words a text has (null for null)."""
    return F.size(F.array_remove(F.split(text, ASCII_APART), ""))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes the groups that later steps hold in one task."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])


def sha_hex(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers live on from task to task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
