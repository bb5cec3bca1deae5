"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="prosemill-")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(stream: DataFrame) -> DataFrame:
    """What a stream gives of all that is there now, written as Parquet beside its checkpoint and read again."""
    spark = stream.sparkSession
    at = folder(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read by column: what many plans share is neither recomputed nor held in memory.

    It stays in the folder that ``spark.checkpoint.dir`` names until that is cleared, as plans that are returned read it. Only on one
    machine a local folder is taken where that is unset.
    """
    spark = df.sparkSession
    path = folder(spark, "prose")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: where one partition holds more than 1.5 times a core's share of the rows, they are dealt anew.

    Partitions say little of that, as a file's row group is read by one task, however many get a part of its bytes. Rows are counted without
    their columns, a number a partition; an input that is even already is left as it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows, most, n = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count"), F.count("*")).first()
    return df if not rows or most * cores <= 1.5 * rows else df.repartition(max(4 * cores, n))
