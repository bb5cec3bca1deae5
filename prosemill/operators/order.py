"""Orders over rows that no task holds whole: a number for each row of a sorted table, and the first rows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.operators.storage import materialized

_SHIFT = 33  #: bits below the partition in Spark's increasing ids


def numbered(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    """``df`` with a column that numbers its rows from 0 in the order of ``keys``; the keys are to be unique, or equal rows are numbered in any order.

    Rows are dealt to partitions by ranges of the keys and sorted there, and written once. What is then counted is a row a partition; the counts
    before each partition, added to a row's place in its own, are its number, so nothing sorts or numbers the whole in one task. An empty
    table stays empty; a column of that name is replaced.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.drop(name).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    places = F.monotonically_increasing_id()
    made = materialized(sorted_.withColumns({"_part": F.shiftright(places, _SHIFT), "_at": places.bitwiseAND(F.lit((1 << _SHIFT) - 1))}))
    before, offsets = 0, []
    for r in made.groupBy("_part").count().orderBy("_part").collect():  # a row a partition
        offsets.append((r["_part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return made.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def first_paths(files: DataFrame, limit: int) -> list[str]:
    """The first ``limit`` paths of (path) in order; as many as the caller asks for come to the driver."""
    return [r["path"] for r in files.select("path").orderBy("path").limit(max(0, limit)).collect()]
