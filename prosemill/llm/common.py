"""Helpers shared by the training-data operators: shared storage, table reads, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="prosemill-")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only on one machine (master local[...]) a local one is taken where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/prosemill-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage through Hadoop's file system API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_OPEN: list[list[str]] = []  #: folders of the scratch tables of the calls under way, the innermost last


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for lasting ones, which a returned plan still reads."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def materialize(df: DataFrame, path: str | None = None, lasting: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: lineage is cut and lost executors cost nothing."""
    if not path:
        path = shared_dir(df.sparkSession)
        if _OPEN and not lasting:
            _OPEN[-1].append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HUB = 1024  #: edges of a vertex that is joined apart from the others
HUBS_MOST = 100_000  #: such vertices at most, so their table (two numbers a row) can be broadcast


def _with_least(both: DataFrame, edges: int) -> DataFrame:
    """``both`` (a, b) with m, the least neighbour of a or a itself. Vertices with very many edges are joined by a broadcast, so that
    none of them gathers its edges in one task; there are ``HUBS_MOST`` of them at most, as no more have so large a share of all edges."""
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    most = max(HUB, 2 * edges // HUBS_MOST)
    hubs = low.where(F.col("n") > most).select("a", F.col("m").alias("hub"))
    marked = both.join(F.broadcast(hubs), "a", "left")
    rest = marked.where("hub is null").select("a", "b").join(low.where(F.col("n") <= most).select("a", "m"), "a")
    return rest.select("a", "b", "m").unionAll(marked.where("hub is not null").select("a", "b", "hub"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (vertex, smallest vertex that this task's edges reach from it)."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a is not None and b is not None:
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in list(up)]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])


def _shape(now: DataFrame) -> tuple[int, int, bool]:
    """Of edges from a vertex a to a smaller one b: how many, between how many vertices, and whether all are stars around their smallest."""
    ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    met = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    more = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    count, vertices, bent = met.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count("*"), F.coalesce(F.max(more), F.lit(False))).first()
    return count, vertices, not bent


def _hung(large: DataFrame, low: DataFrame) -> DataFrame:
    """Small stars of edges (a, b), every a above its b: a hangs below its smallest b, and so do its others. ``low``: (a, m)."""
    return large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def _few_joined(now: DataFrame) -> DataFrame:
    """A round over edges (a, b), every a above its b, of so few vertices that a row for each can be broadcast."""
    # The least neighbour of b is the least one below it, or b itself.
    up = now.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("b"), "up")
    large = now.join(F.broadcast(up), "b", "left").select("a", F.coalesce("up", "b").alias("b"))
    return _hung(large, F.broadcast(large.groupBy("a").agg(F.min("b").alias("m"))))


def _many_joined(now: DataFrame, edges: int) -> DataFrame:
    """A round over any number of edges (a, b), every a above its b."""
    both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _with_least(both, 2 * edges).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return _hung(large, large.groupBy("a").agg(F.min("b").alias("m")))


def components(edges: DataFrame, lasting: bool = False) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges`` (a, b): rows (node, component), vertices without an edge left out.

    The edges of each task are first united among themselves, which leaves at most one a vertex. Then alternating large-star and
    small-star steps (Kiveris et al., 2014), written as a minimum per vertex and a join, so that no
    neighbourhood is ever gathered; each round is written to the shared folder, and the one before it is deleted. The rounds end when
    all edges are stars, each vertex with one edge to a vertex without any, so edges that are stars at once need none. With
    ``HUBS_MOST`` vertices at most, the minima are broadcast to the edges, and three aggregates are all that a round shuffles. Nulls
    and loops are ignored.
    """
    spark, path = edges.sparkSession, shared_dir(edges.sparkSession)
    now = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_contracted, "a long, b long").distinct(), path)
    while True:
        count, vertices, stars = _shape(now)
        if stars:
            break
        last, path = path, shared_dir(spark)
        now = materialize(_few_joined(now) if vertices <= HUBS_MOST else _many_joined(now, count), path)
        remove(spark, last)
    if _OPEN and not lasting:
        _OPEN[-1].append(path)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
