"""Embedding near-duplicates by sorted projection passes: vectors in order of their hashes, compared within windows of that order, pairs united over all passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import components, materialize, partitions, scratch, table

THRESHOLD = 0.93
MISS = 1e-6  #: probability at most that no pass brings a pair at the threshold together
BLOCK = 1024  #: vectors that stand side by side in the order; a window is a block and the next one
BITS_LEAST, BITS_MOST = 1, 32  #: signs in a code
BITS_SMALL = 8  #: signs of a label that fits a block
PASSES_LEAST = 2
SHIP, COMPARE = 30.0, 0.03  #: microseconds that a vector costs each time it is sent, and a pair that is compared
TOGETHER = 8  #: passes in one job
SEED = 7
LABELS_BROADCAST = 100_000  #: labels whose sizes are broadcast; of more they are joined by label


def planes(dim: int, bits: int, passes: int) -> np.ndarray:
    """Projections of all passes, ``bits`` rows each."""
    return np.random.default_rng([SEED, bits, dim]).standard_normal((passes * bits, dim))


def plan(n: int, threshold: float, passes: int = PASSES_LEAST) -> tuple[int, int]:
    """Signs in a code and passes for ``n`` vectors of a label, at least cost for the miss probability; ``passes`` is a least number.

    A label that fits a block has all its pairs inside one window of the first pass, so it needs no more passes than asked for. In others a pair is
    sure to meet in a pass where it shares its whole code, and the passes are as many as leave it without one with probability ``MISS``.
    """
    agree = 1 - np.arccos(np.clip(threshold, -1, 1 - 1e-9)) / np.pi
    if n <= BLOCK:
        return BITS_SMALL, max(1, passes)
    options = []
    for bits in range(BITS_LEAST, BITS_MOST + 1):
        if (both := agree**bits) > 1e-9:
            need = max(passes, int(np.ceil(np.log(MISS) / np.log1p(-both))))
            run = n / 2**bits  # it is sent to be sorted, to two windows, and once for each block of its run beyond these
            options.append((need * (SHIP * (3 + max(0, run / BLOCK - 2)) + (2 * BLOCK + run) * COMPARE), bits, need))
    # A threshold that opposite vectors meet leaves no code to share: one run holds them all.
    return min(options)[1:] if options else (0, 1)


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None where it is null, empty, zero or has a null or non-finite component."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # so that squares neither overflow nor vanish
    return x / np.sqrt(x @ x)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES_LEAST, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per vector: links are pairs of the same label with cosine >= threshold.

    1. Equal vectors of a label are one class, which meets no other copy of itself; its ids are counted.
    2. In each pass a class has a code, the signs of random projections one behind the other. The classes of a label are sorted by
       it, lexicographically, dealt by ranges and cut into blocks of ``BLOCK``; a block is compared with itself and the next one.
    3. A run of one code that is longer than such a window is compared in full, in pairs of blocks, so a dense group loses no pair.
    4. From the counted size of a label, ``plan`` takes the signs and the passes that leave a pair at the threshold without a shared code with
       probability ``MISS`` at most; windows find pairs beyond these. All labels pass through the same steps.
    5. A pair is counted once: by the window of the first pass, else by the first pass in which it shares a code, else once for all
       windows. Tasks return numbers of links and spanning forests, not pairs, but for those of the last kind. The forests are united.

    Vectors that are null, zero or hold null or non-finite components, and those with a null label or id, link with nothing. Rows that
    repeat an id are vectors each: they have links of their own, and the id's component is that of all of them; equal ones count once among
    the links of others. Vectors of different lengths never link. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x if x is None else x.tobytes() for x in map(unit, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    with scratch(spark):
        ready = materialize(source.mapInArrow(prepare, "vec_id long, label string, unit binary").withColumn("row", F.monotonically_increasing_id()))
        live = ready.where("unit is not null and label is not null and vec_id is not null")
        classes = materialize(live.select("label", "unit", "vec_id").distinct().groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()))
        members = materialize(live.join(classes, ["label", "unit"]).select("row", "vec_id", "class", "rep", "n"))
        found = _found(classes, threshold, passes)
        linked = found.where("linked > 0").groupBy("class").agg(F.sum("linked").alias("linked"))
        several = members.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("vec_id")
        same_id = members.join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
        edges = found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")).unionAll(same_id)
        united = components(edges).select(F.col("node").alias("rep"), "component")
        placed = members.join(linked, "class", "left").join(united, "rep", "left")
        rows = placed.select("row", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        # A vector without links of its own is in the component of its id's others.
        by_id = placed.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.coalesce("component", "rep")).alias("of_id"))
        out = materialize(ready.select("row", "vec_id").join(rows, "row", "left").join(by_id, "vec_id", "left"), lasting=True)
    component = F.coalesce("component_id", "of_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


_ROWS = "class long, rep long, linked long, root long, other long"


def _found(classes: DataFrame, threshold: float, passes: int) -> DataFrame:
    """Rows (class, rep, linked, root): links to add to a class, counted in ids, and the rep of a class that it is united with."""
    spark = classes.sparkSession
    n = partitions(spark)
    # The plan of every size below a power of two.
    plans = [plan(2**i, threshold, passes) for i in range(64)]
    at = F.length(F.bin("size"))
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in plans]), at + 1)
    width = F.octet_length("unit")
    sizes = classes.groupBy("label", width.alias("width")).agg(F.count("*").alias("size"))
    sized = classes.withColumn("width", width).join(F.broadcast(sizes) if sizes.count() <= LABELS_BROADCAST else sizes, ["label", "width"])
    sized = sized.select("class", "rep", "n", "label", "width", "unit", pick(0).alias("bits"), pick(1).alias("passes"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            codes = []
            for raw, bits, number in zip(*(batch.column(c).to_pylist() for c in ("unit", "bits", "passes"))):
                x = np.frombuffer(raw, np.float64)
                if (key := (len(x), bits, number)) not in known:
                    known[key] = planes(*key)
                signs = (known[key] @ x > 0).reshape(number, bits)
                # The first sign is the highest bit, so numbers are in order of the signs.
                codes.append((signs @ (1 << np.arange(bits, dtype=np.int64)[::-1])).astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "codes"])

    coded = materialize(sized.mapInArrow(hashed, "class long, rep long, n long, label string, width int, unit binary, bits int, passes int, codes binary"))
    most = coded.agg(F.max("passes")).first()[0] or 0
    work = ["low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != now:
                    yield from _linked(rows, threshold)
                    now, rows = row[:2], []
                rows.append(row[2:])
        yield from _linked(rows, threshold)

    found, base = [], None
    for first, many in [(0, 1), *((k, TOGETHER) for k in range(1, most, TOGETHER))]:
        if first >= most:
            break
        numbers = F.sequence(F.lit(first), F.least(F.col("passes"), F.lit(first + many)) - 1)
        rows = (coded if base is None else base).where(F.col("passes") > first).withColumn("pass", F.explode(numbers)).withColumn("code", F.expr("substring(codes, 4 * pass + 1, 4)"))
        placed = _blocks(rows)
        if base is None:
            base = placed.drop("pass", "code").withColumnRenamed("block", "home")
            placed = placed.withColumn("home", F.col("block"))
        # A window: a block with itself and with the next one, in order of the whole.
        windows = placed.withColumn("at", F.explode(F.array(F.struct(F.col("block").alias("low"), (F.col("block") + 1).alias("high"), F.lit(0).alias("side")), F.struct((F.col("block") - 1).alias("low"), F.col("block").alias("high"), F.lit(1).alias("side"))))).select("*", "at.*").drop("at").withColumn("far", F.lit(False))
        # Runs of a code over three blocks or more: the pairs of their blocks that no window holds.
        key = ["label", "width", "pass", "code"]
        runs = placed.groupBy(*key).agg(F.min("block").alias("begin"), F.max("block").alias("end")).where("end - begin > 1")
        other = F.explode(F.filter(F.sequence("begin", "end"), lambda b: F.abs(b - F.col("block")) > 1))
        inside = placed.join(runs, key).withColumn("other", other).select(*placed.columns, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), F.lit(True).alias("far"))
        units = windows.unionByName(inside).select(*work, "side", "far", "label", "width", "pass", "code", "home", "codes", "class", "rep", "n", "unit")
        found.append(materialize(units.repartition(n, *work).sortWithinPartitions(*work, "side").mapInArrow(compare, _ROWS)))
    if not found:
        return spark.createDataFrame([], "class long, rep long, linked long, root long")
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    counted = every.where("other is null").select("class", "rep", "linked", "root")
    # Pairs that only windows of later passes hold, each from both sides, once for all passes.
    pairs = every.where("other is not null").groupBy("class", "rep", "other").agg(F.max("linked").alias("linked"), F.max("root").alias("root"))
    return counted.unionAll(pairs.select("class", "rep", "linked", "root"))


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with their block in the order of (pass, label, width, code): dealt by ranges and sorted, then numbered by the counts of the
    partitions before their own, a row a partition."""
    spark = rows.sparkSession
    order = ["pass", "label", "width", "code", "class"]
    ids = F.monotonically_increasing_id()
    made = materialize(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(ids, 33), "_at": ids.bitwiseAND(F.lit((1 << 33) - 1))}))
    before, starts = 0, []
    for r in made.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    return made.join(F.broadcast(offsets), "_part").withColumn("block", F.floor((F.col("_before") + F.col("_at")) / BLOCK)).drop("_part", "_at", "_before")


def _linked(rows: list[tuple], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links and forest of a window, or of two blocks of a run; rows (side, far, label, width, pass, code, home, codes, class, rep, n, unit), side 0 first.

    A window compares its block (side 0) with itself and with the next one (side 1), two blocks of a run only with each other.
    """
    far, sides = bool(rows and rows[0][1]), [r[0] for r in rows]
    if len(rows) < 2 or not (0 in sides) or (far and 1 not in sides):
        return
    by: dict[tuple, list[tuple]] = {}
    for r in rows:  # vectors of one label, length and pass, and in a run of one code
        by.setdefault((*r[2:5], r[5] if far else b""), []).append(r)
    for own in by.values():
        yield from _compared(own, far, threshold)


def _compared(rows: list[tuple], far: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    side = np.array([r[0] for r in rows])
    mine_all, theirs_all = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(mine_all) or len(rows) < 2:
        return
    now = rows[0][4]
    code = np.frombuffer(b"".join(r[5] for r in rows), ">u4").astype(np.uint32)
    home = np.array([r[6] for r in rows], np.int64)
    codes = np.frombuffer(b"".join(r[7] for r in rows), ">u4").astype(np.uint32).reshape(len(rows), -1)
    cls, rep, count = (np.array([r[k] for r in rows], np.int64) for k in (8, 9, 10))
    x = np.frombuffer(b"".join(r[11] for r in rows), np.float64).reshape(len(rows), -1)
    linked, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    lone: list[tuple[np.ndarray, np.ndarray]] = []
    others = theirs_all if far else np.concatenate([mine_all, theirs_all])
    for lo in range(0, len(mine_all), BLOCK):
        mine = mine_all[lo : lo + BLOCK]
        for to in range(0, len(others), BLOCK):
            theirs = others[to : to + BLOCK]
            near = x[mine] @ x[theirs].T
            new = near >= threshold - 1e-9
            new &= (side[theirs] == 1)[None, :] | (mine[:, None] < theirs[None, :])
            if now:  # windows of the first pass have counted their pairs
                new &= np.abs(home[mine][:, None] - home[theirs][None, :]) > 1
                for k in range(now):
                    if not new.any():
                        break
                    new &= codes[mine, k][:, None] != codes[theirs, k][None, :]
            # The last bits of a product of matrices depend on their shapes; a sum by rows gives a pair at the threshold the same cosine anywhere.
            i, j = np.nonzero(new & (near < threshold + 1e-9))
            for k in range(0, len(i), 65536):
                own, its = i[k : k + 65536], j[k : k + 65536]
                new[own, its] = (x[mine[own]] * x[theirs[its]]).sum(1) >= threshold
            if now and new.any():
                # Pairs of other codes that share one in a later pass are counted there; those that share none are told one by one.
                apart = code[mine][:, None] != code[theirs][None, :]
                i, j = np.nonzero(new & apart)
                alone = (codes[mine[i]] != codes[theirs[j]]).all(1)
                lone.append((mine[i[alone]], theirs[j[alone]]))
                new &= ~apart
            linked[mine] += (new * count[theirs][None, :]).sum(1)
            linked[theirs] += (new * count[mine][:, None]).sum(0)
            i, j = np.nonzero(new)
            i, j = mine[i], theirs[j]
            while len(i):
                a, b = root[i], root[j]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root != (up := root[root])).any():
                    root = up
    names = ["class", "rep", "linked", "root", "other"]
    some = linked > 0
    if some.any():
        yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(rep[some]), pa.array(linked[some]), pa.array(rep[root[some]]), pa.nulls(int(some.sum()), pa.int64())], names)
    for i, j in lone:
        if len(i):
            a, b = np.concatenate([i, j]), np.concatenate([j, i])
            yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(rep[a]), pa.array(count[b]), pa.array(rep[b]), pa.array(cls[b])], names)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of a label at cosine 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


# All pairs of a label, and the smallest id that walks along links reach; ids are unique in the table.
OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
c AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.node WHERE c.low < l.b)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, f.component_id, f.component_id = e.vec_id AS kept FROM embeddings e JOIN (SELECT node, min(low) AS component_id FROM c GROUP BY node) f ON f.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) n ON n.a = e.vec_id"""
