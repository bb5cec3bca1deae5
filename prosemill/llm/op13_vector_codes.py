"""Vector codes: product quantization over integers, nearest entries by a kd-tree a codebook, codebooks updated by distributed integer sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 8  #: entries that a leaf of a tree holds at most
SMALL = 1 << 26  #: components below this are compared in 64 bits, larger ones as Python's integers
MOST = (1 << 62) - 1  #: beyond it a component counts as this
LONG = (1 << 63) - 1
CODEBOOK_MOST = 8 << 20  #: components in all codebooks together, so that the broadcast is bounded
HOT_MOST = 1000  #: labels whose sums are broadcast; each of the others has at most so small a share of the rows

Codebooks = dict[int, list[np.ndarray]]  #: by the vectors' length: a matrix of entries a part


class Node(NamedTuple):
    """A box (low, high) around entries; a leaf holds their places, ascending."""

    low: np.ndarray
    high: np.ndarray
    places: np.ndarray | None
    left: Node | None = None
    right: Node | None = None


class Compressed(NamedTuple):
    """rows: vec_id, label, width, code, error, codebooks_sha256; codebooks: the entries that the codes name."""

    rows: DataFrame
    codebooks: Codebooks


def exact(x: np.ndarray) -> np.ndarray:
    """``x`` in 64 bits where every square sum of differences fits, else as Python's integers."""
    if x.dtype == object or not x.size:
        return x
    return x if np.abs(x).max() < SMALL and x.shape[-1] < 256 else x.astype(object)


def tree(entries: np.ndarray, places: np.ndarray | None = None) -> Node:
    """A kd-tree over the rows of ``entries``: halves by the widest component."""
    places = np.arange(len(entries)) if places is None else places
    own = entries[places]
    low, high = own.min(0), own.max(0)
    if len(places) <= LEAF or not entries.shape[1] or (low == high).all():
        return Node(low, high, np.sort(places))
    order = places[np.argsort(own[:, int(np.argmax(high - low))], kind="stable")]
    half = len(order) // 2
    return Node(low, high, None, tree(entries, order[:half]), tree(entries, order[half:]))


def nearest(x: np.ndarray, entries: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x`` and its squared distance; of equal distances the lower place wins.

    Branch and bound over all rows at once: a node is visited by the rows whose bound to its box isn't above their best distance yet. Nodes at an
    equal bound are visited too, as they may hold an entry at the same distance with a lower place.
    """
    n, far = len(x), np.iinfo(np.int64).max if x.dtype != object else 1 << 4096
    best, at = np.full(n, far, x.dtype), np.zeros(n, np.int64)

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        away = np.maximum(np.maximum(node.low - x[rows], x[rows] - node.high), 0)
        return (away * away).sum(1) if x.shape[1] else np.zeros(len(rows), x.dtype)

    def visit(node: Node, rows: np.ndarray) -> None:
        if node.places is not None:
            for k in node.places:
                d = x[rows] - entries[k]
                d = (d * d).sum(1) if x.shape[1] else np.zeros(len(rows), x.dtype)
                better = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
                best[rows[better]], at[rows[better]] = d[better], k
            return
        to_left, to_right = bound(node.left, rows), bound(node.right, rows)
        first = (to_left <= to_right).astype(bool)
        for side in (first, ~first):
            for child, to in ((node.left, to_left), (node.right, to_right)) if side is first else ((node.right, to_right), (node.left, to_left)):
                mine = rows[side]
                if len(mine := mine[(to[side] <= best[mine]).astype(bool)]):
                    visit(child, mine)

    if n:
        visit(root, np.arange(n))
    return at, best


def cut(width: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where ``parts`` divides the width, else the first ones are one longer."""
    ends = np.cumsum([width // parts + (i < width % parts) for i in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def digest(entries: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for part in entries for row in part.tolist() for v in row).encode()).hexdigest()


def _whole(values: pa.ListArray | pa.LargeListArray, scale: int) -> list[list[int] | None]:
    """floor(scale * component) of each vector; None where the vector is null or has a null or non-finite component."""
    counts = np.diff(np.asarray(values.offsets))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.empty(0)
    out: list[list[int] | None] = [None] * len(values)
    if values.null_count:  # flatten() leaves a null list's values out
        counts = np.where(np.asarray(values.is_null()), 0, counts)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * scale)
        top = float(MOST + 1)
        whole = np.where(np.abs(scaled) < top, scaled, 0).astype(np.int64)
        whole[scaled >= top], whole[scaled <= -top] = MOST, -MOST
    fine, ends = np.isfinite(flat), np.cumsum(counts)
    good = np.concatenate([[0], np.cumsum(fine)])
    for i, (end, n, null) in enumerate(zip(ends.tolist(), counts.tolist(), values.is_null().to_pylist())):
        if not null and good[end] - good[end - n] == n:
            out[i] = whole[end - n : end]
    return out


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, matrix of their components) of a batch's lists of longs."""
    lists = batch.column(column)
    offsets, flat = np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False)
    widths = np.diff(offsets)
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        yield w, rows, flat[offsets[rows][:, None] + np.arange(w)] if w else np.empty((len(rows), 0), np.int64)


def _assigned(x: np.ndarray, parts: list[slice], entries: list[np.ndarray], trees: list[Node]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its components, places and distances."""
    for part, own, root in zip(parts, entries, trees):
        sub = x[:, part]
        if sub.dtype != object and own.dtype == object or exact(sub).dtype == object:
            sub = sub.astype(object)
        yield (sub, *nearest(sub, own, root))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> Compressed:
    """Codes and errors of all vectors that aren't null and hold no null or non-finite component; the other rows are left out.

    1. Components become floor(scale * x), written once to the shared folder.
    2. The codebooks of each length of vectors start as the parts of its ``entries`` smallest vec_ids, nulls left out; of rows
       that repeat an id the smallest vector counts. They are no larger than ``CODEBOOK_MOST`` components together, else a ValueError says so.
    3. Each round broadcasts a kd-tree a codebook. A task adds up components and counts of its own parts by entry and sends one row an entry; these
       integers are summed by Spark, so no order of rows changes them. An entry becomes the floor of its mean; one without a part stays.
    4. All parts are assigned once more: two hex digits a part (as many as the places need), and the sum of squared distances.

    Repeated rows are coded each. An empty table gives no rows and no codebooks, a vector of length 0 the code of zeros. Vectors of
    other lengths than a multiple of ``parts`` have first parts that are one longer. Components that leave 62 bits count as the largest such number, and an
    error that leaves 64 bits as the largest long. Other columns are ignored.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(2), scale)
            keep = [i for i, x in enumerate(whole) if x is not None]
            some = [whole[i] for i in keep]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *some])
            ids = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], ["vec_id", "label", "x"])

    with scratch(spark):
        ready = materialize(source.mapInArrow(prepare, "vec_id long, label string, x array<long>"))
        books = _first(ready, parts, entries)
        for _ in range(rounds):
            books = _updated(ready, books, parts)
        return Compressed(_coded(ready, books, parts, max(2, len(f"{max(entries, 1) - 1:x}"))), books)


def _first(ready: DataFrame, parts: int, entries: int) -> Codebooks:
    width = F.size("x")
    books: Codebooks = {}
    held = 0
    for w in (r[0] for r in ready.select(width.alias("w")).groupBy("w").count().orderBy("w").limit(CODEBOOK_MOST + 1).collect()):
        own = ready.where(width == w)
        ids = [r[0] for r in own.select("vec_id").dropna().distinct().orderBy("vec_id").limit(entries).collect()]
        rows = own.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect() if ids else []
        if not rows:  # no id at all: the smallest vectors
            rows = own.select("x").distinct().orderBy("x").limit(entries).collect()
        matrix = np.array([r["x"] for r in rows], np.int64).reshape(len(rows), w)
        held += matrix.size + len(rows)
        if held > CODEBOOK_MOST:
            raise ValueError(f"codebooks of more than {CODEBOOK_MOST} components can't be broadcast: too many lengths of vectors")
        books[w] = [exact(matrix[:, p]) for p in cut(w, parts)]
    return books


def _updated(ready: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    spark = ready.sparkSession
    sent = spark.sparkContext.broadcast({w: (cut(w, parts), own, [tree(e) for e in own]) for w, own in books.items()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for w, _, x in _by_width(batch, 0):
                for k, (sub, at, _) in enumerate(_assigned(x, *sent.value[w])):
                    size = len(sent.value[w][1][k])
                    n, total = sums.setdefault((w, k), (np.zeros(size, np.int64), np.zeros((size, sub.shape[1]), object)))
                    n += np.bincount(at, minlength=size)
                    if sub.dtype == object:
                        np.add.at(total, at, sub)
                    else:  # a batch's sums fit 64 bits, a task's may not
                        some = np.zeros(total.shape, np.int64)
                        np.add.at(some, at, sub)
                        total += some
        rows = [(w, k, e, int(n[e]), [Decimal(int(v)) for v in total[e]]) for (w, k), (n, total) in sums.items() for e in np.flatnonzero(n).tolist()]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["width", "part", "entry", "n", "total"])

    partial = ready.select("x").mapInArrow(add, "width int, part int, entry int, n long, total array<decimal(38,0)>")
    longest = max((p.stop - p.start for w in books for p in cut(w, parts)), default=0)
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(longest)]
    new = {w: [e.astype(object) for e in own] for w, own in books.items()}
    for r in partial.groupBy("width", "part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        own = new[r["width"]][r["part"]]
        own[r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(own.shape[1])]
    sent.unpersist()
    return {w: [exact(e.astype(np.int64)) for e in own] for w, own in new.items()}


def _coded(ready: DataFrame, books: Codebooks, parts: int, digits: int) -> DataFrame:
    sent = ready.sparkSession.sparkContext.broadcast({w: (cut(w, parts), own, [tree(e) for e in own], digest(own)) for w, own in books.items()})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, shas = (np.empty(batch.num_rows, object) for _ in range(3))
            for w, rows, x in _by_width(batch, 2):
                *how, sha = sent.value[w]
                found = [(at, far) for _, at, far in _assigned(x, *how)]
                hexes = [np.array([f"{i:0{digits}x}" for i in range(max(1, len(e)))], object) for e in how[1]]
                codes[rows] = np.sum([h[at] for h, (at, _) in zip(hexes, found)], 0)
                errors[rows] = [min(int(v), LONG) for v in np.sum([far.astype(object) for _, far in found], 0)]
                shas[rows] = sha
            width = pa.array(np.diff(np.asarray(batch.column(2).offsets)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), width, pa.array(codes, pa.string()), pa.array(errors, pa.int64()), pa.array(shas, pa.string())], ["vec_id", "label", "width", "code", "error", "codebooks_sha256"])

    return materialize(ready.mapInArrow(code, "vec_id long, label string, width int, code string, error long, codebooks_sha256 string"), lasting=True)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the errors of its label added up; null labels are one label.

    Sums are made before anything is joined. Those of the labels with more than a thousandth of the rows are broadcast (fewer than
    ``HOT_MOST``), so no label's rows meet in one task; the others are joined by label.
    """
    most = max(HOT_MOST, rows.count() // HOT_MOST)
    keyed = rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = materialize(keyed.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n")))
    sums = sums.withColumn("_sum", F.least("_sum", F.lit(LONG).cast("decimal(38,0)")).cast("long"))
    hot = F.broadcast(sums.where(F.col("_n") > most).select("_label", F.col("_sum").alias("label_error")))
    cold = sums.where(F.col("_n") <= most).select("_label", F.col("_sum").alias("label_error"))
    marked = keyed.join(hot, "_label", "left")
    rest = marked.where("label_error is null").drop("label_error").join(cold, "_label")
    return marked.where("label_error is not null").unionByName(rest).drop("_label")


def restored(rows: DataFrame, codebooks: Codebooks, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding): the vectors that the codes stand for, within the quantization's error; rows that repeat stay."""
    sent = rows.sparkSession.sparkContext.broadcast(codebooks)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, code in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own, step = sent.value[w], len(code) // parts
                out.append([v / scale for k, e in enumerate(own) for v in e[int(code[k * step : (k + 1) * step], 16)].tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return rows.select("vec_id", "width", "code").mapInArrow(back, "vec_id long, embedding array<double>")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, and the digest of the codebooks."""
    done = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(done.rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


# The same in SQL: every part beside every entry of its position, three times.
_ROUND = """d{k} AS (SELECT p.vec_id, p.pos, e.idx, p.part, list_sum(list_transform(range(1, len(p.part) + 1), lambda i: (p.part[i] - e.part[i]) * (p.part[i] - e.part[i]))) AS dist FROM p JOIN e{k} e ON e.pos = p.pos),
a{k} AS (SELECT vec_id, pos, any_value(part) AS part, min(dist * 64 + idx) % 64 AS idx, min(dist * 64 + idx) // 64 AS dist FROM d{k} GROUP BY vec_id, pos)"""
_UPDATE = """u{k} AS (SELECT pos, idx, c, sum(v) AS s, count(*) AS n FROM (SELECT pos, idx, unnest(range(1, len(part) + 1)) AS c, unnest(part) AS v FROM a{k}) GROUP BY pos, idx, c),
m{k} AS (SELECT pos, idx, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY c) AS part FROM u{k} GROUP BY pos, idx),
e{next} AS (SELECT e.pos, e.idx, coalesce(m.part, e.part) AS part FROM e{k} e LEFT JOIN m{k} m ON m.pos = e.pos AND m.idx = e.idx)"""
OP13_SQL = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, pos, x[pos * (len(x) // 16) + 1 : (pos + 1) * (len(x) // 16)] AS part FROM (SELECT vec_id, x, unnest(range(16)) AS pos FROM k)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM k ORDER BY vec_id LIMIT 64), e0 AS (SELECT pos, idx, part FROM p JOIN f USING (vec_id)),
{_ROUND.format(k=0)}, {_UPDATE.format(k=0, next=1)}, {_ROUND.format(k=1)}, {_UPDATE.format(k=1, next=2)}, {_ROUND.format(k=2)},
r AS (SELECT vec_id, string_agg(printf('%02x', CAST(idx AS INTEGER)), '' ORDER BY pos) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, idx)) AS sha FROM e2)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM r JOIN k ON k.vec_id = r.vec_id, h"""
