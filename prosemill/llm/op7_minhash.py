"""MinHash near-duplicates by min-max hashing: banded minima and maxima, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.llm.common import components, materialize, partitions, scratch, table

PERMUTATIONS = 60  #: each gives a minimum and a maximum: 120 signature values
VALUES = 2 * PERMUTATIONS
MISS = 1e-6  #: probability at most that no band brings a pair at the threshold together
#: Standard deviations of the signature's estimate below the threshold down to which a pair is compared on its full sets: of
#: pairs at the threshold some 1 in a million is lost by a third of the values, and fewer by all of them (binomial tails).
SLACK = 6.0
SIEVE_WORDS = 1 << 19  #: 64-bit words of the filter that picks the rows of wanted texts: 8 MB, whatever the number of texts
BLOCK = 512  #: texts in a block of a candidate group; a unit of work holds two blocks of texts
WIDE = 8  #: blocks whose signatures are compared at once, by one byte of each value


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z lowered, as UTF-8: ``bytes`` lowers and splits by exactly these ASCII rules."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words make one shingle, none make an empty set."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**32, PERMUTATIONS, np.uint32) | np.uint32(1), rng.integers(0, 2**32, PERMUTATIONS, np.uint32)


_A, _B = _multipliers()


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, alternating (uint32)."""
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 8192):  # blocks bound the memory of very long texts
            part = shingles[i : i + 8192]
            x, y = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
            h = x[None, :] * _A[:, None] + _B[:, None]
            h ^= h >> np.uint32(15)
            h += y[None, :]
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            h *= np.uint32(0x297A2D39)
            h ^= h >> np.uint32(15)
            np.minimum(low, h.min(1), out=low)
            np.maximum(high, h.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def rows_for(percent: int) -> int:
    """The most signature values in a band that miss a pair at the threshold with probability ``MISS`` at most: 5 at 85, 4 at 80."""
    fits = [r for r in range(1, VALUES + 1) if (1 - (percent / 100) ** r) ** (VALUES // r) <= MISS]
    return max(fits, default=1)


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature (a row)."""
    bands = VALUES // rows
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(sigs), 1))
        for k in range(rows):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + sigs[:, k : bands * rows : rows].astype(np.uint64))
    return out.view(np.int64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays; False when either is empty."""
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Forest:
    """Union-find over the members of one block pair."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = p = up.setdefault(p, p)
            x = p
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _least(percent: int, values: int) -> float:
    """Equal values, of so many, down to which a pair may be at the threshold: ``SLACK`` deviations below what is expected there."""
    t = percent / 100
    return t * values - SLACK * (t * (1 - t) * values) ** 0.5


def _likely(low: np.ndarray, sizes: np.ndarray, first: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the pairs that may reach the threshold: i below ``first`` with j at or above it, or all pairs if it is 0.

    ``low`` are the signatures' low bytes, one row a text: equal values have equal bytes, so they leave out no pair that the values
    don't. A third of the values is compared first, under the same slack; where few pairs pass, only these are looked at further.
    """
    begin, left, right = first, slice(0, first or len(sizes)), slice(first, len(sizes))
    a, b = np.ascontiguousarray(low[left].T), np.ascontiguousarray(low[right].T)
    same = np.zeros((a.shape[1], b.shape[1]), np.uint8)
    third = VALUES // 3
    for x, y in zip(a[:third], b[:third]):
        same += x[:, None] == y[None, :]
    i, j = np.nonzero(same >= _least(percent, third))
    if len(i) > 0.05 * same.size:
        for x, y in zip(a[third:], b[third:]):
            same += x[:, None] == y[None, :]
        i, j = np.nonzero(same >= _least(percent, VALUES))
        j = j + begin
    else:
        j = j + begin
        keep = np.concatenate([np.empty(0, bool), *[(low[i[k : k + 65536]] == low[j[k : k + 65536]]).sum(1) >= _least(percent, VALUES) for k in range(0, len(i), 65536)]])
        i, j = i[keep], j[keep]
    fits = (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])) & ((i < j) | (first > 0))
    return i[fits], j[fits]


def _links(ids: list[int], texts: list[str], sigs: np.ndarray, sizes: np.ndarray, first: int, n: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect the texts of two blocks (the second begins at ``first``) or of one, each confirmed on full shingle sets.

    Likely pairs are confirmed, likeliest first; pairs that earlier links connect already add nothing to the components and are
    passed over.
    """
    left, right = _likely(sigs.astype(np.uint8), sizes, first, percent)
    same = np.concatenate([np.empty(0), *[(sigs[left[k : k + 65536]] == sigs[right[k : k + 65536]]).mean(1) for k in range(0, len(left), 65536)]])
    forest, sets, out = _Forest(), {}, []
    for k in np.argsort(-same, kind="stable").tolist():
        i, j = int(left[k]), int(right[k])
        if forest.find(i) != forest.find(j):
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingle_set(texts[k], n)
            if jaccard_at_least(sets[i], sets[j], percent):
                forest.union(i, j)
                out.append((ids[i], ids[j]))
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per document; components of links with Jaccard >= percent / 100.

    1. Every text becomes its set of n-word shingles, a fingerprint of that set, and a min-max signature.
    2. Equal sets collapse into one class (summed before the shuffle), so copies never meet in pairs.
    3. In each band bucket every class is tied to the bucket's smallest class: components of these ties are the candidate groups.
    4. In a group of more than ``block`` classes, each class is first compared with the pivot of its largest bucket. What these links
       connect is one stream, if it is large, and not compared again inside: a group of near copies costs a comparison a text.
    5. A stream is cut into blocks of ``block`` by set size, and blocks are compared in pairs by signature. Two blocks whose sizes
       can't reach the threshold are not. Only texts that have a likely partner there follow, to be compared on full sets.
    6. Components over confirmed links and classes.

    A null text, an empty one and one of blanks has an empty set, is linked with nothing and stays. Rows with a null id are kept as
    documents of their own, with a null component. Rows that repeat an id count as one vertex, which has the links of all its
    texts. Other columns are ignored.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, prints, sigs = [], [], []
            for value in batch.column(2):
                s = shingle_set(value.as_py(), n)
                count.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(prints, pa.binary()), *(pa.array([x if x is None else x.astype(t).tobytes() for x in sigs], pa.binary()) for t in (np.uint32, np.uint8))], ["doc_id", "mark", "n_shingles", "print", "sig", "low"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    spark = docs.sparkSession
    with scratch(spark):
        signed = materialize(source.mapInArrow(sign, "doc_id long, mark long, n_shingles long, print binary, sig binary, low binary"))
        counts = materialize(signed.select("doc_id", "n_shingles"), lasting=True)
        found = components(_all_links(source, signed, n, percent, block), lasting=True)
    out = counts.join(found, counts.doc_id == found.node, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _all_links(source: DataFrame, signed: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) of ids: between the classes' representatives, and of each id with those of its classes."""
    live = signed.where("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal sizes and signatures; the text is that of any row of the smallest id.
    classes = live.groupBy("print").agg(F.min(F.struct("doc_id", "mark")).alias("lead"), F.min("n_shingles").alias("size"), F.first(F.struct("sig", "low")).alias("s"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "print", F.col("lead.doc_id").alias("rep"), F.col("lead.mark").alias("mark"), "size", "s.sig", "s.low"))
    links = _confirmed(source, classes, n, percent, block)
    same = live.select("doc_id", "print").join(classes.select("print", "rep"), "print").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return links.unionAll(same)


def _confirmed(source: DataFrame, classes: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) between the representatives of different classes, enough for their components."""
    spark, rows = source.sparkSession, rows_for(percent)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
            keys = band_keys(sigs, rows)
            number = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), pa.array(number), pa.array(keys.ravel())], ["cls", "band", "key"])

    keys = classes.select("cls", "sig").mapInArrow(bands, "cls long, band int, key long")
    first = keys.groupBy("band", "key").agg(F.min("cls").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    ties = materialize(keys.join(first, ["band", "key"]).where("cls <> pivot").select("cls", "pivot", "n"))
    groups = materialize(components(ties.select(F.col("cls").alias("a"), F.col("pivot").alias("b"))).select(F.col("node").alias("cls"), F.col("component").alias("grp")))
    large = materialize(groups.join(groups.groupBy("grp").count().where(F.col("count") > block).select("grp"), "grp", "left_semi"))
    # Without a large group nothing is dealt to pivots, and the texts needn't be read for it.
    by_pivot = spark.createDataFrame([], "a long, b long") if large.isEmpty() else _with_pivots(source, classes, ties.join(large, "cls"), n, percent, block)
    # Large connected parts of large groups are streams of their own; whatever else a group holds is its stream -1.
    parts = components(by_pivot).select(F.col("node").alias("cls"), F.col("component").alias("stream"))
    parts = parts.join(parts.groupBy("stream").count().where(F.col("count") > block).select("stream"), "stream", "left_semi")
    streams = groups.join(parts, "cls", "left").select("cls", "grp", F.coalesce("stream", F.lit(-1).cast("long")).alias("stream"))
    by_block = _within_blocks(source, classes, streams, n, percent, block)
    name = lambda k: classes.select(F.col("cls").alias(k), F.col("rep").alias(f"rep_{k}"))
    return by_pivot.unionAll(by_block).join(name("a"), "a").join(name("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _texts(source: DataFrame, classes: DataFrame, wanted: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``wanted`` (cls, ...) with ``more`` columns of its class and the class's text; a row of the source that is there twice gives the
    text once.

    Before texts are shuffled, a bit for each wanted hash picks their rows. The bits are at most ``SIEVE_WORDS`` rows of two numbers, so
    they can be broadcast; with very many wanted texts they pick more rows, and the join alone decides.
    """
    keyed = wanted.join(classes.select("cls", F.col("rep").alias("doc_id"), "mark", *more), "cls")
    word, bit = F.pmod(F.shiftrightunsigned("mark", 6), F.lit(SIEVE_WORDS)), F.expr("shiftleft(1L, cast(mark & 63 as int))")
    bits = keyed.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    picked = source.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")
    met = keyed.join(picked, ["doc_id", "mark"])
    return met.groupBy("doc_id", "mark", *wanted.columns).agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in more]).select(*wanted.columns, *more, "text")


def _with_pivots(source: DataFrame, classes: DataFrame, ties: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """Confirmed links (a, b) of classes with the pivot of the largest bucket that they are in."""
    pairs = ties.groupBy("cls").agg(F.max(F.struct("n", "pivot")).alias("p")).select("cls", F.col("p.pivot").alias("pivot"))
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("deals"))
    dealt = materialize(pairs.join(counts, "pivot").select("cls", "pivot", F.pmod(F.xxhash64("cls"), "deals").alias("deal"), F.lit(1).alias("side")))
    # A pivot goes to each of the deals of its classes.
    hubs = dealt.select("pivot", "deal").distinct().select(F.col("pivot").alias("cls"), "pivot", "deal", F.lit(0).alias("side"))
    rows = _texts(source, classes, dealt.unionByName(hubs))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            found = []
            for pivot, cls, side, value in zip(*(batch.column(c).to_pylist() for c in ("pivot", "cls", "side", "text"))):
                if not side:
                    hub, own = pivot, shingle_set(value, n)
                elif hub == pivot and jaccard_at_least(own, shingle_set(value, n), percent):
                    found.append((cls, pivot))
            yield _pairs(found)

    unit = ["pivot", "deal"]
    return materialize(rows.repartition(partitions(source.sparkSession), *unit).sortWithinPartitions(*unit, "side").mapInArrow(confirm, "a long, b long"))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])


def _within_blocks(source: DataFrame, classes: DataFrame, streams: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """Confirmed links (a, b) between classes of the same group that aren't of one large stream."""
    parts = partitions(source.sparkSession)
    sized = materialize(streams.join(classes.select("cls", "size"), "cls"))
    # Blocks by size within a stream: counts per size are summed first, so the running sum sees sizes, not texts.
    by_size = W.partitionBy("grp", "stream").orderBy("size")
    runs = sized.groupBy("grp", "stream", "size").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by_size.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A size's texts are dealt over as many blocks as its run spans.
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("cls"), F.col("n"))) / block).cast("long")
    blocked = materialize(sized.join(runs, ["grp", "stream", "size"]).select("cls", "grp", "size", "stream", place.alias("k"), F.struct("stream", F.floor(place / WIDE).alias("w")).alias("blk")))
    spans = blocked.groupBy("grp", "blk").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("n"))
    pair = (F.col("l.grp") == F.col("r.grp")) & (F.col("l.blk") <= F.col("r.blk")) & (F.col("r.low") * percent <= F.col("l.high") * 100) & (F.col("l.low") * percent <= F.col("r.high") * 100)
    met = (F.col("l.blk.stream") < 0) | (F.col("l.blk.stream") != F.col("r.blk.stream"))
    more = (F.col("l.blk") != F.col("r.blk")) | (F.col("l.n") > 1)
    pairs = spans.alias("l").join(spans.alias("r"), pair & met & more).select(F.col("l.grp").alias("grp"), F.col("l.blk").alias("i"), F.col("r.blk").alias("j"))
    units = pairs.select("grp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    named = lambda x, n: F.concat_ws(":", f"{x}.stream", f"{x}.{n}")
    work = blocked.join(units, ["grp", "blk"]).select("grp", named("i", "w").alias("ui"), named("j", "w").alias("uj"), (F.col("blk") > F.col("i")).alias("side"), "cls", "size", F.concat_ws(":", "stream", "k").alias("sub"))
    work = work.join(classes.select("cls", "low"), "cls").select("grp", "ui", "uj", "side", "cls", "size", "sub", "low")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        """Each unit (grp, ui, uj) with its rows, the first block's first."""
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if len(rows) > 1:
                        yield now, rows
                    now, rows = row[:3], []
                rows.append(row[3:])
        if len(rows) > 1:
            yield now, rows

    def start_of(rows: list[tuple]) -> int:
        sides = [r[0] for r in rows]
        return sides.index(True) if True in sides else 0

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _, _), rows in whole(batches):
            low, sizes = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, VALUES), np.array([r[2] for r in rows], np.int64)
            i, j = _likely(low, sizes, start_of(rows), percent)
            # Both texts of a pair go to the unit of their blocks, each text once.
            names, code = np.unique([r[3] for r in rows], return_inverse=True)
            u, v = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
            out = np.unique(np.concatenate([np.stack([u, v, i], 1), np.stack([u, v, j], 1)]), axis=0)
            if len(out):
                x, y, k = out.T
                columns = [[grp] * len(out), names[x].tolist(), names[y].tolist(), (x != y) & (code[k] == y), [rows[r][1] for r in k.tolist()], sizes[k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["grp", "ui", "uj", "side", "cls", "size"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in whole(batches):
            sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, VALUES)
            yield _pairs(_links([r[1] for r in rows], [r[4] for r in rows], sigs, np.array([r[2] for r in rows], np.int64), start_of(rows), n, percent))

    keys = ["grp", "ui", "uj"]
    active = materialize(work.repartition(parts, *keys).sortWithinPartitions(*keys, "side").mapInArrow(likely, "grp long, ui string, uj string, side boolean, cls long, size long"))
    texts = _texts(source, classes, active.distinct(), ("sig",)).select(*keys, "side", "cls", "size", "sig", "text")
    return materialize(texts.repartition(parts, *keys).sortWithinPartitions(*keys, "side").mapInArrow(confirm, "a long, b long"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: 3-word shingles, Jaccard 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


# All pairs that share a shingle, and the smallest id that walks along links reach; ids are unique in the tables.
OP7_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM t),
r AS (SELECT doc_id, n, a, lead(a) OVER q AS b, lead(a, 2) OVER q AS c, i FROM o WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c) AS shingle FROM r WHERE c IS NOT NULL OR (n < 3 AND i = 1)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
p AS (SELECT a, b FROM m JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.node WHERE c.low < l.b)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, f.component_id, f.component_id = d.doc_id AS kept FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id JOIN (SELECT node, min(low) AS component_id FROM c GROUP BY node) f ON f.node = d.doc_id"""
