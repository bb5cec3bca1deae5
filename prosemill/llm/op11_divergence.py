"""Divergence of sources: triangular discrimination of term frequencies for every pair of a language's sources, and the terms that set a source apart.

All arithmetic is in integers. A pair's sum over all terms is split by the terms' spread over groups: terms of many groups are summed in dense numpy
tiles; the others by what they change against a sum in which no group holds them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, partitions, scratch, table

UNIT = 1_000_000_000  #: what a probability of 1 is
LEAST_DOCS = 10  #: documents of a language that a kept term occurs in
TOP = 10  #: terms reported for a group
HEAVY = 4  #: a term is heavy where this many times its groups are at least the language's groups
TILE, TERMS = 128, 512  #: groups on a tile's side, and about so many heavy terms in one
LIGHT = 8  #: blocks that a group's light terms are dealt to by p
SALT = 64  #: places that a group's terms are dealt to
HELD = 200_000  #: counts that a task holds before it sends them

#: Bytes that end a term as blanks, the others as they are but for capitals; bytes of other characters than ASCII belong to terms.
_FOLD = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of other characters beyond ASCII, with only A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, term, n, docs) that are still to be summed: a task adds up what it reads, ``HELD`` counts at most at a time."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (la, so), (n, d) in held.items():
                names = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([la] * len(names), pa.string()), pa.array([so] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array([n[t] for t in names], pa.int64()), pa.array([d[t] for t in names], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for la, so, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, d = held.setdefault((la, so), (Counter(), Counter()))
                before = len(n)
                n.update(found := terms(value.as_py()))
                d.update(set(found))
                size += len(n) - before
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    return read.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _p(n: str, total: str, kept: str) -> str:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), null without kept terms; the product may leave 64 bits, the quotient doesn't."""
    return f"1 + (cast({UNIT} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div nullif(cast({total} + 2 * {kept} as decimal(20,0)), 0)"


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of positive integers up to UNIT + 1, so that squares fit 64 bits."""
    return (p - q) ** 2 // (p + q)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that follow each other with equal first ``keys`` columns."""
    now, rows = None, []
    for row in chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches):
        if row[:keys] != now:
            if rows:
                yield rows
            now, rows = row[:keys], []
        rows.append(row)
    if rows:
        yield rows


_PAIRS = "lang string, a string, b string, value long"


def _sent(lang: list[str], a: list[str], b: list[str], value: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a tile's pairs. Rows: lang, low, high, block, kind, side, source, term, p, n, in this order of keys.

    Kind 0 is a group (p: of a term it lacks, n: light terms of the language), kind 1 a number n of its light terms with p, kind 2 a heavy term.
    """
    for rows in _runs(batches, 4):
        lang, low, high, block = rows[0][:4]
        names = {r[6]: i for i, r in enumerate(r for r in rows if r[4] == 0)}
        side, absent, light = (np.array([r[k] for r in rows if r[4] == 0], np.int64) for k in (5, 8, 9))
        total = np.zeros((len(names), len(names)), np.int64)
        if block < 0:
            none = apart(absent[:, None], absent[None, :])
            for _, _, _, _, kind, _, source, _, p, n in rows:
                if kind == 1:
                    i = names[source]
                    total[i] += n * (apart(np.int64(p), absent) - none[i])
            total += total.T.copy()
            if block == -1:
                total += light[:, None] * none
        else:
            held = [r for r in rows if r[4] == 2]
            places, own = pd.factorize(np.array([r[7] for r in held], object))
            p = np.repeat(absent[:, None], len(own), 1)
            p[[names[r[6]] for r in held], places] = [r[8] for r in held]
            for i in range(len(p)):
                total[i] = apart(p[i], p).sum(1)
        i, j = np.triu_indices(len(names), 1) if low == high else (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
        said = list(names)
        if len(i):
            yield _sent([lang] * len(i), [said[k] for k in i], [said[k] for k in j], total[i, j].tolist())


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What light terms add to the pairs of groups that both hold them. Rows: lang, term, source, p, p of a term that the group lacks; by lang and term.

    Such a pair stands in both groups' one-sided sums; the sum is put right by f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).
    """
    held: dict[tuple[str, str, str], int] = {}
    rest: pa.Table | None = None

    def add(t: pa.Table) -> None:
        key = [t.column(k).combine_chunks().dictionary_encode() for k in (0, 1, 2)]
        lang, term, source = (k.indices.to_numpy(zero_copy_only=False).astype(np.int64) for k in key)
        p, p0 = (t.column(k).to_numpy().astype(np.int64) for k in (3, 4))
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
        sizes = np.diff(np.concatenate([starts, [len(term)]]))
        langs, sources = key[0].dictionary.to_pylist(), key[2].dictionary.to_pylist()
        for k in np.unique(sizes[sizes > 1]).tolist():
            of = starts[sizes == k]
            a, b = np.triu_indices(k, 1)
            for lo in range(0, len(of), step := max(1, (1 << 20) // (k * k))):
                i, j = ((of[lo : lo + step, None] + x).ravel() for x in (a, b))
                value = apart(p[i], p[j]) - apart(p[i], p0[j]) - apart(p0[i], p[j]) + apart(p0[i], p0[j])
                which, inverse = np.unique((lang[i] * len(sources) + source[i]) * len(sources) + source[j], return_inverse=True)
                sums = np.zeros(len(which), np.int64)
                np.add.at(sums, inverse, value)
                for w, v in zip(which.tolist(), sums.tolist()):
                    pair = (langs[w // len(sources) ** 2], sources[w // len(sources) % len(sources)], sources[w % len(sources)])
                    held[pair] = held.get(pair, 0) + v

    def sent() -> Iterator[pa.RecordBatch]:
        if held:
            yield _sent(*([k[i] for k in held] for i in range(3)), list(held.values()))
            held.clear()

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = (t.column(0)[-1], t.column(1)[-1]) if t.num_rows else None
        cut = t.num_rows
        while cut and (t.column(0)[cut - 1], t.column(1)[cut - 1]) == last:
            cut -= 1
        if cut:
            add(t.slice(0, cut))
        rest = t.slice(cut)
        if len(held) > HELD:
            yield from sent()
    if rest is not None and rest.num_rows:
        add(rest)
    yield from sent()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from the other sources of its language, and the terms it uses more than the language.

    A null text, language or source is an empty one. A language keeps the terms that ``least_docs`` of its rows hold; p of a term in a group, and q
    in the language, are smoothed shares in units of 1e-9. Part ``pair``: value is the sum of floor((p - q)^2 / (p + q)) over all kept terms, q of the
    other source. Part ``term``: the ``top`` largest such values among the terms that the group holds with p above the language's q. A group
    without terms takes part with p of absent terms; without kept terms all pairs are 0. Rows that repeat count each; an empty table gives none;
    other columns are ignored.

    1. Counts are summed within tasks, then by (lang, term, source) in one shuffle; a window over (term, lang) finds the kept ones.
    2. A group's totals are joined by group and a part of the terms, so that a source with a third of all rows has no task of its own.
    3. Heavy terms (in a quarter of the groups or more) are summed in tiles of groups and terms, the pairs of tiles dealt out. Light terms enter as if no group
       held them, then by each group's number of terms with a p (one-sided, in the same tiles), then by postings where both hold one.
    Everything that is shuffled behind step 1 is bounded by groups and kept terms; pairs are as many as the result has rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))])
    with scratch(spark):
        summed = term_counts(docs, text, lang, source).repartition(n, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        one = W.partitionBy("term", "lang")
        spread = summed.withColumns({"all_docs": F.sum("docs").over(one), "all_n": F.sum("n").over(one), "spread": F.count("*").over(one), "first": (F.min("source").over(one) == F.col("source")).cast("int")})
        kept = materialize(spread.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n", "spread", "first"))
        groups = read.distinct()
        by_lang = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_total")), "lang", "left").na.fill(0, ["kept", "lang_total"])
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        stats = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(by_lang, "lang").withColumn("p0", F.coalesce(F.expr(_p("0", "total", "kept")), F.lit(1)))
        stats = materialize(stats)
        salted = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        scored = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int")).join(salted, ["lang", "source", "salt"])
        scored = materialize(scored.select("lang", "source", "salt", "term", "spread", "first", "groups", "p0", F.expr(_p("n", "total", "kept")).alias("p"), F.expr(_p("all_n", "lang_total", "kept")).alias("q")))
        best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        above = scored.where("p > q").select("lang", "source", "salt", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
        few = above.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "salt").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top).drop("salt")
        named = few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        pairs = _pair_sums(scored, stats).select(F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "lang", "value")
        ranked = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(best))
        return materialize(ranked.unionByName(named), lasting=True)


def _pair_sums(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every two groups of a language, a below b."""
    n = partitions(stats.sparkSession)
    heavy = F.col("spread") * HEAVY >= F.col("groups")
    blocks = scored.where((F.col("first") == 1) & heavy).groupBy("lang").agg(F.count("*").alias("heavy"))
    plan = stats.join(blocks, "lang", "left").na.fill(0, ["heavy"]).withColumns({"tiles": F.ceil(F.col("groups") / TILE), "blocks": F.ceil(F.col("heavy") / TERMS)})
    places = materialize(plan.select("lang", "source", "p0", "tiles", "blocks", (F.col("kept") - F.col("heavy")).alias("light"), F.pmod(F.xxhash64("source"), "tiles").alias("tile")))
    by_lang = places.select("lang", "tiles", "blocks").distinct()
    none = F.lit(None).cast("string")
    # The blocks below 0 hold light terms by p, those from 0 heavy ones.
    own = places.select("lang", "tiles", "tile", F.explode(F.sequence(F.lit(-LIGHT).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "source", none.alias("term"), F.col("p0").alias("p"), F.col("light").alias("n"))
    tile = F.pmod(F.xxhash64("source"), "tiles")
    sizes = scored.where(~heavy).groupBy("lang", "source", "p").agg(F.count("*").alias("n")).join(by_lang, "lang")
    sizes = sizes.select("lang", "tiles", tile.alias("tile"), (-1 - F.pmod(F.xxhash64("p"), F.lit(LIGHT))).alias("block"), F.lit(1).alias("kind"), "source", none.alias("term"), "p", "n")
    dense = scored.where(heavy).join(by_lang, "lang").select("lang", "tiles", tile.alias("tile"), F.pmod(F.xxhash64("term"), "blocks").alias("block"), F.lit(2).alias("kind"), "source", "term", "p", F.lit(1).cast("long").alias("n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    rows = own.unionByName(sizes).unionByName(dense).withColumn("other", other)
    rows = rows.select("lang", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "block", "kind", (F.col("tile") > F.col("other")).cast("int").alias("side"), "source", "term", "p", "n")
    keys = ["lang", "low", "high", "block"]
    tiled = rows.repartition(n, *keys).sortWithinPartitions(*keys, "kind").mapInArrow(_tiles, _PAIRS)
    shared = scored.where(~heavy & (F.col("spread") > 1)).select("lang", "term", "source", "p", "p0").repartition(n, "lang", "term").sortWithinPartitions("term", "lang", "source").mapInArrow(_corrections, _PAIRS)
    return tiled.unionByName(shared).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and terms of all groups of documents."""
    return divergence(table(spark, sf_dir, "documents"))


# The same in SQL: every kept term beside every group of its language, and these beside each other.
OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS kept, sum(lang_n) AS total FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, v.kept, v.total FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * kept) AS p, 1 + (1000000000 * (lang_n + 2)) // (total + 2 * kept) AS q FROM a),
s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY x.lang, x.source, y.source),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""
