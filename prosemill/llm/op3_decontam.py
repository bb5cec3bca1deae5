"""Benchmark decontamination: a BM25 index of test items with block-max WAND, queried by every passage of every text."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, table

K1, B = 1.2, 0.75
WINDOW, STRIDE = 80, 40  #: words of a passage; each run of up to 40 words lies whole in one passage
UNIT = 40  #: words of an index unit; a longer item is several units
THRESHOLD = 0.5  #: of a unit's own score, that a passage must reach
SHINGLE, OVERLAP = 5, 0.8  #: words of a shingle, and the share of an item's shingles that confirms it
BLOCK, BLOCKS_MOST = 4, 64  #: units under one maximum at least, and blocks of an index at most
INDEX_BYTES = 8 << 20  #: of benchmark text in one index; a larger benchmark is indexed and queried in as many shards
_WORD = re.compile(r"\w+")
_END = re.compile(r"[.?!\n]+")


class Index(NamedTuple):
    """An inverted index in blocks of units. Units of like weight stand together, so that a block's maxima are close to its units'."""

    terms: dict[str, int]
    most: np.ndarray  #: greatest weight of each term, and a 0 for words that no item has
    maxima: np.ndarray  #: greatest weight of each term in each block
    blocks: list[dict[int, tuple[list[int], list[float]]]]  #: postings of each block: term to units, ascending, and weights
    unit_item: list[int]  #: position of the item that a unit belongs to
    items: list[tuple[int, int, frozenset, frozenset]]  #: id, words, shingles of the question, shingles of the answer


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """What stands before the last sentence, and that sentence; up to the last question mark where there is one with text after it."""
    body = text.rstrip(" .?!\n\t")
    at = body.rfind("?") + 1 or max((m.end() for m in _END.finditer(body)), default=0)
    return body[:at], body[at:]


def _shingles(words: list[str]) -> frozenset:
    k = min(SHINGLE, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


class Counts(NamedTuple):
    """Counts over all units of a benchmark: units, their mean words, and the units that hold each term (of some terms at least)."""

    units: int
    mean: float
    holding: dict[str, int]


def units_of(text: str | None) -> list[Counter]:
    """A text's words in units of ``UNIT`` words or a little fewer."""
    words = words_of(text or "")
    size = math.ceil(len(words) / max(1, math.ceil(len(words) / UNIT)))
    return [Counter(words[i : i + size]) for i in range(0, len(words), size)] if words else []


def counted(texts: list[str]) -> Counts:
    units = [u for t in texts for u in units_of(t)]
    return Counts(len(units), sum(u.total() for u in units) / max(1, len(units)), Counter(t for u in units for t in u))


def build_index(items: list[tuple[int, str]], counts: Counts | None = None) -> Index:
    """Weights are BM25 of a term in a unit over the unit's score for itself: a passage that holds all of a unit scores 1.

    ``counts`` are those of the whole benchmark, of which ``items`` may be a part; by default the items are the whole.
    """
    counts = counts or counted([t for _, t in items])
    units: list[Counter] = []
    unit_item, kept = [], []
    for item, text in items:
        words = words_of(text or "")
        if not words:
            continue
        q = words_of(question_and_answer(text)[0])
        # The question's shingles begin in it and lie inside, or begin with it where it has fewer words than a shingle; the others
        # belong to the answer, so that both together are those of the whole item.
        whole, first = _shingles(words), _shingles(words[: max(SHINGLE, len(q))]) if q else frozenset()
        kept.append((item, len(words), first, whole - first))
        own = units_of(text)
        units += own
        unit_item += [len(kept) - 1] * len(own)
    n = len(units)
    weights: list[tuple[float, int, dict[str, float]]] = []
    for k, u in enumerate(units):
        norm = K1 * (1 - B + B * u.total() / counts.mean)
        weight = {t: math.log(1 + (counts.units - counts.holding[t] + 0.5) / (counts.holding[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in u.items()}
        total = sum(weight.values())
        weights.append((total, k, {t: w / total for t, w in weight.items()}))
    weights.sort(key=lambda x: x[:2])
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for u in units for t in u))}
    size = max(BLOCK, math.ceil(n / BLOCKS_MOST))
    count = math.ceil(n / size)
    maxima = np.zeros((len(terms) + 1, count), np.float32)
    lists: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in range(count)]
    for place, (_, k, by) in enumerate(weights):
        for t, w in by.items():
            lists[place // size][terms[t]].append((k, w))
            maxima[terms[t], place // size] = max(maxima[terms[t], place // size], w)
    blocks = [{t: tuple(map(list, zip(*sorted(ps)))) for t, ps in b.items()} for b in lists]
    return Index(terms, maxima.max(1, initial=0), maxima, blocks, unit_item, kept)


def wand(index: Index, rows: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(row, unit, score) of all units that reach the threshold for the passages in ``rows``, by block-max WAND.

    First the terms' greatest weights must sum to the threshold for a passage to be asked at all; then their maxima in a block, summed
    for all blocks of all passages at once, for the block to be live. Dead blocks are skipped whole; in a live one cursors move through
    the terms' postings (see ``_walk``). No unit is left out that reaches the threshold.
    """
    none, least = len(index.terms), threshold - 1e-5
    numbers = np.nonzero(index.most[rows].sum(1) >= least)[0]
    if not len(numbers):
        return []
    there = rows[numbers] < none
    flat, ends = rows[numbers][there], there.sum(1).cumsum()
    bounds = np.add.reduceat(index.maxima[flat], np.concatenate([[0], ends[:-1]]), axis=0)
    out = []
    for i, b in zip(*np.nonzero(bounds >= least)):
        postings, own = index.blocks[b], flat[ends[i - 1] if i else 0 : ends[i]]
        lists = [(most, *postings[t]) for t, most in zip(own.tolist(), index.maxima[own, b].tolist()) if most]
        out += [(int(numbers[i]), unit, score) for unit, score in _walk(lists, least)]
    return out


def _walk(lists: list[tuple[float, list[int], list[float]]], least: float) -> list[tuple[int, float]]:
    """(unit, score) of a block's units whose score is at least ``least``; lists are (maximum, units ascending, weights), one a term.

    A cursor stands in each list. In order of the units under them, the first cursor at which the maxima sum to ``least`` is the pivot:
    no unit before its own can reach it. Cursors before it jump there; when the first one stands there too, the unit is scored.
    """
    cursors, found, enough = [[units[0], 0, most, units, weights] for most, units, weights in lists], [], least - 1e-6
    while True:
        cursors.sort(key=itemgetter(0))
        bound, pivot = 0.0, None
        for cursor in cursors:
            bound += cursor[2]
            if bound >= enough:
                pivot = cursor[0]
                break
        if pivot is None:
            return found
        if cursors[0][0] == pivot:
            score, ended = 0.0, False
            for cursor in cursors:
                if cursor[0] != pivot:
                    break
                score += cursor[4][cursor[1]]
                ended |= not _moved(cursor, cursor[1] + 1)
            if score >= least:
                found.append((pivot, score))
        else:
            ended = False
            for cursor in cursors:
                if cursor[0] >= pivot:
                    break
                ended |= not _moved(cursor, bisect_left(cursor[3], pivot, cursor[1]))
        if ended:
            cursors = [c for c in cursors if c[0] is not None]


def _moved(cursor: list, at: int) -> bool:
    """Sets a cursor on a place of its list; behind the end it stands on nothing."""
    there = at < len(cursor[3])
    cursor[0], cursor[1] = cursor[3][at] if there else None, at
    return there


def passages(terms: np.ndarray, none: int) -> np.ndarray:
    """Rows of sorted term numbers, one for each passage; repeated terms and words that no item has are ``none``."""
    n = len(terms)
    count = max(1, math.ceil((n - WINDOW) / STRIDE) + 1) if n > WINDOW else 1
    padded = np.full((count - 1) * STRIDE + WINDOW, none, terms.dtype)
    padded[:n] = terms
    rows = np.sort(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE], axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
    return rows


PASSAGES_AT_ONCE = 2048


def _regions(hits: list[int], margin: int, n: int) -> list[tuple[int, int]]:
    """Runs of words around the passages that begin at ``hits``, each with ``margin`` words on both sides; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for at in sorted(hits):
        lo, hi = max(0, at - margin), min(n, at + WINDOW + margin)
        if out and lo <= out[-1][1]:
            lo = out.pop()[0]
        out.append((lo, hi))
    return out


def matches(index: Index, text: str, threshold: float, overlap: float) -> list[tuple[int, float, float | None, float]]:
    """(item, best score, question overlap, answer overlap) of the items that the text holds."""
    words = words_of(text)
    if not words or not index.items:
        return []
    none = len(index.terms)
    terms = np.fromiter(map(index.terms.get, words, repeat(none)), np.int32, len(words))
    best: dict[int, float] = {}
    where: dict[int, list[int]] = defaultdict(list)
    step = PASSAGES_AT_ONCE * STRIDE
    for i in range(0, len(terms), step):
        rows = passages(terms[i : i + step + WINDOW - STRIDE], none)
        for row, unit, score in wand(index, rows, threshold):
            item = index.unit_item[unit]
            best[item] = max(best.get(item, 0.0), score)
            where[item].append(i + row * STRIDE)
    out = []
    for item, score in best.items():
        name, size, q, a = index.items[item]
        # An item is confirmed in one place: around the passages that were found, by as many words as it has.
        found = []
        for lo, hi in _regions(where[item], size, len(words)):
            held = _shingles(words[lo:hi]) if size >= SHINGLE else set(zip(*(words[lo + j : hi] for j in range(size))))
            hits = [sum(g in held for g in s) for s in (q, a)]
            if sum(hits) >= overlap * (len(q) + len(a)) and all(h or not s for h, s in zip(hits, (q, a))):
                found.append((sum(hits), *hits))
        if found:
            _, in_q, in_a = max(found)
            out.append((name, round(score, 6), in_q / len(q) if q else None, in_a / len(a) if a else None))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for every test item found in a document.

    Every passage (80 words, every 40) of a whole text asks the index for all units that it covers by ``threshold`` of their BM25
    score. An item so found is confirmed if the text holds, around those passages, ``overlap`` of its five-word shingles, and some of
    the question's as well as of the answer's; the overlap of a part that an item hasn't got is null. Weights are those of the whole
    benchmark, however it is split: the index goes to the tasks in shards of at most ``INDEX_BYTES`` of benchmark text, and each
    shard reads the documents once.

    Null or empty texts and items match nothing. Documents that repeat an id give a row each; items that repeat an id are
    different items. Other columns are ignored.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in _indexes(benchmark, item_id, item_text):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(doc, *m) for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)) for m in matches(index.value, value.as_py() or "", threshold, overlap)]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = source.mapInArrow(search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionAll(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test item, by the rules of ``contaminated``; rows and columns are kept as they are and nothing is shuffled."""
    at, out = docs.columns.index(text), docs
    for index in _indexes(benchmark, item_id, item_text):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not matches(index.value, value.as_py() or "", threshold, overlap) for value in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def _indexes(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator:
    """Broadcast indexes over shards of at most ``INDEX_BYTES`` of text on average; an empty benchmark has an empty one.

    Of a benchmark in several shards, counts are made by Spark over all items, and a shard gets those of its own terms.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / INDEX_BYTES))
    if shards == 1:
        yield spark.sparkContext.broadcast(build_index([tuple(r) for r in items.orderBy("item_id", "text").collect()]))
        return
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(shard, t, 1) for u in units_of(text) for t in u] + [(shard, None, u.total()) for u in units_of(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["shard", "term", "n"])

    held = materialize(items.select("shard", "text").mapInArrow(terms, "shard int, term string, n long").groupBy("shard", "term").agg(F.count("*").alias("units"), F.sum("n").alias("words")))
    units, words = held.where("term is null").agg(F.sum("units"), F.sum("words")).first()
    everywhere = materialize(held.where("term is not null").groupBy("term").agg(F.sum("units").alias("units")))
    for k in range(shards):
        own = everywhere.join(held.where((F.col("shard") == k) & F.col("term").isNotNull()).select("term"), "term", "left_semi")
        counts = Counts(units or 0, (words or 0) / max(1, units or 0), {r["term"]: r["units"] for r in own.collect()})
        part = items.where(F.col("shard") == k).select("item_id", "text").orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(build_index([tuple(r) for r in part], counts))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
