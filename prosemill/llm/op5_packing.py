"""Best-fit packing by the sum-of-squares rule: a piece goes where the squared counts of open bins per gap become smallest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, table
from prosemill.llm.tokens import as_u32, encoder, tokenizer_path, with_end

CAPACITY = 4096
END_ID = 1
GROUP = 40_000  #: pieces that are packed together, on average; what a group can't fill costs a sequence or two


class Packed(NamedTuple):
    """pieces: (uid, doc_id, piece, start, length, ids binary); plan: (uid, piece, sequence_id, offset)."""

    pieces: DataFrame
    plan: DataFrame


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first.

    With N(g) open bins that have a gap of g, an item of size s moves a bin from g to g - s (a full bin is no longer open): the
    sum of N(g)^2 changes by 2 * (N(g - s) - N(g)) + 2, or by 1 - 2 * N(g) where it fills the bin. The smallest change wins and ties
    go to the smallest gap. A new bin begins only where no open one has room: all lengths are known, so no bin needs to be
    opened in advance, and 40,000 lengths of the test data then fill exactly their total over the capacity (35 more bins else).
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    far = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # Gaps s..capacity: 2 * (after - before) + 2, where a bin that becomes full counts nowhere.
        there = count[s:]
        change = 2 * (count[: capacity + 1 - s] - there) + 2
        change[0] = 1 - 2 * there[0]
        change[there == 0] = far
        g = int(change.argmin())
        if change[g] == far:
            g, b = capacity, made
            made += 1
        else:
            g += s
            b = open_bins[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> Packed:
    """Encodes, cuts documents longer than ``capacity`` into pieces, and packs all pieces.

    The pieces with their ids are written once; packing reads lengths alone, in groups that a hash deals evenly, whatever the
    documents' ids, sources or copies. Full pieces take a sequence each and are not packed.

    A null or empty text is a document with the end id alone. Rows that repeat an id, or have none, stay documents of their own.
    Ties in length keep the order of uid. An empty table gives empty results; other columns are ignored.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for i, j, ids, ends in enc.parts(batch.column(2)):
                ids, ends = with_end(ids, ends, end_id)
                size = np.diff(ends, prepend=0)
                count = -(-size // capacity)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.repeat(size, count) - start)
                # Pieces stand one behind the other in the ids, so their bytes are a view.
                at = np.concatenate([[0], np.cumsum(length)]) * enc.dtype.itemsize
                body = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(ids)]).cast(pa.binary())
                take = pa.array(np.repeat(np.arange(i, j), count))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), body], ["uid", "doc_id", "piece", "start", "length", "ids"])

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(source.mapInArrow(encode, "uid long, doc_id long, piece int, start long, length long, ids binary"))
    sizes = pieces.select("uid", "piece", "length")
    rest = sizes.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / GROUP))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "piece"])
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"uid": pdf["uid"], "piece": pdf["piece"], "sequence_id": bins * groups + key[0], "offset": offsets})

    loose = rest.groupBy(F.pmod(F.xxhash64("uid", "piece"), F.lit(groups)).alias("grp")).applyInPandas(place, "uid long, piece int, sequence_id long, offset long")
    # A full piece's sequence is numbered below zero by row and piece, apart from the packed ones.
    full = sizes.where(F.col("length") == capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).select("uid", "piece", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return Packed(pieces, materialize(loose.unionAll(full)))


def sequences(packed: Packed) -> DataFrame:
    """(sequence_id, length, ids binary): the packed sequences themselves."""
    joined = packed.plan.join(packed.pieces.select("uid", "piece", "length", "ids"), ["uid", "piece"])
    rows = joined.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", "length", F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return digests(pack(table(spark, sf_dir, "documents")))


def digests(packed: Packed, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or tokenizer_path()

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for batch in batches:
            crcs = pa.array([zlib.crc32(as_u32(np.frombuffer(b, dtype))) for b in batch.column("ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], crcs], [*batch.schema.names[:5], "ids_crc32"])

    pieces = packed.pieces.mapInArrow(crc, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")
    return pieces.join(packed.plan, ["uid", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
