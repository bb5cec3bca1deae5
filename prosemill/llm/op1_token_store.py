"""Token ids in a content-addressed store: chunks cut by a rolling hash, document recipes, Merkle manifests.

Files below one folder, all Parquet:

* ``staged/kind=chunk``: deal (the address: first 16 bytes of SHA-256 of the body), n_tokens, body (ids, little-endian, 2 or 4 bytes each). Each once.
* ``staged/kind=recipe``: the recipes as they were encoded, before they are put in order.
* ``recipes``: documents in ascending doc_id order, by part and row: part, row, doc_id, local_start, n_tokens, root, addresses, lengths, ends.
* ``manifest``: one row a part: documents, tokens, start of the part, and the Merkle root over its documents' roots.
* ``top``: one row: documents, tokens, and the root over the parts' roots.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.llm.common import partitions, shared_dir, table
from prosemill.llm.tokens import as_u32, encoder, tokenizer_path, with_end

END_ID = 2
MASK_BITS = 9  #: a cut after about 512 ids
CHUNK_LEAST, CHUNK_MOST = 64, 4096
LEAF = 1024  #: documents under one node of a part's Merkle tree


def _gear(size: int) -> np.ndarray:
    """A mixed 64-bit value for each token id."""
    with np.errstate(over="ignore"):
        x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def cuts(ids: np.ndarray, ends: np.ndarray, gear: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, of documents one behind the other: where the hash of the last 16 ids has ``MASK_BITS``
    zeros on top, within the size limits.

    A cut depends on the ids just before it alone, so a passage that two documents share is cut alike inside both. The first
    ``CHUNK_LEAST`` ids of a document aren't cut, so what stands before a document in ``ids`` has no say.
    """
    h = gear[ids]
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8):  # a window of 2, 4, 8 and 16 ids
            if len(h) > step:
                h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    stops = np.nonzero((h >> np.uint64(64 - MASK_BITS)) == 0)[0] + 1
    upto = np.searchsorted(stops, ends).tolist()
    stops, out, begin, k = stops.tolist(), [], 0, 0
    for end, to in zip(ends.tolist(), upto):
        last, own = begin, []
        for stop in [*stops[k:to], end]:
            while stop - last > CHUNK_MOST:
                last += CHUNK_MOST
                own.append(last)
            if stop - last >= CHUNK_LEAST or stop == end and stop > last:
                own.append(stop)
                last = stop
        out.append(own)
        begin, k = end, to
    return out


def address(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()[:16]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; leaves and inner nodes are hashed under different prefixes, an odd node moves up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_STAGED = "kind string, deal binary, doc_id long, n_tokens long, root binary, addresses array<binary>, lengths array<int>, ends array<long>, body binary"


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every document and writes the store to ``path``.

    One pass encodes and cuts; a task sends each chunk it meets once, and one exchange deals chunks by address and recipes by
    document and task. There, chunks lose the copies that other tasks sent. A hot chunk so costs one row a task, whatever its
    count, and copies of a document are dealt apart.

    A null text is an empty one: its document holds the end id alone. Null ids sort first; rows that repeat an id stay
    documents of their own, ordered by their content's root. Other columns are ignored. An empty table makes empty files.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    n = partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent, task = encoder(tokenizer), set(), TaskContext.get().partitionId()
        gear, width = _gear(max(enc.size, end_id + 1)), enc.dtype.itemsize
        for batch in batches:
            for i, j, ids, ends in enc.parts(batch.column(1)):
                docs = batch.column(0).slice(i, j - i)
                ids, ends = with_end(ids, ends, end_id)
                raw, begin = ids.tobytes(), 0
                new: tuple[list, list, list] = [], [], []
                roots, deals, marks, lengths, at, count = [], [], [], [], [], [0]
                for doc, end, own in zip(docs.to_pylist(), ends.tolist(), cuts(ids, ends, gear)):
                    last, first = begin, len(marks)
                    for stop in own:
                        body = raw[last * width : stop * width]
                        marks.append(mark := address(body))
                        lengths.append(stop - last)
                        at.append(stop - begin)
                        last = stop
                        if mark not in sent:
                            sent.add(mark)
                            for column, value in zip(new, (mark, lengths[-1], body)):
                                column.append(value)
                    roots.append(root := merkle(marks[first:]))
                    deals.append(address(b"%d %a " % (task, doc) + root))
                    count.append(len(marks))
                    begin = end
                yield _batch(kind=["chunk"] * len(new[0]), deal=new[0], n_tokens=new[1], body=new[2])
                lists = {k: pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(x, t)) for k, x, t in (("addresses", marks, pa.binary()), ("lengths", lengths, pa.int32()), ("ends", at, pa.int64()))}
                yield _batch(kind=["recipe"] * len(docs), deal=deals, doc_id=docs, n_tokens=np.diff(ends, prepend=0), root=roots, **lists)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = source.mapInArrow(encode, _STAGED).repartition(n, "deal")
    copy = F.row_number().over(W.partitionBy("deal").orderBy("kind"))
    dealt.withColumn("copy", copy).where("kind = 'recipe' or copy = 1").drop("copy").write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/staged")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            count = batch.column("n_tokens").to_numpy()
            before = np.concatenate([[0], np.cumsum(count)])
            head = [pa.array(np.full(len(count), part, np.int32)), pa.array(np.arange(row, row + len(count))), batch.column("doc_id"), pa.array(start + before[:-1])]
            row, start = row + len(count), start + int(before[-1])
            yield pa.RecordBatch.from_arrays([*head, *(batch.column(c) for c in ("n_tokens", "root", "addresses", "lengths", "ends"))], ["part", "row", "doc_id", "local_start", "n_tokens", "root", "addresses", "lengths", "ends"])

    staged = spark.read.schema(_STAGED).parquet(f"{path}/staged")
    # Rows that are equal but for the task they came from are interchangeable, and may be dealt to several parts.
    recipes = staged.where("kind = 'recipe'").select("doc_id", "n_tokens", "root", "addresses", "lengths", "ends", "deal")
    recipes = recipes.repartitionByRange(n, "doc_id", "root", "deal").sortWithinPartitions("doc_id", "root", "deal").drop("deal")
    recipes.mapInArrow(place, "part int, row long, doc_id long, local_start long, n_tokens long, root binary, addresses array<binary>, lengths array<int>, ends array<long>").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    _top(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/top")


def _root(order: str, value: Column) -> Column:
    """The hash over the hashes of all rows of a group, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("hex")))), lambda x: x["hex"]), ""), 256)


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row a part; a node gathers ``LEAF`` roots, a part its nodes."""
    nodes = recipes.groupBy("part", F.floor(F.col("row") / LEAF).alias("node")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), _root("row", F.hex("root")).alias("hash"))
    parts = nodes.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), _root("node", F.col("hash")).alias("root"))
    # One row a part meets here.
    return parts.withColumn("start", F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def _top(manifest: DataFrame) -> DataFrame:
    """The one row of the whole store: documents, tokens and the root over the parts' roots."""
    nodes = manifest.groupBy(F.floor(F.col("part") / LEAF).alias("node")).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), _root("part", F.col("root")).alias("hash"))
    return nodes.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), _root("node", F.col("hash")).alias("root"))


_TYPES = {"kind": pa.string(), "deal": pa.binary(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "root": pa.binary(), "addresses": pa.list_(pa.binary()), "lengths": pa.list_(pa.int32()), "ends": pa.list_(pa.int64()), "body": pa.binary()}


def _batch(**columns) -> pa.RecordBatch:
    """A batch of the staged schema; columns that aren't given are null."""
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in ((columns.get(k), t) for k, t in _TYPES.items())], list(_TYPES))


# CRC-32 of joined parts, from the parts' own: each is multiplied by x to the bits that follow it, modulo the polynomial.
_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, b = np.zeros_like(b), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _powers() -> list[np.ndarray]:
    out = [np.array([1 << 30], np.uint32)]
    for _ in range(31):
        out.append(_times(out[-1], out[-1]))
    return out


_X = _powers()


def crc_shifted(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """What a part with this CRC-32 adds (by exclusive or) to that of the whole, where so many 32-bit ids follow it."""
    out, left, k = crc.astype(np.uint32), ids_after.astype(np.int64).copy(), 5
    while (left > 0).any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = _times(np.broadcast_to(_X[k & 31], odd.sum()), out[odd])
        left >>= 1
        k += 1
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with a check: (address, n, crc); a body that doesn't match its address stops the job. The width of ids is that of the
    body over their number, so no tokenizer is loaded."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, lengths = [], []
            for mark, count, body in zip(*(c.to_pylist() for c in batch.columns)):
                if address(body) != mark or len(body) not in (2 * count, 4 * count):
                    raise ValueError(f"chunk {mark.hex()} is damaged")
                ids = np.frombuffer(body, f"<u{len(body) // count}")
                crcs.append(zlib.crc32(as_u32(ids)))
                lengths.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["address", "n", "crc"])

    chunks = spark.read.schema(_STAGED).parquet(f"{path}/staged").where("kind = 'chunk'")
    return chunks.select("deal", "n_tokens", "body").mapInArrow(check, "address binary, n long, crc long")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with their start in the whole; a part whose roots don't give the manifest's stops the job, as do parts that don't give the store's root."""
    recipes, manifest, top = (spark.read.parquet(f"{path}/{x}") for x in ("recipes", "manifest", "top"))
    if top.first() != _top(manifest).first():  # one row each
        raise ValueError("the manifest is damaged")
    again = _manifest(recipes).select("part", F.col("root").alias("again"))
    # The manifest has a row a partition: its size is that of the partitioning.
    parts = manifest.join(again, "part", "left").select("part", F.when(F.col("root").eqNullSafe(F.col("again")), F.col("start")).otherwise(F.raise_error(F.format_string("part %d is damaged", "part")).cast("long")).alias("part_start"))
    return recipes.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("local_start"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: each chunk is read and checked once, and a
    document's CRC-32 is put together from its chunks', so no ids are moved."""

    @F.pandas_udf("boolean")
    def rooted(addresses: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([merkle(list(a)) == r for a, r in zip(addresses, root)], dtype=bool)

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shifted(crc.to_numpy(), after.to_numpy()).astype(np.int64))

    recipes = read_recipes(spark, path)
    sound = recipes.withColumn("addresses", F.when(rooted("addresses", "root"), F.col("addresses")).otherwise(F.raise_error(F.format_string("the recipe of document %s is damaged", F.col("doc_id").cast("string"))).cast("array<binary>")))
    parts = sound.select("part", "row", "doc_id", "start", "n_tokens", F.explode(F.arrays_zip("addresses", "lengths", "ends")).alias("c"))
    parts = parts.select("part", "row", "doc_id", "start", "n_tokens", F.col("c.addresses").alias("address"), F.col("c.lengths").cast("long").alias("length"), (F.col("n_tokens") - F.col("c.ends")).alias("after"))
    met = parts.join(read_chunks(spark, path), "address", "left")
    sure = F.when(F.col("n") == F.col("length"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")).cast("long"))
    whole = met.withColumn("bits", shifted(sure, "after")).groupBy("part", "row", "doc_id", "start", "n_tokens").agg(F.bit_xor("bits").alias("ids_crc32"))
    return whole.select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame | None = None, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids binary) of the documents in ``wanted`` (or all): their chunks joined in order."""
    recipes = read_recipes(spark, path)
    if wanted is not None:
        recipes = recipes.join(wanted.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_semi")
    parts = recipes.select("part", "row", "doc_id", "start", F.posexplode("addresses").alias("pos", "deal"))
    chunks = spark.read.schema(_STAGED).parquet(f"{path}/staged").where("kind = 'chunk'").select("deal", "body")
    joined = parts.join(chunks, "deal").groupBy("part", "row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    return joined.select("doc_id", "start", F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["body"])).alias("ids"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into a store, and their digests read back from it."""
    path = shared_dir(spark)
    write_store(table(spark, sf_dir, "documents"), path)
    return verify(spark, path)
