"""Quality by compression: zstandard ratios of whole texts and of fixed chunks, judged by limits for their length, beside plain counts of words, lines and symbols."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prosemill.llm.common import table

LEVEL = 3
CHUNK = 4096  #: bytes of a chunk; a last one of less than half of that isn't judged
BLOCK = 4 << 20  #: bytes of texts that are counted together
LEAST_WORDS, MOST_REPEATED = 50, 50  #: words, and per cent of words in repeated windows


class Band(NamedTuple):
    """Limits of a ratio for texts below a number of bytes."""

    below: int
    low: float
    high: float


# Short texts carry the frame's bytes and have had little to refer to, so both limits fall with the length. Prose of any language stays
# between them; a paragraph copied over and over falls below, encoded or random characters stay above.
BANDS = [Band(512, 0.30, 0.95), Band(1024, 0.27, 0.88), Band(4096, 0.22, 0.78), Band(16384, 0.18, 0.70), Band(65536, 0.15, 0.66), Band(1 << 62, 0.10, 0.64)]
CHUNKS = Band(CHUNK + 1, 0.20, 0.72)  #: limits of a chunk
MOST_CHUNKS = 0.25  #: share of chunks outside of their limits that a text may have

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, odd_chunks long, kept boolean"


def _codes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal bytes; the words stand in ``data`` without anything between."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _numbered(keys: np.ndarray) -> np.ndarray:
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


def counts(texts: list[bytes]) -> np.ndarray:
    """A row of ``COUNTS`` for each text, all counted in one pass over the bytes of all."""
    n, sizes = len(texts), np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]) if n else np.empty(0, np.int64)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    owner = np.searchsorted(first, starts, "right") - 1
    data, lengths = raw[~space], ends - starts
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points begun
    stops = np.cumsum(lengths)
    chars = begins[stops] - begins[stops - lengths]
    out = np.zeros((n, len(COUNTS)), np.int64)
    out[:, 0] = np.bincount(owner, minlength=n)
    out[:, 1] = np.bincount(owner, chars, n)
    out[:, 2] = np.bincount(np.searchsorted(first, np.flatnonzero(_SYMBOL[raw]), "right") - 1, minlength=n)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 3] = len(lines) - len(set(lines))
    if len(owner) >= 3:
        code = _codes(np.ascontiguousarray(data), lengths)
        inside = owner[:-2] == owner[2:]
        # Windows by number: two words, then the third, then the text; each step is numbered anew, so no product leaves 64 bits.
        key = _numbered(code[:-2] * (code.max() + 1) + code[1:-1]) * (code.max() + 1) + code[2:]
        key = _numbered(_numbered(key[inside]) * n + owner[:-2][inside])
        at = np.flatnonzero(inside)[np.bincount(key)[key] > 1]
        covered = np.zeros(len(owner), bool)
        for k in range(3):
            covered[at + k] = True
        out[:, 4] = np.bincount(owner[covered], minlength=n)
    return out


def ratios(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Compressed size over size, of the whole and of each chunk; an empty text has ratio 1 and no chunk."""
    if not text:
        return 1.0, []
    pieces = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    return len(compressor.compress(text)) / len(text), [len(compressor.compress(p)) / len(p) for p in pieces if 2 * len(p) >= CHUNK]


def within(size: int, ratio: float, chunks: list[float]) -> tuple[bool, int]:
    """Whether the ratios of a text of ``size`` bytes are those of prose, and how many chunks are not."""
    band = next(b for b in BANDS if size < b.below)
    odd = sum(not CHUNKS.low <= r <= CHUNKS.high for r in chunks)
    return band.low <= ratio <= band.high and odd <= MOST_CHUNKS * len(chunks), odd


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts, base_failed, the ratio, the number of judged and of odd chunks, and kept.

    Words are runs of characters other than a blank and U+0009 to U+000D. base_failed marks fewer than 50 words, or more than half
    of them in windows of three that occur twice in the text. kept is false for these, else it says whether the whole text's ratio is inside the
    limits for its length and at most a quarter of its chunks leave theirs. A null or empty text has no words, so it fails;
    its ratio is 1. Rows that repeat are judged each by their own text; an empty table gives none. Columns of ``docs`` by the names of new
    ones are replaced. A text is read whole, whatever its length; shorter ones are counted in blocks of ``BLOCK`` bytes.
    """
    new = StructType.fromDDL(ADDED)
    kept = [c for c in docs.columns if c.lower() not in new.fieldNames()]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts: list[bytes] = []
                size = 0
                while first + len(texts) < batch.num_rows and (not texts or size < BLOCK):
                    texts.append((batch.column(at)[first + len(texts)].as_py() or "").encode("utf-8", "surrogatepass"))
                    size += len(texts[-1])
                n = counts(texts)
                failed = (n[:, 0] < LEAST_WORDS) | (100 * n[:, 4] > MOST_REPEATED * n[:, 0])
                judged = []
                for t in texts:
                    ratio, chunks = ratios(t, compressor)
                    judged.append((ratio, len(chunks), *reversed(within(len(t), ratio, chunks))))
                columns = [*n.T, failed, *([x[i] for x in judged] for i in range(3)), np.array([x[3] for x in judged]) & ~failed]
                rows = batch.slice(first, len(texts))
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, t) for c, t in zip(columns, types))], [*rows.schema.names, *new.fieldNames()])
                first += len(texts)

    return source.mapInArrow(run, StructType([*source.schema.fields, *new.fields]))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    found = assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "ratio", "n_chunks", "odd_chunks")
