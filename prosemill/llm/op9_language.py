"""Language by compression: the language whose zstandard dictionary makes a text smallest, rejected where the margin is narrow."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prosemill.llm.common import table

DICTIONARY_BYTES = 112 * 1024  #: of raw text a language; what a dictionary holds at most
MODEL_BYTES = 64 << 20  #: of all dictionaries together, which go to every executor
LANGUAGES_MOST = 16_384  #: labels, so that no dictionary is shorter than 4 KB
PIECE_CHARS = 256  #: code points that a sampled text gives
SAMPLE_TEXTS = 1024  #: texts sampled for a language, where there are as many
LEVEL = 5
MARGIN = 0.02  #: by which the second smallest must exceed the smallest, as a share of it
BYTES = 1 << 16  #: bytes compressed at once; a longer text is compressed piece by piece, and its sizes are summed
UNKNOWN = "und"


class Model(NamedTuple):
    """Languages, the most frequent first, and their dictionaries."""

    languages: list[str]
    dictionaries: list[bytes]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", order: str = "doc_id") -> Model:
    """A raw-content dictionary for each language: pieces of its texts, in lower case, one behind the other.

    Every language that has a labelled text is learned: one count and one bounded dictionary each come to the driver. The sample
    is bounded by ``SAMPLE_TEXTS``, chosen by a hash of ``order`` and text, and the same in every run; a text gives ``PIECE_CHARS``
    code points from a place that the hash names, so long texts take part as any other. Equal rows give one piece. Texts that
    are null or empty give none. All dictionaries together hold ``MODEL_BYTES`` at most: of more languages than have room at full size each gets an
    equal share, and of more than ``LANGUAGES_MOST`` a ValueError says so. Without labelled texts the model is empty and predicts ``und``.
    """
    whole = F.col(text)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), whole.alias("text"), F.xxhash64(F.col(order), whole).alias("h")).where("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES_MOST + 1).collect()}
    if len(counts) > LANGUAGES_MOST:
        raise ValueError(f"more than {LANGUAGES_MOST} values of {lang}: a model of so many can't be broadcast")
    if not counts:
        return Model([], [])
    # A first choice by the hash leaves some twice the sample a language (by chance less than a sample once in many runs); of these the
    # smallest hashes stay. So what a window sees of a language is bounded.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(max(1, n // (2 * SAMPLE_TEXTS))))])
    at = F.pmod(F.shiftrightunsigned("h", 20), F.greatest(F.length("text") - PIECE_CHARS + 1, F.lit(1))).cast("int") + 1
    few = rows.where(F.pmod("h", F.element_at(share, F.col("lang"))) == 0).select("lang", "h", F.substring(F.col("text"), at, F.lit(PIECE_CHARS)).alias("piece")).distinct()
    chosen = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "piece"))).where(F.col("k") <= SAMPLE_TEXTS).collect()
    names = sorted(counts, key=lambda k: (-counts[k], k))
    content: dict[str, list[bytes]] = {k: [] for k in names}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["k"])):
        content[r["lang"]].append(r["piece"].lower().encode("utf-8", "surrogatepass"))
    most = min(DICTIONARY_BYTES, MODEL_BYTES // len(names))
    return Model(names, [b" ".join(content[k])[:most] for k in names])


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in model.dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    data = text.lower().encode("utf-8", "surrogatepass")
    pieces = [data[i : i + BYTES] for i in range(0, len(data), BYTES)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def classify(docs: DataFrame, model: Model, margin: float = MARGIN, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected, from the whole text alone.

    The score is the margin of the smallest size over the second smallest, as a share of the latter, scaled so that four times
    ``margin`` makes 1; with one language only it is 1. A text is rejected where that share is below ``margin``, or where it is null or
    has no letter: then lang_pred is ``und`` and the score 0. Ties go to the language with more labelled texts. Columns of ``docs`` by the
    names of new ones are replaced; an empty model predicts ``und``.
    """
    schema = "lang_pred string, score double, rejected boolean"

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    at = kept.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(sent.value)
        for batch in batches:
            found: list[tuple] = []
            for value in batch.column(at):
                t = value.as_py()
                if not compressors or not has_letter(t):
                    found.append((UNKNOWN, 0.0, True))
                    continue
                by = sorted((n, k) for k, n in enumerate(sizes(t, compressors)))
                gain = 1.0 if len(by) < 2 else (by[1][0] - by[0][0]) / by[1][0]
                found.append((sent.value.languages[by[0][1]], min(1.0, gain / (4 * margin)) if len(by) > 1 else 1.0, gain < margin))
            new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "rejected"])

    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    return source.mapInArrow(predict, _schema(source, schema))


def _schema(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents by a model of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
