"""A corpus pipeline of five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read again as
the next one's ``docs``. All but the last return the columns of ``docs`` unchanged in number, order and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, table
from prosemill.llm.op3_decontam import decontaminated
from prosemill.llm.op4_pii import key_of, pseudonymize
from prosemill.llm.op5_packing import digests, pack
from prosemill.llm.op7_minhash import near_duplicates
from prosemill.llm.op9_language import classify, held_out, train


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; a null text, one without a letter and one with a narrow margin go. Rows that repeat are judged
    alike, whatever their id; an empty table, or one without a labelled language, keeps none."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return classify(docs, model).where("not rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates: five-word shingles, Jaccard 0.8. Rows that repeat an id stay or go together, and so do
    those without one. Null and empty texts are no duplicates of anything and stay; an empty table stays empty."""
    kept = near_duplicates(docs, n=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs.doc_id.eqNullSafe(kept._kept), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. Null and empty texts hold none; rows that repeat an id are judged by their own text.
    An empty table stays empty, and without test items all stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values; n_chars follows a text that was changed. Null and empty texts and repeated rows stay as they are."""
    done = pseudonymize(docs, key_of(spark))
    return done.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences, with the columns of op5. A null or empty text is one end id; repeated rows are packed each."""
    return digests(pack(docs))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Compression, min-max signatures and tokens can't be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
