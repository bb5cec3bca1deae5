"""Waivers, histograms and scores over findings, and the narrative score of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.functions.patterns import NOCASE

SEVERITY = {"error": 3.0, "warn": 2.0, "advisory": 1.0}
FAMILY = {"ai-slop": 1.0, "inclusive": 0.5, "clarity": 0.4, "style": 0.3, "grammar": 0.3}
CONTRACTION = r"(?U)\w+['’](?:t|s|re|ve|ll|d|m)\b"
FIRST_PERSON = r"(?U)\b(?:I|I'm|I've|I'll|I'd|[Ww]e|[Ww]e're|[Ww]e've|[Ww]e'll|[Ww]e'd|[Mm]y|[Oo]ur|[Mm]e|[Uu]s)\b"
WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"


def located(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings with line and col, from 1; col counts characters.

    As of each finding's offset, the last line that began: lines and findings of a document meet in one ordered window, so a text
    is moved once, by lines, however many findings it has. Ids name documents here.
    """
    by = W.partitionBy("doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "said")).withColumn("start", F.coalesce(F.sum(F.octet_length("said") + 1).over(by.orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    lines = lines.select("doc_id", F.col("start").alias("offset"), F.struct("i", "said", "start").alias("at"))
    both = lines.unionByName(findings, allowMissingColumns=True)
    held = F.last("at", ignorenulls=True).over(by.orderBy("offset", F.col("at").isNull()).rowsBetween(W.unboundedPreceding, 0))
    rows = both.withColumn("held", held).where("at is null")
    head = F.expr("decode(substring(encode(held.said, 'UTF-8'), 1, offset - held.start), 'UTF-8')")
    return rows.select(*findings.columns, (F.col("held.i") + 1).alias("line"), (F.length(head) + 1).alias("col"))


def waive(findings: DataFrame, values: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Findings that no waiver covers: values (rule_id, span) are equal ones, spans (doc_id, lo, hi) cover lines (hi null: one line, reversed pairs turned)."""
    out = findings
    if values is not None:
        out = out.join(values.select("rule_id", "span").distinct(), ["rule_id", "span"], "left_anti")
    if spans is not None:
        s = spans.select(F.col("doc_id").alias("_doc"), F.least("lo", F.coalesce("hi", "lo")).alias("_lo"), F.greatest("lo", F.coalesce("hi", "lo")).alias("_hi"))
        out = out.join(s, (out.doc_id == s._doc) & out.line.between(s._lo, s._hi), "left_anti")
    return out


def histogram(findings: DataFrame) -> DataFrame:
    """(rule_id, n): a row a rule, in no order; who prints it sorts these few rows."""
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"))


def worst(findings: DataFrame, k: int = 15) -> DataFrame:
    """The k documents with the most findings: a report, cut by a top-k that keeps k rows a task."""
    return findings.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(k)


def totals(findings: DataFrame, docs: DataFrame) -> DataFrame:
    found = findings.agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warn", "warns"), ("advisory", "advisories"))])
    return docs.agg(F.count("*").alias("files")).crossJoin(found)  # one row by one row


def by_family(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "family").agg(F.count("*").alias("n"))


def capped(findings: DataFrame, k: int = 20) -> DataFrame:
    """The first k findings of each document, with how many more there are."""
    doc = W.partitionBy("doc_id")
    rows = findings.withColumns({"nth": F.row_number().over(doc.orderBy("offset", "rule_id", "length", "message")), "suppressed": F.greatest(F.lit(0), F.count("*").over(doc) - k)})
    return rows.where(F.col("nth") <= k)


def slop_score(docs: DataFrame, findings: DataFrame, machine: Column | None = None) -> DataFrame:
    """(doc_id, score, band, words, finding_count, per1k, contractions, first_person, discount) of every document; words are those of the raw text."""
    weight = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")] * F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[F.col("family")]
    mass = findings.groupBy("doc_id").agg(F.sum(weight).alias("mass"), F.count("*").alias("finding_count"))
    text = F.coalesce("text", F.lit(""))
    stats = docs.select("doc_id", F.greatest(F.lit(1), F.regexp_count(text, F.lit(WORD))).alias("words"), F.regexp_count(text, F.lit(CONTRACTION)).alias("contractions"), F.regexp_count(text, F.lit(FIRST_PERSON)).alias("first_person"))
    rows = stats.join(mass, "doc_id", "left").fillna({"mass": 0.0, "finding_count": 0})
    per1k = F.col("mass") / F.col("words") * 1000
    discount = F.least(F.lit(15.0), (F.col("contractions") + F.col("first_person")) / F.col("words") * 1500)
    plain = F.greatest(F.lit(0.0), 100 * (1 - F.exp(-per1k / 35)) - discount)
    score = F.round(plain if machine is None else F.coalesce(0.8 * plain + 20 * machine, plain)).cast("int")
    score = F.least(F.lit(100), F.greatest(F.lit(0), score))
    band = F.when(score <= 11, "clean").when(score <= 29, "light").when(score <= 59, "moderate").otherwise("heavy")
    return rows.select("doc_id", score.alias("score"), band.alias("band"), "words", F.col("finding_count").cast("long").alias("finding_count"), per1k.alias("per1k"), "contractions", "first_person", discount.alias("discount"))


def counts_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.regexp_count(text, F.lit(f"{NOCASE}(?:{'|'.join(p.replace('.', chr(92) + '.') for p in phrases)})"))
