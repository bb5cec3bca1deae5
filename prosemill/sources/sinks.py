"""Sinks: findings as text lines, as JSON documents, as summaries and audits, and the exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.operators.score import capped, histogram, worst


def human_lines(findings: DataFrame) -> DataFrame:
    """(doc_id, offset, text): one printable line a finding, to be ordered by its reader; needs line and col."""
    text = F.format_string("%d:%d %s %s — %s  [%s]", "line", "col", "severity", "rule_id", "message", "span")
    return findings.select("doc_id", "offset", text.alias("text"))


def json_documents(findings: DataFrame) -> DataFrame:
    """(doc_id, json): the findings of a document as one JSON object; a document's findings meet in one row."""
    one = F.struct("offset", F.col("rule_id").alias("ruleId"), "family", "severity", "length", "span", "message")
    return findings.groupBy("doc_id").agg(F.to_json(F.struct(F.count("*").alias("count"), F.array_sort(F.collect_list(one)).alias("findings"))).alias("json"))


def summary(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return worst(findings), histogram(findings)


#: What a message quotes at its end.
_QUOTED = r"""[\x{2018}\x{2019}'\x{201C}\x{201D}"]([^'\x{2018}\x{2019}\x{201C}\x{201D}"]{1,60})['\x{2018}\x{2019}\x{201C}\x{201D}"]\s*$"""


def audit(findings: DataFrame) -> DataFrame:
    """Findings by document and family, each with what is bad and the fix that its message quotes at the end, if it does."""
    fix = F.regexp_extract(F.regexp_replace("message", r"\.+$", ""), _QUOTED, 1)
    kept = [c for c in ("path", "line", "col") if c in findings.columns]
    return findings.select("doc_id", *kept, "family", "offset", "rule_id", "severity", "message", F.col("span").alias("bad"), F.nullif(fix, F.lit("")).alias("good"))


def audit_lines(findings: DataFrame) -> DataFrame:
    """(path, n, text) of the printed audit: a path's findings below its name, by family; n orders a path's lines from 0. Needs path, line and col.

    The last row, under a null path, says so where nothing was found.
    """
    rows = audit(findings)
    lines = F.array_compact(F.array(F.when(F.col("first"), ""), F.when(F.col("first"), F.concat(F.lit("  ["), "family", F.lit("]"))), F.format_string("  %d:%d %s %s — %s", "line", "col", "severity", "rule_id", "message"), F.concat(F.lit("      bad:  "), "bad"), F.concat(F.lit("      good: "), "good")))
    in_family = W.partitionBy("path", "family").orderBy("offset", "rule_id", "message")
    said = rows.withColumn("first", F.row_number().over(in_family) == 1).select("path", "family", "offset", "rule_id", "message", F.posexplode(lines).alias("k", "text"))
    numbered = said.select("path", F.row_number().over(W.partitionBy("path").orderBy("family", "offset", "rule_id", "message", "k")).alias("n"), "text")
    ends = numbered.groupBy("path").agg((F.max("n") + 1).alias("last"))
    frame = ends.select("path", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat(F.lit("== "), "path", F.lit(" ==")).alias("text")), F.struct(F.col("last").alias("n"), F.lit("").alias("text")))).alias("x")).select("path", "x.*")
    none = findings.agg(F.count("*").alias("c")).where("c = 0").select(F.lit(None).cast("string").alias("path"), F.lit(0).alias("n"), F.lit("✓ clean — no findings").alias("text"))
    return numbered.unionByName(frame).unionByName(none)


def hook_lines(findings: DataFrame, k: int = 20) -> DataFrame:
    """At most k lines a document, with how many more there are."""
    return capped(findings, k).select("doc_id", "nth", "suppressed", F.concat_ws(" ", "severity", F.concat("rule_id", F.lit(":")), "message").alias("text"))


def exit_code(findings: DataFrame, strict: bool = False) -> int:
    row = findings.agg(F.max((F.col("severity") == "error").cast("int")).alias("e"), F.max((F.col("severity") == "warn").cast("int")).alias("w")).first()
    return int(bool(row["e"]) or strict and bool(row["w"]))


def write(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Findings as Parquet, partitioned by rule family, so that readers of one family read its files alone."""
    findings.write.mode(mode).partitionBy("family").parquet(path)
