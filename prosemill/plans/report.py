"""One call from files and a configuration to findings with places, scores, and the printed and JSON reports."""

from __future__ import annotations

from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.operators import project as P
from prosemill.operators import score
from prosemill.operators.detect import detect
from prosemill.operators.filters import basename, is_markdown
from prosemill.operators.order import numbered
from prosemill.operators.project import glob_regex
from prosemill.plans import config as C


class Report(NamedTuple):
    """docs: (doc_id, path, text); findings: those of ``detect`` with path, line and col, waived ones left out."""

    docs: DataFrame
    findings: DataFrame


def ignored(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a glob names the path or its base name."""
    out = F.lit(False)
    for g in globs:
        out = out | F.regexp_like(path, glob_regex(F.lit(g))) | F.regexp_like(basename(path), glob_regex(F.lit(g)))
    return out


def waivers(config: dict[str, Any], spark) -> tuple[DataFrame | None, DataFrame | None]:
    """The configuration's waivers as rows: values (rule_id, span) and spans (doc_id, lo, hi), doc_id being the path."""
    d = config["detector"]
    values = [(rule, v) for rule, vs in d["ignoreValues"].items() for v in vs]
    spans = [(path, int(r[0]), int(r[-1])) for path, rs in d["ignoreSpans"].items() for r in rs if r]
    return (spark.createDataFrame(values, "rule_id string, span string") if values else None, spark.createDataFrame(spans, "doc_id string, lo int, hi int") if spans else None)


def check(files: DataFrame, *overlays: dict, glossary: tuple = (), only: tuple[str, ...] | None = None) -> Report:
    """Findings of files (path, text) under the configuration's layers: ignored files, rules, values and spans are left out.

    Paths name documents and are to be unique. A null text has no findings; an empty table gives an empty report.
    """
    config = C.layers(*overlays)
    docs = files.where(~ignored(F.col("path"), tuple(config["detector"]["ignoreFiles"]))).select(F.col("path").alias("doc_id"), "path", "text")
    found = score.located(detect(docs, **C.settings(config), glossary=glossary, only=only), docs)
    found = score.waive(found, *waivers(config, files.sparkSession))
    return Report(docs, found.withColumn("path", F.col("doc_id")))


def units(lines: DataFrame, **settings) -> DataFrame:
    """Findings of units (path, line, text), each a document of its own, at the lines of their file: (path, line, col, ...)."""
    keyed = lines.select(F.struct("path", F.col("line").alias("first")).alias("doc_id"), "text")
    placed = score.located(detect(keyed, **settings), keyed)
    rows = placed.withColumns({"path": F.col("doc_id.path"), "line": F.col("doc_id.first") + F.col("line") - 1})
    return rows.select("path", "line", "col", *[c for c in placed.columns if c not in ("doc_id", "line", "col")])


def text_lines(report: Report) -> DataFrame:
    """(path, n, text) of the printed report: the path, a line a finding, a blank line; n orders a path's lines from 0.

    The last row, under a null path, counts findings and files.
    """
    f = report.findings
    said = F.format_string("  %d:%d %s %s — %s  [%s]", "line", "col", "severity", "rule_id", "message", "span")
    nth = F.row_number().over(W.partitionBy("path").orderBy("offset", "rule_id", "length", "message"))
    rows = f.select("path", nth.alias("n"), said.alias("text"))
    ends = f.groupBy("path").agg((F.count("*") + 1).cast("int").alias("last"))
    frame = ends.select("path", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("path").alias("text")), F.struct(F.col("last").alias("n"), F.lit("").alias("text")))).alias("x")).select("path", "x.*")
    total = f.agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))
    trailer = total.select(F.lit(None).cast("string").alias("path"), F.lit(0).alias("n"), F.when(F.col("n") == 0, "✓ clean — no findings").otherwise(F.format_string("%d finding(s) in %d file(s)", "n", "files")).alias("text"))
    return rows.unionByName(frame).unionByName(trailer)


def json_lines(report: Report) -> DataFrame:
    """(path, json): a file's words, score and findings in order; a file's findings meet in one row. Files without findings have an empty list."""
    one = F.struct("offset", F.col("rule_id").alias("ruleId"), "family", "severity", "length", "span", "message", "line", "col")
    lists = report.findings.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("findings"))
    scores = score.slop_score(report.docs, report.findings)
    scores = scores.select(F.col("doc_id").alias("path"), "words", F.struct("score", "band", F.col("finding_count").alias("findingCount"), "per1k", "contractions", F.col("first_person").alias("firstPerson"), "discount").alias("score"))
    none = F.from_json(F.lit("[]"), lists.schema["findings"].dataType)
    rows = scores.join(lists, "path", "left").withColumn("findings", F.coalesce("findings", none))
    return rows.select("path", F.to_json(F.struct("path", "words", "score", "findings")).alias("json"))


def summary_json(report: Report) -> DataFrame:
    """One row: files, findings and their severities."""
    t = score.totals(report.findings, report.docs)
    return t.select(F.to_json(F.struct(*t.columns)).alias("json"))


def score_lines(report: Report) -> DataFrame:
    """(path, text): a line a file with its score, band, findings, density and discount."""
    said = F.format_string("%s: slop score %d (%s) — %d findings / %d words, density %.1f/1k, discount %.1f", "doc_id", "score", "band", "finding_count", "words", "per1k", "discount")
    return score.slop_score(report.docs, report.findings).select(F.col("doc_id").alias("path"), said.alias("text"))


def project(files: DataFrame, *overlays: dict, limit: int | None = None, anchors: bool = False, prose: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """(severity, rule_id, path, target, line, col, message): all checks of a project in one table, under the configuration's layers.

    Community files, links, navigation, sections and blame; with ``anchors`` those of markup, with ``prose`` the findings of its Markdown too. A
    ``limit`` has links looked for in the first so many documents in order of path. Rules that the configuration ignores aren't planned.
    """
    off = set(C.layers(*overlays)["detector"]["ignoreRules"])
    out = []

    def add(rule: str | tuple[str, ...], rows: DataFrame, target: str | None = "target", message: Column | None = None, line: bool = False) -> None:
        names = [r for r in ((rule,) if isinstance(rule, str) else rule) if r not in off]
        if names:
            said = message if message is not None else F.col("message")
            where = [F.col(c).cast("int").alias(c) if line and c in rows.columns else F.lit(None).cast("int").alias(c) for c in ("line", "col")]
            out.append(rows.where(F.col("rule_id").isin(*names)).select("severity", "rule_id", "path", (F.col(target) if target else F.lit(None).cast("string")).alias("target"), *where, said.alias("message")))

    docs = files.where(is_markdown(F.col("path")))
    kind = F.when(F.col("severity") == "error", "required").otherwise("recommended")
    lost = F.concat(kind, F.lit(" community-health file is missing: "), "path")
    add(("community-missing-file", "community-invalid-file"), P.check_community(files), None, F.when(F.col("rule_id") == "community-missing-file", lost).otherwise(F.concat(F.lit("community-health file has no content of its own: "), "path")))
    if limit is None:
        add("link-broken", P.check_links(files))
    else:
        first = docs.select("path").orderBy("path").limit(max(0, limit))
        add("link-broken", P.check_links(files).join(F.broadcast(first), "path", "left_semi"))
    add(("nav-missing-target", "nav-orphan-page"), P.check_navigation(files), message=F.when(F.col("rule_id") == "nav-missing-target", "navigation names a file that isn't there").otherwise("page isn't in the navigation"))
    add("asset-missing-section", P.check_sections(files), message=F.concat(F.lit("section is missing: "), "target"))
    add("postmortem-blame", P.postmortem_blame(files), message=F.lit("blaming language in a postmortem"))
    if anchors:
        add("anchor-broken", P.check_anchors(files.where(F.col("path").rlike(r"(?i)\.(?:html?|jsx|tsx)$"))), message=F.lit("anchor has no element with its id"), line=True)
    if prose:
        found = check(docs.select("path", "text"), *overlays, only=only).findings
        out.append(found.select("severity", "rule_id", "path", F.col("span").alias("target"), "line", "col", "message"))
    empty = files.sparkSession.createDataFrame([], "severity string, rule_id string, path string, target string, line int, col int, message string")
    return reduce(DataFrame.unionByName, out, empty)


def project_lines(findings: DataFrame) -> DataFrame:
    """(n, text): the printed check in order of path, two lines a finding; without findings one line that says so."""
    said = F.concat_ws(" ", "severity", "rule_id", F.concat("path", F.coalesce(F.concat(F.lit(" -> "), "target"), F.lit(""))))
    placed = numbered(findings, "path", "rule_id", "target", "line", "col", "message")
    rows = placed.select(F.explode(F.array(F.struct((F.col("n") * 2).alias("n"), said.alias("text")), F.struct((F.col("n") * 2 + 1).alias("n"), F.concat(F.lit("  "), "message").alias("text")))).alias("x")).select("x.*")
    none = findings.agg(F.count("*").alias("c")).where("c = 0").select(F.lit(0).cast("long").alias("n"), F.lit("check: ok").alias("text"))
    return rows.unionByName(none)


def project_exit(findings: DataFrame, strict: bool = False) -> int:
    """1 where an error was found, or anything at all under ``strict``."""
    row = findings.agg(F.count("*").alias("all"), F.count_if(F.col("severity") == "error").alias("errors")).first()
    return int(row["errors"] > 0 or (strict and row["all"] > 0))
