"""Registered queries of the prose engine, and DuckDB SQL for those that RE2 can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.lists import LISTS
from prosemill.functions.patterns import keys_of
from prosemill.functions.readability import syllables_of_text, with_grade
from prosemill.operators import filters, project, score
from prosemill.operators.context import ABBREVIATIONS, GRADED, with_context
from prosemill.operators.detect import STRUCTURAL, detect
from prosemill.operators.narrative import QUESTIONS, asked, narrative
from prosemill.operators.rules import PACKS, Rule, selected
from prosemill.operators.storage import materialized, spread
from prosemill.plans import cases, fixtures, projects, trees
from prosemill.plans.fixtures import corpus, corpus_sql

COLUMNS = ["doc_id", "rule_id", "family", "severity", "offset", "length", "span", "message"]


def family_of(style: str) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in selected(style):
        out.setdefault(r.pack or r.family, []).append(r)
    return out


def simple(r: Rule) -> bool:
    """Whether RE2 says the same by ASCII words: no look-around but the phrase guards, no gate, no case or length that depends on Unicode."""
    body = r.pattern.replace("(?<![A-Za-z0-9_])", "").replace("(?![A-Za-z0-9_])", "")
    words = all(k[:1].isalnum() and k[-1:].isalnum() for k in r.mapping) if r.mapping else True
    return "(?<" not in body and "(?=" not in body and "(?!" not in body and "&&" not in body and not r.gate and not r.first and r.on == "masked" and words and r.warn_if is None and "{" not in r.message.replace("{to}", "") and "(?-i" not in body and "(?m" not in body and r.pattern.isascii() and not r.off_under


def simple_rules(style: str, group: str) -> list[Rule]:
    return [r for r in family_of(style).get(group, []) if simple(r) and r.id not in ("ableist-language", "interrogative-answer", "malformed-doi-isbn") and (not _listed(r) or all(k[:1].isalnum() and k[-1:].isalnum() for k in _listed(r)))]


def _listed(r: Rule) -> list[str]:
    return keys_of(r.id) if r.id in LISTS else []


def rule_sql(r: Rule) -> str:
    """Matches of a simple rule with byte offsets: parts between matches and the matches, summed up in order."""
    pattern = r.pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("(?diU)", "(?i)").replace("(?dU)", "").replace("(?diUm)", "(?im)").replace("(?dUm)", "(?m)")
    p = pattern.replace("'", "''")
    message = "'" + r.message.replace("'", "''") + "'"
    if r.mapping:
        table = "MAP {" + ", ".join("'{}': '{}'".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in r.mapping.items()) + "}"
        message = f"replace({message}, '{{to}}', {table}[lower(span)])"
    keep = "WHERE " + f"{table}[lower(span)] <> span" if r.mapping else ""
    return f"""SELECT doc_id, '{r.id}' AS rule_id, '{r.family}' AS family, '{r.severity}' AS severity, offset_ AS "offset", length_ AS length, left(trim(regexp_replace(span, '\\s+', ' ', 'g')), 80) AS span, {message} AS message FROM (
  SELECT doc_id, CAST(strlen(left(text, CAST(sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS BIGINT))) AS INTEGER) AS offset_, strlen(hit) AS length_, hit AS span FROM (
    SELECT doc_id, text, i, hits[i] AS hit, length(gaps[i]) AS gap FROM (
      SELECT doc_id, text, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM w) WHERE len(hits) > 0)
  )) {keep}"""


def _with_texts() -> str:
    # RE2's word characters are ASCII: other letters become an underscore, one for one.
    return f"WITH c AS ({corpus_sql()}), w AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\P{{L}}\\x00-\\x7F]', '_', 'g') AS t, text FROM c)"


def plain_sql(rules: list[Rule]) -> str:
    return _with_texts() + "\n" + "\nUNION ALL\n".join(map(rule_sql, rules))


def _plain(style: str, group: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = tuple(r.id for r in simple_rules(style, group))
        return detect(corpus(spark, sf_dir), style, only=ids).select(*COLUMNS)

    return run


#: Structural rules of the packs; the others belong to a family.
PACK_STRUCTURAL = {"microsoft": ("no-numeral-sentence-start", "microsoft-heading-acronyms", "microsoft-heading-colons"), "google": ("no-gerund-heading", "no-link-in-heading"), "plain": ("plain-long-sentence", "reading-grade")}


def _group(style: str, group: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = {r.id for r in family_of(style)[group]}
        if group in PACKS:
            return detect(corpus(spark, sf_dir), style, only=tuple(ids | set(PACK_STRUCTURAL.get(group, ())))).select(*COLUMNS)
        common = STRUCTURAL - {r for rs in PACK_STRUCTURAL.values() for r in rs}
        return detect(corpus(spark, sf_dir), style, only=tuple(ids | common)).where(F.col("family") == group).select(*COLUMNS)

    return run


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finding that each rule makes in the text written for it, and in its near miss, alone and in front of documents.

    Every document follows one of these texts, dealt by its id, whole and in a fence, which is no prose: so the finding must stay where it
    is, whatever the document holds. (doc_id, rule_id, style, kind, offset, length); ids below 0 are the texts alone.
    """
    made = F.broadcast(spark.createDataFrame(cases.texts(), "number long, style string, rule string, kind string, said string"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    behind = docs.withColumn("number", F.pmod("doc_id", F.lit(len(cases.texts())))).join(made, "number").where(~F.col("rule").isin(*cases.ALONE)).withColumn("text", F.concat("said", F.lit(f"\n\n{cases.FENCE} text\n"), "t", F.lit(f"\n{cases.FENCE}\n")))
    rows = materialized(spread(behind.select("doc_id", "style", "rule", "kind", "text").unionByName(made.select((-1 - F.col("number")).alias("doc_id"), "style", "rule", "kind", F.col("said").alias("text")))))
    found = []
    for style in PACKS:
        own = tuple(dict.fromkeys(rule for rule, s, _, _ in cases.CASES if s == style))
        found.append(detect(rows.where(F.col("style") == style).select("doc_id", "text"), style, only=own))
    first = reduce(DataFrame.unionByName, found).groupBy("doc_id", "rule_id").agg(F.min(F.struct("offset", "length")).alias("f"))
    out = rows.join(first.withColumnRenamed("rule_id", "rule"), ["doc_id", "rule"], "left")
    return out.select("doc_id", F.col("rule").alias("rule_id"), "style", "kind", "f.offset", "f.length")


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus(spark, sf_dir)
    return docs, materialized(detect(docs))


def slop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _findings(spark, sf_dir)
    return score.slop_score(docs, found).withColumns({"per1k": F.round("per1k", 6), "discount": F.round("discount", 6)})


def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.histogram(_findings(spark, sf_dir)[1])


def worst_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.worst(_findings(spark, sf_dir)[1])


def severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _findings(spark, sf_dir)
    return score.totals(found, docs)


def score_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands against labels: what the score says of documents of known quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return slop_scores(spark, sf_dir).join(labels, "doc_id").groupBy("band", "quality", "toxic").agg(F.count("*").alias("n"))


def _all_plain() -> list[Rule]:
    return [r for g in ("ai-slop", "clarity", "style", "inclusive", "microsoft") for r in simple_rules("microsoft", g)]


def _on_plain(report: Callable[[DataFrame, DataFrame, SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A report over the findings of those rules that SQL can say."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = corpus(spark, sf_dir)
        return report(docs, materialized(detect(docs, only=tuple({r.id for r in _all_plain()}))), spark, sf_dir)

    return run


def _plain_scores(docs: DataFrame, found: DataFrame, *_) -> DataFrame:
    return score.slop_score(docs, found).withColumns({"per1k": F.round("per1k", 6), "discount": F.round("discount", 6)})


ON_PLAIN = {
    "plain_slop_score": _on_plain(_plain_scores),
    "plain_rule_histogram": _on_plain(lambda docs, found, *_: score.histogram(found)),
    "plain_worst_docs_top15": _on_plain(lambda docs, found, *_: score.worst(found)),
    "plain_severity_totals": _on_plain(lambda docs, found, *_: score.totals(found, docs)),
    "plain_family_counts": _on_plain(lambda docs, found, *_: score.by_family(found)),
    "plain_capped": _on_plain(lambda docs, found, *_: score.capped(found, 3).select("doc_id", "rule_id", "offset", "nth", "suppressed")),
    "plain_located": _on_plain(lambda docs, found, *_: score.located(found, docs).select("doc_id", "rule_id", "offset", "line", "col")),
    "plain_score_by_label": _on_plain(lambda docs, found, spark, sf: _plain_scores(docs, found).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("band", "quality", "toxic").agg(F.count("*").alias("n"))),
}


def on_plain_sql() -> dict[str, str]:
    head = _with_texts() + ", found AS (" + "\nUNION ALL\n".join(map(rule_sql, _all_plain())) + ")"
    scored = head + r""", m AS (SELECT doc_id, sum(CASE severity WHEN 'error' THEN 3.0 WHEN 'warn' THEN 2.0 ELSE 1.0 END * CASE family WHEN 'ai-slop' THEN 1.0 WHEN 'inclusive' THEN 0.5 WHEN 'clarity' THEN 0.4 ELSE 0.3 END) AS mass, count(*) AS n FROM found GROUP BY doc_id),
s AS (SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*'))) AS words, len(regexp_extract_all(t, '\w+[''’](?:t|s|re|ve|ll|d|m)\b')) AS contractions,
  len(regexp_extract_all(t, '\b(?:I|I''m|I''ve|I''ll|I''d|[Ww]e|[Ww]e''re|[Ww]e''ve|[Ww]e''ll|[Ww]e''d|[Mm]y|[Oo]ur|[Mm]e|[Uu]s)\b')) AS first_person FROM w),
p AS (SELECT s.doc_id, words, contractions, first_person, coalesce(n, 0) AS finding_count, CAST(coalesce(mass, 0) AS DOUBLE) / words * 1000 AS per1k, least(15.0, CAST(contractions + first_person AS DOUBLE) / words * 1500) AS discount FROM s LEFT JOIN m ON m.doc_id = s.doc_id),
q AS (SELECT *, CAST(least(100, greatest(0, round(greatest(0.0, 100 * (1 - exp(-per1k / 35)) - discount)))) AS INTEGER) AS score FROM p),
b AS (SELECT *, CASE WHEN score <= 11 THEN 'clean' WHEN score <= 29 THEN 'light' WHEN score <= 59 THEN 'moderate' ELSE 'heavy' END AS band FROM q)"""
    return {
        "plain_slop_score": scored + " SELECT doc_id, score, band, words, finding_count, round(per1k, 6) AS per1k, contractions, first_person, round(discount, 6) AS discount FROM b",
        "plain_rule_histogram": head + " SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id",
        "plain_worst_docs_top15": head + " SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 15",
        "plain_severity_totals": head + " SELECT (SELECT count(*) FROM c) AS files, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warns, count(*) FILTER (severity = 'advisory') AS advisories FROM found",
        "plain_family_counts": head + " SELECT doc_id, family, count(*) AS n FROM found GROUP BY doc_id, family",
        "plain_capped": head + ' SELECT * FROM (SELECT doc_id, rule_id, "offset", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "offset", rule_id, length, message) AS INTEGER) AS nth, greatest(0, count(*) OVER (PARTITION BY doc_id) - 3) AS suppressed FROM found) WHERE nth <= 3',
        "plain_located": head + """, k AS (SELECT f.doc_id, rule_id, "offset", decode(encode(text)[:"offset"]) AS before FROM found f JOIN w ON w.doc_id = f.doc_id)
SELECT doc_id, rule_id, "offset", CAST(len(before) - len(replace(before, chr(10), '')) + 1 AS INTEGER) AS line, CAST(len(regexp_extract(before, '[^\n]*$')) + 1 AS INTEGER) AS col FROM k""",
        "plain_score_by_label": scored + " SELECT band, quality, toxic, count(*) AS n FROM b JOIN labels USING (doc_id) GROUP BY band, quality, toxic",
    }


def reading_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = with_context(corpus(spark, sf_dir), columns=GRADED)
    return with_grade(ctx).select("doc_id", "grade.words", "grade.sentences", "grade.syllables", "grade.letters", F.round("grade.grade", 6).alias("grade"))


def narrative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative(corpus(spark, sf_dir))


NARRATIVE_SQL = rf"""WITH c AS ({corpus_sql()}), t AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM c),
n AS (SELECT doc_id, low, len(regexp_extract_all(low, '\S+')) AS words, list_filter(list_transform(string_split_regex(low, '\n\s*\n'), lambda p: len(regexp_extract_all(p, '\S+'))), lambda k: k >= 20) AS lens,
  list_sum(list_transform(['the key takeaway', 'the takeaway', 'the lesson', 'ultimately', 'in conclusion', 'it is important to', 'remember that'], lambda p: len(regexp_extract_all(low, p)))) AS morals,
  list_sum(list_transform(['i''ve seen', 'i have seen', 'in my experience', 'as someone who', 'i know firsthand', 'we''ve all'], lambda p: len(regexp_extract_all(low, p)))) AS embodied,
  list_sum(list_transform(['various', 'a variety of', 'many ways', 'things', 'stuff', 'somewhere', 'someone', 'some people', 'certain'], lambda p: len(regexp_extract_all(low, p)))) AS vague,
  regexp_matches(low, '(?:^|[^a-z])(?:but|however|although|except|unless|tradeoff|limitation|risk|reader|user)(?:[^a-z]|$)') OR contains(low, 'trade-off') AS concedes,
  regexp_matches(low, '(?:^|[^a-z])(?:when|after|before|then|now|today|later|previously|next|first|finally)(?:[^a-z]|$)') AS timed FROM t),
l AS (SELECT doc_id, i, trim(ls[i]) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t)) WHERE trim(ls[i]) <> ''),
o AS (SELECT doc_id, i, translate(array_to_string(list_slice(list_filter(string_split_regex(regexp_replace(line, '^[-*0-9.) ]+', ''), '\s+'), lambda w: w <> ''), 1, 3), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS opening FROM l),
g AS (SELECT doc_id, least(5, coalesce(sum(CAST(strlen(opening) >= 10 AND opening = before AS INTEGER)), 0)) AS parallel FROM (SELECT doc_id, opening, lag(opening) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM o) GROUP BY doc_id),
d AS (SELECT n.doc_id, CAST(words AS INTEGER) AS words, CAST(least(5, morals) AS INTEGER) AS stated_morals, CASE WHEN len(lens) >= 4 AND list_max(lens) <= 2 * list_min(lens) THEN 3 ELSE 0 END AS tidy_structure, CAST(coalesce(parallel, 0) AS INTEGER) AS machine_parallelism,
  CAST(least(5, embodied) AS INTEGER) AS performed_embodiment, CAST(least(5, vague) AS INTEGER) AS vague_allusion, CASE WHEN words >= 250 AND NOT concedes THEN 5 ELSE 0 END AS no_concession_no_reader, CASE WHEN words >= 250 AND NOT timed THEN 5 ELSE 0 END AS flat_time FROM n LEFT JOIN g ON g.doc_id = n.doc_id),
s AS (SELECT *, stated_morals + tidy_structure + machine_parallelism + performed_embodiment + vague_allusion + no_concession_no_reader + flat_time AS total FROM d)
SELECT *, CASE WHEN total <= 6 THEN 'low' WHEN total <= 15 THEN 'medium' ELSE 'high' END AS band FROM s"""


def narrative_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents raise each question, and how strongly."""
    return asked(narrative_scores(spark, sf_dir)).groupBy("question", "label", "prompt").agg(F.count("*").alias("docs"), F.sum("score").alias("score"))


QUESTIONS_SQL = (
    f"WITH scores AS ({NARRATIVE_SQL}) SELECT question, label, prompt, count(*) AS docs, CAST(sum(score) AS BIGINT) AS score FROM ("
    + " UNION ALL ".join(f"SELECT '{i}' AS question, '{label}' AS label, '{prompt}' AS prompt, {i.replace('-', '_')} AS score FROM scores" for i, label, prompt, _ in QUESTIONS)
    + ") WHERE score > 0 GROUP BY question, label, prompt"
)


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between white space, their letters and syllables, of all texts as they are."""
    text = F.coalesce("text", F.lit(""))
    return corpus(spark, sf_dir).select("doc_id", F.regexp_count(text, F.lit(r"(?U)\S+")).alias("words"), F.regexp_count(text, F.lit("[A-Za-z0-9]")).alias("letters"), syllables_of_text(text).alias("syllables"))


# Word by word: endings first, then groups of vowels, and the words that the rules get wrong.
SYLLABLES_SQL = rf"""WITH c AS ({corpus_sql()}), w AS (SELECT doc_id, regexp_replace(lower(unnest(regexp_extract_all(coalesce(text, ''), '\S+'))), '[^a-z]', '', 'g') AS w FROM c),
e AS (SELECT doc_id, w, CASE WHEN w LIKE '%es' AND length(w) > 3 THEN regexp_replace(w, '([aeiouy])([^aeiouyl])es$', '\1\2') WHEN w LIKE '%ed' AND length(w) > 3 THEN w[:-3] WHEN w LIKE '%e' AND w NOT LIKE '%le' AND length(w) > 2 THEN w[:-2] ELSE w END AS stem FROM w),
k AS (SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE coalesce(MAP {{'every': 2, 'business': 2, 'different': 3, 'comfortable': 3, 'vegetable': 3, 'february': 4, 'area': 3, 'idea': 3, 'science': 2, 'being': 2, 'create': 2, 'people': 2, 'simile': 3, 'queue': 1, 'the': 1, 'average': 3, 'naive': 2, 'real': 1, 'cereal': 3}}[w],
  greatest(1, len(regexp_extract_all(regexp_replace(stem, '^y', ''), '[aeiouy]{{1,2}}')) + CAST(regexp_matches(w, '[^aeiouy]le$') AS INTEGER) + CAST(regexp_matches(w, 'ia|io|ua|eo') AS INTEGER))) END AS n FROM e)
SELECT c.doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]')) AS INTEGER) AS letters, CAST(coalesce((SELECT sum(n) FROM k WHERE k.doc_id = c.doc_id), 0) AS INTEGER) AS syllables FROM c"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(corpus(spark, sf_dir), columns=("sentences",)).select("doc_id", F.posexplode("sentences").alias("i", "s")).select("doc_id", "i", "s.start", "s.length", "s.words")


# Blocks are items, and paragraphs of other lines between blank lines, headings and items. A block is cut behind marks that end a sentence: what
# stands between them are rows, and rows whose mark ends none go with the next. Texts hold nothing that is masked.
SENTENCES_SQL = rf"""WITH c AS ({corpus_sql()}), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM c)),
k AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
  CASE WHEN NOT regexp_matches(line, '[^\s\pZ]') OR regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \t]') THEN 'none' WHEN regexp_matches(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]') THEN 'item' ELSE 'text' END AS kind FROM l),
g AS (SELECT *, sum(CAST(kind <> 'text' OR before IS DISTINCT FROM 'text' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)),
b AS (SELECT doc_id, block, min(place) AS place, string_agg(line, chr(10) ORDER BY i) || CASE WHEN kind = 'text' AND max(i) < max(n) THEN chr(10) ELSE '' END AS t FROM g WHERE kind <> 'none' GROUP BY doc_id, block, kind),
p AS (SELECT doc_id, block, place, unnest(gaps) AS gap, unnest(hits) AS hit, generate_subscripts(gaps, 1) AS i FROM (SELECT *, string_split_regex(t, '[.!?]+["'')\]”’]?(?:[\s\pZ]+|$)') AS gaps, regexp_extract_all(t, '[.!?]+["'')\]”’]?(?:[\s\pZ]+|$)') AS hits FROM b)),
e AS (SELECT *, hit IS NOT NULL AND NOT (hit[1] = '.' AND ((regexp_matches(gap, '[0-9]$') AND regexp_matches(coalesce(lead(gap) OVER (PARTITION BY doc_id, block ORDER BY i), ''), '^[0-9]'))
  OR rtrim(lower(regexp_extract(gap, '[^\s\pZ(]*$')), '.') IN ({", ".join(f"'{a}'" for a in sorted(ABBREVIATIONS))}))) AS ends FROM p),
q AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM e),
r AS (SELECT doc_id, block, place, nth, string_agg(gap || coalesce(hit, ''), '' ORDER BY i) AS s FROM q GROUP BY doc_id, block, place, nth),
w AS (SELECT doc_id, place + coalesce(sum(strlen(s)) OVER (PARTITION BY doc_id, block ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, strlen(s) AS length, len(regexp_extract_all(s, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*')) AS words FROM r)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS i, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, CAST(words AS INTEGER) AS words FROM w WHERE words > 0"""

GRADE_SQL = f"""WITH n AS (SELECT doc_id, count(*) AS n FROM ({SENTENCES_SQL}) GROUP BY doc_id),
x AS (SELECT y.doc_id, words, CAST(coalesce(n, 0) AS INTEGER) AS sentences, syllables, letters, CAST(greatest(words, 1) AS DOUBLE) AS w, CAST(greatest(coalesce(n, 0), 1) AS DOUBLE) AS s FROM ({SYLLABLES_SQL}) y LEFT JOIN n ON n.doc_id = y.doc_id)
SELECT doc_id, words, sentences, syllables, letters, round((0.39 * (w / s) + 11.8 * (syllables / w) - 15.59 + 0.0588 * (letters / w * 100.0) - 0.296 * (s / w * 100.0) - 15.8) / 2, 6) AS grade FROM x"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(corpus(spark, sf_dir), columns=("lines",)).select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.line", "l.start", "l.blank", "l.table")


LINES_SQL = f"""WITH c AS ({corpus_sql()}), s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM c), u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, CAST(coalesce(sum(strlen(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, trim(l[i]) = '' AS blank FROM u"""


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line", "start", "blank")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(corpus(spark, sf_dir), columns=("words", "raw_words")).select("doc_id", "words", "raw_words")


TOKENS_SQL = f"WITH c AS ({corpus_sql()}) SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*')) AS INTEGER) AS words, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*')) AS INTEGER) AS raw_words FROM c"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masking leaves: of texts with marks of every kind, and of all documents without a mark."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~F.col("text").rlike(r"[`<]|\A~~~|\n ?~~~|\{\{|\A---|\A\+\+\+"))
    rows = with_context(spread(plain.unionByName(fixtures.masked_texts(spark))), columns=("masked",))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.md5(F.col("masked").cast("binary")).alias("masked_md5"))


def text_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", filters.is_non_latin(F.col("text")).alias("non_latin"), filters.is_data_like(F.col("text")).alias("data_like"))


FILTERS_SQL = f"""WITH c AS ({corpus_sql()}), n AS (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]')) AS latin,
  len(regexp_extract_all(text, '[\\x{{0400}}-\\x{{04FF}}\\x{{0600}}-\\x{{06FF}}\\x{{0E00}}-\\x{{0E7F}}\\x{{3040}}-\\x{{30FF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]')) AS other, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*')) AS words FROM c)
SELECT doc_id, other > 80 AND other * 3 > latin AS non_latin, len(list_filter(string_split(text, chr(10)), lambda x: strlen(x) >= 2000)) > 0 OR (words >= 200 AND len(regexp_extract_all(text, '[.!?]')) * 100 < words) AS data_like FROM n"""

def _project(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(projects.files(spark, sf_dir))


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page/"), "page_id").alias("path"), F.col("html").alias("text"))
    fixed = spark.createDataFrame(projects.FIXED, "path string, text string")
    return project.check_anchors(pages.unionByName(fixed.where("path = 'page.html'"))).select("path", "target", "line", "rule_id", "severity")


ANCHORS_SQL = r"""WITH f AS (SELECT concat('page/', page_id) AS path, html AS text FROM pages UNION ALL SELECT 'page.html', '<a href="#top">x</a>' || chr(10) || '<p id="top">' || chr(10) || '<a href="#none">y</a>'),
d AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '\bid\s*=\s*\{?["'']([^"'']+)["'']', 1)) AS target FROM f),
l AS (SELECT path, i, ls[i] AS line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split_regex(text, '\r?\n') AS ls FROM f))),
h AS (SELECT path, i, unnest(regexp_extract_all(line, '\bhref\s*=\s*\{?["'']#([^"'']+)["'']', 1)) AS target FROM l)
SELECT path, target, CAST(i AS INTEGER) AS line, 'anchor-broken' AS rule_id, 'error' AS severity FROM h WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = h.path AND d.target = h.target)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"slop_score": slop_scores}
ORACLES: dict[str, str] = {}
for _style, _groups in {"microsoft": ("ai-slop", "clarity", "style", "inclusive", "microsoft"), "google": ("google",), "ap": ("ap",), "chicago": ("chicago",), "plain": ("plain",)}.items():
    for _g in _groups:
        QUERIES[f"rules_{_g.replace('-', '_')}"] = _group(_style, _g)
        if _rules := simple_rules(_style, _g):
            QUERIES[f"plain_rules_{_g.replace('-', '_')}"] = _plain(_style, _g)
            ORACLES[f"plain_rules_{_g.replace('-', '_')}"] = plain_sql(_rules)
QUERIES |= {
    "rule_cases": rule_cases, **ON_PLAIN,
    "rule_histogram": rule_histogram, "worst_docs_top15": worst_docs, "severity_totals": severity_totals, "score_by_label": score_by_label, "reading_grade": reading_grades, "narrative_score": narrative_scores, "narrative_questions": narrative_questions,
    "op_mask": masks, "op_syllables": syllables, "op_sentences": sentences, "op_lines": plain_lines, "op_tokens": tokens, "text_filters": text_filters, "check_links": _project(project.check_links), "check_anchors": page_anchors, "check_nav": _project(project.check_navigation),
    "check_community": _project(project.check_community), "check_sections": _project(project.check_sections), "postmortem_blame": _project(project.postmortem_blame), "asset_detect": _project(project.asset_types),
    "platform_detect": _project(project.platforms), "i18n_siblings": _project(project.translations), "i18n_structure": _project(project.check_translations), "surface_symbols": _project(project.surface), "glossary": _project(project.glossary),
}
ORACLES |= {"narrative_score": NARRATIVE_SQL, "narrative_questions": QUESTIONS_SQL, "op_syllables": SYLLABLES_SQL, "op_sentences": SENTENCES_SQL, "reading_grade": GRADE_SQL, "rule_cases": cases.cases_sql(), "op_mask": fixtures.masked_sql(), "op_lines": LINES_SQL, "op_tokens": TOKENS_SQL, "text_filters": FILTERS_SQL}
ORACLES |= {**on_plain_sql(), **projects.SQL, "check_anchors": ANCHORS_SQL}
QUERIES |= trees.QUERIES
ORACLES |= trees.ORACLES
