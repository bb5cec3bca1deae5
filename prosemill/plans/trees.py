"""Registered queries over trees, edits and streams that Spark derives from the given tables, each beside SQL that says the result from how they are made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators import commonmark, declarations, ignores, order, project
from prosemill.operators.detect import detect
from prosemill.operators.storage import landed, materialized
from prosemill.sources import code_strings, edited_paths, line_units
from prosemill.streaming import edited_once, fallen_behind

# --- Markdown by blocks ---------------------------------------------------------------------------------------------------------------
# A page of each document (d: id, s: source, t: whole text, which stands in a fence), and translations of some: expressions that both engines read.

_PAGE = """concat('Page ', d, '\\n====\\n\\nIntro [one](a', d, '.md) and ![no](pic.png), `[no](code.md)` and \\\\[no](x.md)\\n\\n> Quoted\\n> ---\\n> - # Item ', d, '\\n>   [two][Ref]\\n\\n',
 case when d % 2 = 0 then '- point\\n\\n  ## In list\\n\\n      indented in item\\n\\n' else '' end, case when d % 3 = 0 then '| a | b |\\n|---|---|\\n| [three](c.md) | x |\\n\\n' else '' end,
 'Note[^n] and <https://e.org/', d, '>\\n\\n[^n]: about\\n    ### Deep\\n\\n', case when d % 5 = 0 then 'Then\\n\\n    code # no\\n\\n' else '' end, case when d % 7 = 0 then '<div>\\n# no\\n</div>\\n\\n***\\n\\n' else '' end,
 '~~~~~~~~ text\\n', t, '\\n~~~~~~~~\\n\\n[ref]: <two.md> "Two"\\n')"""
_TRANSLATED = """concat('Page ', d, '\\n', case when d % 4 = 2 then '----' else '====' end, '\\n\\n[un](a', d, '.md) <https://e.org/', d, '>\\n\\n> Cité\\n> ---\\n> - # Point\\n\\n', case when d % 2 = 0 then '## Liste\\n\\n' else '' end,
 case when d % 3 = 0 then '[trois](c.md)\\n\\n' else '' end, case when d % 4 = 1 then '' else '### Fin\\n\\n' end, case when d % 6 <> 0 then '[deux](two.md)\\n\\n' else '' end, '````\\n', t, '\\n````\\n')"""
_COLUMNS = ["coalesce(doc_id, -1) AS d", "coalesce(source, 'none') AS s", "coalesce(text, '') AS t"]
_DOCS = f"(SELECT {', '.join(_COLUMNS)} FROM documents)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*_COLUMNS)


def _plain(expression: str) -> str:
    """An expression of Spark's as DuckDB reads it, whose texts have no escapes."""
    return expression.replace("\\\\", "\0").replace("\\n", "\n").replace("\\t", "\t").replace("\0", "\\")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a page of every document and its French translation where there is one."""
    docs = _documents(spark, sf_dir)
    return docs.selectExpr("concat('site/', d % 50, '/', d, '.md') AS path", f"{_PAGE} AS text").unionByName(docs.where("d % 4 < 3").selectExpr("concat('site/', d % 50, '/', d, '.fr.md') AS path", f"{_TRANSLATED} AS text"))


def markdown_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, number of code blocks and links of every page; the lists are joined so that engines compare them as text."""
    made = commonmark.outlines(pages(spark, sf_dir).where("not endswith(path, '.fr.md')"))
    return made.select("path", F.array_join("levels", ",").alias("levels"), F.size("headings").alias("headings"), "code_blocks", F.array_join("links", " ").alias("links"))


OUTLINE_SQL = f"""SELECT concat('site/', d % 50, '/', d, '.md') AS path, concat('1,2,1', CASE WHEN d % 2 = 0 THEN ',2' ELSE '' END, ',3') AS levels, CAST(CASE WHEN d % 2 = 0 THEN 5 ELSE 4 END AS INTEGER) AS headings,
CAST(1 + (CASE WHEN d % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN d % 5 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS code_blocks, concat('a', d, '.md', CASE WHEN d % 3 = 0 THEN ' c.md' ELSE '' END, ' https://e.org/', d, ' two.md') AS links FROM {_DOCS}"""


def i18n_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each translation lacks against its page, and how many of each issue."""
    return project.conformed(materialized(pages(spark, sf_dir))).select("source", "path", "lang", F.array_join("issues", "; ").alias("issues"), (F.size("issues") == 0).alias("ok"))


CONFORM_SQL = f"""WITH x AS {_DOCS}, y AS (SELECT d, list_filter([
  CASE WHEN d % 4 = 1 THEN 'heading count differs: source=4 translation=3' WHEN d % 4 = 2 THEN 'heading level sequence differs: source=h1 > h2 > h1 > h2 > h3 translation=h2 > h2 > h1 > h2 > h3' END,
  CASE WHEN d % 2 = 0 OR d % 5 = 0 THEN concat('code block count differs: source=', 1 + (CASE WHEN d % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN d % 5 = 0 THEN 1 ELSE 0 END), ' translation=1') END,
  CASE WHEN d % 6 = 0 THEN 'missing link target(s): two.md' END], lambda i: i IS NOT NULL) AS issues FROM x WHERE d % 4 < 3)
SELECT concat('site/', d % 50, '/', d, '.md') AS source, concat('site/', d % 50, '/', d, '.fr.md') AS path, 'fr' AS lang, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS ok FROM y"""

# --- Ignore files ---------------------------------------------------------------------------------------------------------------------

#: Ignore files of the tree: of the top, and of folders by number; an ``.ignore`` is stronger than any ``.gitignore``.
_IGNORES = [
    (".gitignore", "# comment\n\ntmp/\n*.bak.md\n/g1?/**\n!/g15/**\ndraft-*.md\n!draft-*7.md\n\\!odd.md\n"), ("g2/.gitignore", "*.md\n!*0.md\n"), ("g3/deep/.gitignore", "!draft-*.md\n"), ("g4/.gitignore", "deep/\n!deep/keep.md\n"), (".ignore", "g5/*.md\n"), ("g6/.ignore", "!*.bak.md\n"),
]
_NAMES = "concat(case when d % 3 = 0 then 'draft-' else '' end, d, case when d % 11 = 0 then '.bak.md' else '.md' end)"
_FOLDERS = "concat('g', d % 17, case when d % 5 = 0 then '/deep' else '' end, case when d % 13 = 0 then '/tmp' else '' end)"


def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a tree of all documents are found, by an argument each for the whole and for two folders, and the arguments that name nothing."""
    docs = _documents(spark, sf_dir).selectExpr(f"concat({_FOLDERS}, '/', {_NAMES}) AS path", "t AS text").unionByName(spark.createDataFrame(_IGNORES, "path string, text string"))
    files = materialized(docs)
    whole = ignores.walk(files)
    some = ignores.walk(files, ["g2", "g7/", "nowhere", "g8/nothing.md"])
    rows = whole.found.select(F.lit("found").alias("kind"), "path").unionByName(some.found.select(F.lit("found below two folders").alias("kind"), "path"))
    return rows.unionByName(some.missing.select(F.lit("missing").alias("kind"), F.col("argument").alias("path")))


WALK_SQL = f"""WITH f AS (SELECT d, d % 17 AS g, d % 5 = 0 AS deep, d % 13 = 0 AS tmp, d % 3 = 0 AS draft, d % 11 = 0 AS bak, concat({_FOLDERS}, '/', {_NAMES}) AS path FROM {_DOCS}),
k AS (SELECT *, CASE WHEN g = 15 THEN NOT draft OR (d % 10 = 7 AND NOT bak) WHEN tmp THEN false WHEN g = 4 AND deep THEN false WHEN g BETWEEN 10 AND 16 THEN NOT deep AND draft AND d % 10 = 7 AND NOT bak
  WHEN g = 5 AND NOT deep THEN false WHEN g = 6 AND bak THEN true WHEN g = 2 THEN d % 10 = 0 AND NOT bak WHEN g = 3 AND deep AND draft THEN true WHEN draft THEN d % 10 = 7 AND NOT bak WHEN bak THEN false ELSE true END AS kept FROM f)
SELECT 'found' AS kind, path FROM k WHERE kept UNION ALL SELECT 'found below two folders', path FROM k WHERE kept AND g IN (2, 7) UNION ALL SELECT 'missing', unnest(['nowhere', 'g8/nothing.md'])"""

# --- JSON edit events and streams -----------------------------------------------------------------------------------------------------

_EVENT = """concat('{"tool": {"file_path": "docs/p', user_id, '/a.md", "note": "no path"}, "list": ["x", "notes ', event_id % 40, '.txt", {"path": "file:///w/', event_type, '.md"}, [["deep/', event_id % 7, '"]]], "quo\\\\"te/key": "q\\\\"u', event_id % 9, '.mdx", "n": 1.5, "none": null, "esc": "\\\\u00e9\\\\/', user_id % 5, '", "props": ', coalesce(props, '{}'), '}')"""


def edit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events name each path: JSON made of every event, with nested objects and lists, escapes and keys that look like paths."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"{_EVENT} AS value")
    return edited_paths(events).groupBy("path").agg(F.count("*").alias("n"))


EDITS_SQL = f"""WITH j AS (SELECT event_id, {_plain(_EVENT)} AS value FROM events), s AS (SELECT DISTINCT event_id, json_extract_string(t.value, '$') AS text FROM j, json_tree(j.value) t WHERE t.type = 'VARCHAR')
SELECT regexp_replace(text, '^file://', '') AS path, count(*) AS n FROM s WHERE contains(text, '/') OR regexp_matches(text, '\\.(md|mdx|mdc|txt)$') GROUP BY 1"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of their files (a pattern, as the table may be one file)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def edits_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of all events as a stream tells them apart under a watermark that is wider than the table."""
    events = _stream(spark, sf_dir).selectExpr(f"{_EVENT} AS value", "ts AS at")
    return landed(edited_once(events, "3650 days")).select("path")


EDITS_ONCE_SQL = EDITS_SQL.replace("AS path, count(*) AS n", "AS path")

_EDITED = "concat('docs/g', user_id, case event_type when 'click' then '.fr.md' when 'signup' then '.de.md' else '.md' end)"


def stale_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations as they fall behind, by a stream of edits: events are edits of a user's document or of its two translations."""
    edits = _stream(spark, sf_dir).selectExpr(f"{_EDITED} AS path", "ts AS modified")
    found = landed(fallen_behind(edits))
    return found.select("source", "path", "lang", F.unix_micros("changed").alias("changed"), F.unix_micros("translated").alias("translated"))


STALE_SQL = f"""WITH e AS (SELECT {_EDITED} AS path, ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), s AS (SELECT DISTINCT path AS source, ts FROM e WHERE regexp_matches(path, 'g[0-9]+\\.md$')),
t AS (SELECT path, ts, regexp_extract(path, '\\.(fr|de)\\.md$', 1) AS lang, regexp_replace(path, '\\.(fr|de)\\.md$', '.md') AS source FROM e WHERE regexp_matches(path, '\\.(fr|de)\\.md$')),
p AS (SELECT s.source, t.path, t.lang, s.ts AS changed, max(t.ts) AS translated FROM s JOIN t ON t.source = s.source AND t.ts <= s.ts GROUP BY s.source, t.path, t.lang, s.ts)
SELECT source, path, lang, epoch_us(changed) AS changed, epoch_us(translated) AS translated FROM p WHERE translated < changed AND NOT EXISTS (SELECT 1 FROM s WHERE s.source = p.source AND s.ts > p.translated AND s.ts < p.changed)"""

# --- Code: spans and strings ----------------------------------------------------------------------------------------------------------

#: Files of four languages (d: id, n: number of body lines), with nested, private and later declarations, and the whole text as a comment's lines.
_CODE = {
    "rs": "concat('pub fn run_', d, '() {\\n', repeat('    x();\\n', n), '}\\nfn hidden() {}\\npub(crate) struct T', d, ';\\nmod m {\\n    pub async fn inner_', d, '() {}\\n    pub const K: u8 = 1;\\n}\\n')",
    "py": "concat('class App', d, ':\\n', repeat('    x = 1\\n', n), '    def _own(self):\\n        pass\\n\\n    async def go_', d, '(self):\\n        pass\\n\\ndef after_', d, '():\\n    pass\\n')",
    "ts": "concat('export default async function f', d, '() {\\n', repeat('  y();\\n', n), '}\\nconst hidden = 2;\\nexport interface I', d, ' {}\\n')",
    "go": "concat('package p\\n\\nfunc (r T) Do', d, '() {\\n', repeat('\\tz()\\n', n), '}\\nfunc hidden() {}\\ntype Kind', d, ' int\\nvar (\\n)\\n')",
}
_EXTS = list(_CODE)


def code_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and lines of declarations in a file of each document, in one of four languages."""
    docs = _documents(spark, sf_dir).selectExpr("d", "cast(length(t) % 23 as int) AS n")
    files = None
    for i, (ext, text) in enumerate(_CODE.items()):
        own = docs.where(f"d % 4 = {i}").selectExpr(f"concat('src/', d, '.{ext}') AS path", f"{text} AS text")
        files = own if files is None else files.unionByName(own)
    return declarations.spans(files).select("path", "name", "start_line", "end_line")


#: Name, first and last line of each file's declarations.
_SPAN_ROWS = {
    "rs": ["'run_' || d, 1, n + 3", "'T' || d, n + 4, n + 8", "'inner_' || d, n + 6, n + 6", "'K', n + 7, n + 8"],
    "py": ["'App' || d, 1, n + 7", "'_own', n + 2, n + 4", "'go_' || d, n + 5, n + 7", "'after_' || d, n + 8, n + 9"],
    "ts": ["'f' || d, 1, n + 2", "'I' || d, n + 4, n + 4"],
    "go": ["'Do' || d, 3, n + 4", "'Kind' || d, n + 6, n + 6"],
}
SPANS_SQL = f"WITH x AS (SELECT d, length(t) % 23 AS n FROM {_DOCS}), r(path, name, a, b) AS (" + " UNION ALL ".join(f"SELECT concat('src/', d, '.{ext}'), {row} FROM x WHERE d % 4 = {i}" for i, (ext, rows) in enumerate(_SPAN_ROWS.items()) for row in rows) + ") SELECT path, name, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM r"

#: A file of strings of each document: its text without marks that end a string stands in one of them.
_MARKS = "concat('\"\\\\`', chr(39), '<>{}', chr(10), chr(13))"
_STRINGS = f"""concat('import {{ A }} from "./lib of things";\n// a "comment that says something"\n<p className="flex items center" title="Read page ', d, ' now">Save the ', s, ' changes</p>\nconst label = "Keep all your files";\nconst msg = `Hello $', '{{name}} my friend`;\n',
 'export {{ x }} from "some other place";\nconst y = require("a big thing");\n<b data-x="hidden words stay here" points="one two three words" value="shown words stay here" onLoad="do not show this" dataset="not this one either"/>\nconst said = "', translate(t, {_MARKS}, '          '), '";\n  * a "line of a comment"\n')"""


def copy_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that read like copy in a file of every document, each text whole in one of them."""
    files = _documents(spark, sf_dir).selectExpr("concat('ui/', d, case when d % 9 = 0 then '.test' else '' end, '.tsx') AS path", f"{_STRINGS} AS text")
    return code_strings(files).select("path", "line", F.md5(F.col("text").cast("binary")).alias("text_md5"))


COPY_SQL = f"""WITH x AS (SELECT d, s, translate(t, {_plain(_MARKS)}, '          ') AS t FROM {_DOCS} WHERE d % 9 <> 0), w AS (SELECT d, t, trim(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS u FROM x),
k AS (SELECT d, t FROM w WHERE strlen(u) >= 4 AND contains(u, ' ') AND NOT contains(u, '://') AND NOT regexp_matches(u, '^\\.{{0,2}}/') AND regexp_matches(u, '[a-z]')
  AND len(list_filter(list_transform(string_split_regex(u, '\\s+'), lambda a: regexp_replace(a, '^[.,!?:;"'']+|[.,!?:;"'']+$', '', 'g')), lambda a: regexp_matches(a, '^\\pL{{2,}}$'))) >= 2),
r AS (SELECT d, 3 AS line, unnest([concat('Read page ', d, ' now'), concat('Save the ', s, ' changes')]) AS text FROM x UNION ALL SELECT d, 4, 'Keep all your files' FROM x UNION ALL SELECT d, 8, 'shown words stay here' FROM x UNION ALL SELECT d, 9, t FROM k)
SELECT concat('ui/', d, '.tsx') AS path, CAST(line AS INTEGER) AS line, md5(text) AS text_md5 FROM r"""

# --- Rules on edits, orders, and windows in bytes -------------------------------------------------------------------------------------

_TOUCHED = "concat(case event_id % 4 when 0 then 'src/' when 1 then 'docs/guide/' when 2 then 'docs/' else '' end, 'u', user_id, '/f', event_id % 20, case event_id % 3 when 0 then '.py' when 1 then '.md' else '.rs' end)"
_RULES = [
    ("code", ["src/**"], ["**/f7.py"], "code changed"), ("guide", ["docs/guide/*.md", "docs/guide/**/f1?.rs"], None, "guide changed"), ("python", ["*.py"], ["docs/**"], "python changed"), ("two", ["docs/u{1,2}/*.{md,rs}"], None, "two changed"),
    ("odd", ["**/f[13579].*"], ["src/**", "docs/**"], "odd changed"), ("one", ["u1/f1.md"], None, "one changed"),
]


def edit_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules each edited path meets, by globs in folders, extensions and choices."""
    edits = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(f"{_TOUCHED} AS path")
    return project.notified(edits, spark.createDataFrame(_RULES, "name string, paths array<string>, exclude array<string>, message string"))


NOTICES_SQL = f"""WITH e AS (SELECT DISTINCT {_TOUCHED} AS path FROM events), f AS (SELECT path, regexp_extract(path, '[^/]*$') AS file, path LIKE 'src/%' AS src, path LIKE 'docs/%' AS docs FROM e)
SELECT path, 'code' AS name, 'code changed' AS message FROM f WHERE src AND file <> 'f7.py' UNION ALL SELECT path, 'guide', 'guide changed' FROM f WHERE path LIKE 'docs/guide/%.md' OR (path LIKE 'docs/guide/%' AND regexp_matches(file, '^f1[0-9]\\.rs$'))
UNION ALL SELECT path, 'python', 'python changed' FROM f WHERE path LIKE '%.py' AND NOT docs UNION ALL SELECT path, 'two', 'two changed' FROM f WHERE regexp_matches(path, '^docs/u[12]/.*\\.(md|rs)$')
UNION ALL SELECT path, 'odd', 'odd changed' FROM f WHERE regexp_matches(file, '^f[13579]\\.') AND NOT src AND NOT docs UNION ALL SELECT path, 'one', 'one changed' FROM f WHERE path = 'u1/f1.md'"""


def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents that aren't blank, numbered through in order of document and line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return order.numbered(line_units(docs.select(F.col("doc_id").alias("path"), "text")).select(F.col("path").alias("doc_id"), "line"), "doc_id", "line")


ORDER_SQL = """WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS ls FROM documents WHERE text IS NOT NULL)))
SELECT doc_id, CAST(i AS INTEGER) AS line, row_number() OVER (ORDER BY doc_id, i) - 1 AS n FROM l WHERE trim(line) <> ''"""


def cited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims before the whole text of each document, with a source so many characters of two bytes behind them."""
    docs = _documents(spark, sf_dir).selectExpr("d AS doc_id", "concat('Studies show it. ', repeat('é', cast(d % 130 as int)), ' see https://x.org ', t) AS text")
    return detect(docs, only=("vague-attribution",)).where("offset = 0").select("doc_id", "offset", "length", "severity")


CITED_SQL = f"""SELECT d AS doc_id, 0 AS "offset", 12 AS length, 'warn' AS severity FROM {_DOCS} WHERE 5 + 2 * (d % 130) + 5 + 8 > 200"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "markdown_outline": markdown_outline, "i18n_conform": i18n_conform, "tree_walk": tree_walk, "edit_paths": edit_paths, "edits_once": edits_once, "stale_notices": stale_notices, "code_spans": code_spans, "copy_strings": copy_strings,
    "edit_notices": edit_notices, "line_order": line_order, "cited_claims": cited_claims,
}
ORACLES: dict[str, str] = {
    "markdown_outline": OUTLINE_SQL, "i18n_conform": CONFORM_SQL, "tree_walk": WALK_SQL, "edit_paths": EDITS_SQL, "edits_once": EDITS_ONCE_SQL, "stale_notices": STALE_SQL, "code_spans": SPANS_SQL, "copy_strings": COPY_SQL,
    "edit_notices": NOTICES_SQL, "line_order": ORDER_SQL, "cited_claims": CITED_SQL,
}
