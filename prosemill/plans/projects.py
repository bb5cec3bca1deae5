"""A project tree derived from the documents, the same on both sides of a comparison, and the project checks in hand-written SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that stand beside those of the documents.
FIXED = [
    ("README.md", "# Project\n\nSee [setup](docs/setup.md#first-steps), [gone](docs/gone.md), [lost](docs/setup.md#nowhere) and [here](#project)."), ("docs/setup.md", "# Setup\n\n## First steps\n\n## First steps\n\n```\n# code\n```\n"),
    ("docs/setup.fr.md", "# Mise en place\n\n### Premiers pas\n"), ("docs/orphan.md", "# Orphan\n"), ("mkdocs.yml", "nav:\n  - Setup: setup.md\n  - Gone: missing.md\n  - One: p1/1.md\n"), ("LICENSE", "MIT"), ("CONTRIBUTING.md", "TODO"), ("SECURITY.md", "no heading"),
    ("conf/app.yml", "theme:\n  features:\n    search: true\n  name: x\n# no: key\nnav:\n  - Home: index.md\n"), ("conf/package.json", "{\n  \"scripts\": {\n    \"test\": \"x\"\n  },\n  \"name\": \"y\"\n}\n"), ("docs/cli.md", "# Cli\n\nRun `git status` or `thing`.\n\n```sh\n$ cargo test\n./tools/sync\nnot one\n```\n"),
    ("book.toml", "[book]\ntitle = \"x\"\n"), (".readthedocs.yaml", "version: 2\n"), ("page.html", "<a href=\"#top\">x</a>\n<p id=\"top\">\n<a href=\"#none\">y</a>"),
]

#: Path and text of what a document (d: its id, s: its source, t: its text) gives, and for which ids: expressions that both engines read alike.
PARTS = [
    ("true", "concat('docs/p', d % 97, '/', d, '.md')", "concat('# Page ', d % 13, '\\n\\n## ', s, '\\n\\n## ', s, '\\n\\nSee [a](', d + d % 3, '.md#page-', d % 13, '), [b](../p', d % 97, '/', d + 1, '.md) and [c](#', s, ').\\n\\n', t)"),
    ("d % 5 = 0", "concat('docs/p', d % 97, '/', d, '.fr.md')", "concat('# Page ', d % 13, '\\n\\n', case when d % 2 = 0 then '##' else '###' end, ' ', s, '\\n\\n', case when d % 3 = 0 then '## more\\n\\n' else '' end, 'Voir [c](#', s, ').')"),
    ("d % 11 = 0", "concat('p', d, '/POSTMORTEM.md')", "concat('# Incident\\n\\n## Summary\\n\\n', case when d % 2 = 0 then 'It was Human Error.\\n\\n## Impact\\n\\n' else '' end, '## Root cause\\n\\n## Lessons\\n\\n', t)"),
    ("d % 13 = 0", "concat('notes/', d, '.md')", "concat('# Note\\n\\n## Status\\n\\n## Context\\n\\n', case when d % 2 = 0 then '## Decision\\n\\n' else '' end, t)"),
    ("d % 7 = 0", "concat('src/m', d, '.rs')", "concat('pub fn run_', d, '() {}\\nstruct Hidden;\\n  pub(crate) struct T', d, ';\\nfn inner() {}\\n')"),
    ("d % 7 = 1", "concat('src/m', d, '.py')", "concat('class App', d, ':\\n    def go(self):\\n        pass\\nasync def f', d, '(): ...\\n')"),
    ("d % 7 = 2", "concat('src/m', d, '.ts')", "concat('export const v', d, ' = 1;\\nexport default function g', d, '() {}\\nconst hidden = 2;\\n')"),
    ("d % 7 = 3", "concat('src/m', d, '.toml')", "concat('[part.', d, ']\\nname = 1\\n# note\\n')"),
    ("d % 17 = 0", "concat('g', d, '/STYLE.md')", "concat('# Style\\n\\n## Terminology\\n\\n| use | not |\\n| --- | --- |\\n| word ', d, ' | w', d, ', x', d, ' |\\n| a | b |\\n\\n## Next\\n\\n| c | d |\\n| --- | --- |\\n| e | f |\\n')"),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): the tree of all documents and the fixed files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"), F.coalesce("source", F.lit("none")).alias("s"), F.coalesce("text", F.lit("")).alias("t"))
    out = spark.createDataFrame(FIXED, "path string, text string")
    for where, path, text in PARTS:
        out = out.unionByName(docs.where(where).selectExpr(f"{path} as path", f"{text} as text"))
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tree() -> str:
    fixed = ", ".join(f"({_quoted(p)}, {_quoted(t)})" for p, t in FIXED)
    say = lambda x: x.replace("\\n", "\n")
    parts = " UNION ALL ".join(f"SELECT {path}, {say(text)} FROM x WHERE {where}" for where, path, text in PARTS)
    return f"x AS (SELECT doc_id AS d, coalesce(source, 'none') AS s, coalesce(text, '') AS t FROM documents), f AS (SELECT * FROM (VALUES {fixed}) v(path, text) UNION ALL {parts})"


_HEADS = r"""l AS (SELECT path, i, ls[i] AS line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split_regex(text, '\r?\n') AS ls FROM f))),
o AS (SELECT path, i, line, regexp_matches(line, '^ {0,3}(?:```|~~~)') AS fence FROM l),
hh AS (SELECT path, i, line, fence, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY path ORDER BY i) % 2 AS opened FROM o),
h AS (SELECT path, i, length(regexp_extract(line, '^ {0,3}(#{1,6})[ \t]+\S', 1)) AS level, regexp_replace(regexp_replace(line, '^ {0,3}#{1,6}[ \t]+', ''), '[ \t]+#*[ \t]*$', '') AS name
  FROM hh WHERE opened = 0 AND NOT fence AND regexp_matches(line, '^ {0,3}#{1,6}[ \t]+\S'))"""

# Values of the checks, written out again here: files, archetypes' sections and markers that the fixed values of the engine must give.
_WANTED = "(VALUES ('README.md', 'error'), ('LICENSE', 'error'), ('CONTRIBUTING.md', 'error'), ('CODE_OF_CONDUCT.md', 'warn'), ('SECURITY.md', 'warn'), ('CHANGELOG.md', 'warn')) w(path, severity)"
_POSTMORTEM = "(VALUES ('Summary'), ('Impact'), ('Timeline'), ('Root Cause'), ('Action Items'), ('Lessons')) p(section)"
_KEY = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"

SQL = {
    "check_links": f"""WITH {_tree()}, {_HEADS},
a AS (SELECT path, CASE WHEN n = 1 THEN slug ELSE slug || '-' || (n - 1) END AS slug FROM (SELECT path, slug, row_number() OVER (PARTITION BY path, slug ORDER BY i) AS n FROM (SELECT path, i, replace(regexp_replace(lower(trim(name)), '[^\\w\\- ]', '', 'g'), ' ', '-') AS slug FROM h))),
k AS (SELECT path, unnest(regexp_extract_all(text, '\\[[^\\]\\n]*\\]\\(([^)\\s]+)(?:\\s+"[^"\\n]*")?\\)', 1)) AS target FROM f WHERE regexp_matches(path, '\\.md$')),
r AS (SELECT path, target, CASE WHEN target LIKE '#%' THEN path ELSE regexp_replace(regexp_replace(path, '[^/]*$', '') || split_part(target, '#', 1), '[^/]+/\\.\\./', '') END AS file, CASE WHEN contains(target, '#') THEN split_part(target, '#', 2) ELSE '' END AS anchor FROM k)
SELECT path, target, 'linked file is missing' AS message, 'link-broken' AS rule_id, 'error' AS severity FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = r.file)
UNION ALL SELECT path, target, CASE WHEN file = path THEN 'anchor is missing in this file' ELSE 'linked anchor is missing' END, 'link-broken', 'error' FROM r
WHERE anchor <> '' AND EXISTS (SELECT 1 FROM f WHERE f.path = r.file) AND NOT EXISTS (SELECT 1 FROM a WHERE a.path = r.file AND a.slug = r.anchor)""",
    "check_nav": f"""WITH {_tree()}, n AS (SELECT unnest(['setup.md', 'missing.md', 'p1/1.md']) AS target), m AS (SELECT path, regexp_replace(path, '^docs/', '') AS short FROM f WHERE path LIKE '%.md' AND path NOT LIKE '.%' AND regexp_extract(path, '[^/]*$') NOT IN ('README.md', 'LICENSE', 'CONTRIBUTING.md', 'CODE_OF_CONDUCT.md', 'SECURITY.md', 'CHANGELOG.md'))
SELECT 'nav-missing-target' AS rule_id, 'mkdocs.yml' AS path, target, 'error' AS severity FROM n WHERE target NOT IN (SELECT short FROM m) AND target NOT IN (SELECT path FROM m)
UNION ALL SELECT 'nav-orphan-page', path, 'mkdocs.yml', 'warn' FROM m WHERE short NOT IN (SELECT target FROM n) AND path NOT IN (SELECT target FROM n)""",
    "check_community": f"""WITH {_tree()} SELECT path, severity, 'community-missing-file' AS rule_id FROM {_WANTED} WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT w.path, w.severity, 'community-invalid-file' FROM {_WANTED} JOIN f ON f.path = w.path WHERE trim(text) IN ('', 'TODO', '<TODO>') OR (w.path LIKE '%.md' AND NOT regexp_matches(text, '(?m)^# \\S'))""",
    "check_sections": f"""WITH {_tree()}, {_HEADS}, p AS (SELECT path, section FROM f, {_POSTMORTEM} WHERE path LIKE '%/POSTMORTEM.md'
  UNION ALL SELECT path, section FROM f, (VALUES ('Getting Started'), ('Development'), ('Testing'), ('Pull Requests'), ('Code of Conduct')) q(section) WHERE path = 'CONTRIBUTING.md'
  UNION ALL SELECT path, section FROM f, (VALUES ('Supported Versions'), ('Reporting a Vulnerability'), ('Response Process')) q(section) WHERE path = 'SECURITY.md')
SELECT path, section AS target, 'asset-missing-section' AS rule_id, 'error' AS severity FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.path = p.path AND {_KEY.format('h.name')} = {_KEY.format('p.section')})""",
    "postmortem_blame": f"""WITH {_tree()} SELECT path, phrase AS target, 'postmortem-blame' AS rule_id, 'error' AS severity FROM f, (VALUES ('human error'), ('operator error'), ('careless'), ('negligent'), ('should have known')) b(phrase) WHERE path LIKE '%POSTMORTEM.md' AND contains(lower(text), phrase)""",
    "asset_detect": f"""WITH {_tree()}, {_HEADS}, k AS (SELECT DISTINCT path, {_KEY.format('name')} AS key FROM h)
SELECT path, 'postmortem' AS archetype FROM f WHERE path LIKE '%/POSTMORTEM.md' UNION ALL SELECT path, CASE path WHEN 'SECURITY.md' THEN 'security' ELSE 'contributing' END FROM f WHERE path IN ('SECURITY.md', 'CONTRIBUTING.md')
UNION ALL SELECT path, 'adr' FROM k WHERE path NOT LIKE '%POSTMORTEM.md' AND key IN ('status', 'context', 'decision', 'consequences') GROUP BY path HAVING count(*) >= 3""",
    "platform_detect": f"""WITH {_tree()}, m(platform, k, path) AS (VALUES ('mkdocs', 0, 'mkdocs.yml'), ('mkdocs', 1, 'mkdocs.yaml'), ('mdbook', 0, 'book.toml'), ('readthedocs', 0, '.readthedocs.yaml'), ('readthedocs', 1, 'readthedocs.yml'), ('jekyll', 0, '_config.yml'), ('docsify', 0, 'index.html'), ('gitbook', 0, '.gitbook.yaml'))
SELECT platform, min_by(m.path, k) AS marker FROM m JOIN f ON f.path = m.path GROUP BY platform""",
    "i18n_siblings": f"""WITH {_tree()} SELECT replace(path, '.fr.md', '.md') AS source, path, 'fr' AS lang FROM f WHERE path LIKE '%.fr.md' AND replace(path, '.fr.md', '.md') IN (SELECT path FROM f)""",
    "i18n_structure": f"""WITH {_tree()}, {_HEADS}, g AS (SELECT path, list(level ORDER BY i) AS levels FROM h GROUP BY path),
st AS (SELECT f.path, coalesce(g.levels, []) AS levels, len(regexp_extract_all(text, '(?m)^ {{0,3}}(?:```|~~~)')) // 2 AS fences, list_distinct(regexp_extract_all(text, '\\]\\(([^)\\s]+)\\)', 1)) AS targets FROM f LEFT JOIN g ON g.path = f.path),
p AS (SELECT t.path, s.path AS source, s.levels AS sl, t.levels AS tl, s.fences AS sf, t.fences AS tf, s.targets AS sg, t.targets AS tg FROM st t JOIN st s ON s.path = replace(t.path, '.fr.md', '.md') WHERE t.path LIKE '%.fr.md')
SELECT path, source, CASE WHEN len(sl) <> len(tl) THEN 'heading count differs: ' || len(sl) || ' in source, ' || len(tl) || ' here' ELSE 'heading levels differ' END AS issue FROM p WHERE sl <> tl
UNION ALL SELECT path, source, 'code block count differs: ' || sf || ' in source, ' || tf || ' here' FROM p WHERE sf <> tf
UNION ALL SELECT path, source, 'missing link: ' || u FROM (SELECT path, source, unnest(list_filter(sg, lambda x: NOT list_contains(tg, x))) AS u FROM p)""",
    "surface_symbols": f"""WITH {_tree()}, l AS (SELECT path, i, ls[i] AS line FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split_regex(text, '\\r?\\n') AS ls FROM f))),
t AS (SELECT path, i, line, nullif(regexp_extract(line, '^\\[([\\w.-]+)\\]$', 1), '') AS section FROM l WHERE path LIKE '%.toml'),
u AS (SELECT path, i, line, section, last_value(section IGNORE NULLS) OVER (PARTITION BY path ORDER BY i) AS within FROM t),
s AS (SELECT path, i, line, CASE
  WHEN path LIKE '%.rs' THEN regexp_extract(line, '^ *pub(?:\\([a-z]+\\))? (?:fn|struct) (\\w+)', 1) WHEN path LIKE '%.py' THEN regexp_extract(line, '^ *(?:async )?(?:def|class) ([A-Za-z]\\w*)', 1)
  WHEN path LIKE '%.ts' THEN regexp_extract(line, '^ *export (?:default )?(?:function|const) (\\w+)', 1) WHEN path LIKE '%.md' THEN trim(regexp_extract(trim(line), '^#{{1,6}} (.*)$', 1)) ELSE '' END AS name FROM l)
SELECT CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'js-ts' ELSE 'heading' END AS kind, name, path AS file, CAST(i AS INTEGER) AS line, trim(line) AS signature FROM s WHERE name <> ''
UNION ALL SELECT 'config', coalesce(section, within || '.' || regexp_extract(line, '^(\\w+) =', 1)), path, CAST(i AS INTEGER), line FROM u WHERE section IS NOT NULL OR regexp_matches(line, '^\\w+ =')
UNION ALL SELECT * FROM (VALUES ('config', 'theme', 'conf/app.yml', 1, 'theme:'), ('config', 'theme.features', 'conf/app.yml', 2, 'features:'), ('config', 'theme.features.search', 'conf/app.yml', 3, 'search: true'), ('config', 'theme.name', 'conf/app.yml', 4, 'name: x'), ('config', 'nav', 'conf/app.yml', 6, 'nav:'),
  ('config', 'scripts', 'conf/package.json', 2, '"scripts": {{'), ('config', 'scripts.test', 'conf/package.json', 3, '"test": "x"'), ('config', 'name', 'conf/package.json', 5, '"name": "y"'), ('config', 'nav', 'mkdocs.yml', 1, 'nav:'), ('config', 'version', '.readthedocs.yaml', 1, 'version: 2'),
  ('command', 'git', 'docs/cli.md', 3, 'git status'), ('command', 'cargo', 'docs/cli.md', 6, 'cargo test'), ('command', './tools/sync', 'docs/cli.md', 7, './tools/sync')) v(kind, name, file, line, signature)""",
    "glossary": f"""WITH {_tree()} SELECT path, 'word ' || d AS "use", unnest(['w' || d, 'x' || d]) AS variant FROM (SELECT concat('g', d, '/STYLE.md') AS path, d FROM x WHERE d % 17 = 0) UNION ALL SELECT concat('g', d, '/STYLE.md'), 'a', 'b' FROM x WHERE d % 17 = 0""",
}
