"""Blocks, ignore files, edit events, streams, spans, globs, orders and whole-project reports, against plain versions."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prosemill.operators import declarations, ignores, project
from prosemill.operators.commonmark import conform, outline, outlines
from prosemill.operators.detect import detect
from prosemill.operators.order import first_paths, numbered
from prosemill.plans import report, trees
from prosemill.sources import code_strings, edited_paths, ignore_files, listed, markdown_tree, text_files, translated_files
from prosemill.sources.sinks import audit, audit_lines
from prosemill.streaming import edited_once, fallen_behind, notices
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(trees.QUERIES))
def test_queries_equal_their_sql(spark, name):
    got, want = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert got == want and got


# --- Markdown by blocks ---------------------------------------------------------------------------------------------------------------

BLOCKS = [  # text, heading levels, code blocks, links
    ("Title\n=====\n\nSub\n---\ntext", [1, 2], 0, []), ("> # Foo\n> bar\n> baz\n", [1], 0, []), ("> Head\n> ---\n", [2], 0, []), ("> foo\n---\n", [], 0, []), ("- Foo\n---\n", [], 0, []), ("- # Foo\n- Bar\n  ---\n  baz", [1, 2], 0, []),
    ("    code\n\npara\n    lazy", [], 1, []), ("- a\n\n      code in item\n", [], 1, []), ("1. one\n\n   ```\n   x\n   ```\n2. two", [], 1, []), ("```\n# no\n~~~\n```\n# yes", [1], 1, []), ("~~~~\n~~~\n# no\n", [], 1, []),
    ('[a]: /x "t"\n\nsee [a], [A][], [t][a], [no]', [], 0, ["/x"]), ("[foo]: /url\n===\n[foo]", [], 0, ["/url"]), ("# head [l](u) ##\n", [1], 0, ["u"]), ("![i](img) [x](<a b>) [y](p\\)q) `[c](d)`", [], 0, ["a b", "p)q"]),
    ("[a [b](in) c](out)", [], 0, ["in"]), ("[![i](pic)](out)", [], 0, ["out"]), ("<https://e.org/x> and <me@e.org> <b>", [], 0, ["https://e.org/x", "me@e.org"]), ("| a | b |\n|---|---|\n| [x](y) | z |\n\nafter", [], 0, ["y"]),
    ("a | b\n--- | ---\nc | d", [], 0, []), ("text[^1]\n\n[^1]: note\n    # inside\n", [1], 0, []), ("<div>\n# no\n</div>\n\n# yes", [1], 0, []), ("<!-- # no\n# no\n--> \n# yes", [1], 0, []), ("#no\n####### no\n#\n", [1], 0, []),
    ("***\n---\n___\n", [], 0, []), ("para\n***\npara\n- x\n", [], 0, []), ("14. not\npara\n14. text", [], 0, []), ("-\n\n  foo\n", [], 0, []), ("- a\n  - b\n    - c\n      # deep\n", [1], 0, []), ("> ```\n> aaa\n\nbbb", [], 1, []),
    (">     code\n\n>    not code", [], 1, []), ("Foo\nbar\n===", [1], 0, []), ("`Foo\n----\n`\n", [2], 0, []), ("\ttab code", [], 1, []), ("- foo\n\n\tbar\n\n\t\tcode", [], 1, []), ("[a](x \"t\") [b](y 't') [c](z (t)) [d](w t)", [], 0, ["x", "y", "z"]),
    ("[a](one(two(three)))", [], 0, ["one(two(three))"]), ("a\r\n=\r\nb", [1], 0, []), ("[x]:\n/u\n'ti'\n\n[X]", [], 0, ["/u"]), ("* * *\n* a\n", [], 0, []), ("text\n    # not\n# yes", [1], 0, []), ("&lt; [e](a&amp;b)", [], 0, ["a&b"]),
    ("", [], 0, []), (None, [], 0, []), ("\n \n\t\n", [], 0, []), ("Foo\n-\nbar", [2], 0, []), ("> a\n# b\n> c", [1], 0, []),
]


def test_blocks(spark):
    for text, levels, code, links in BLOCKS:
        got = outline(text)
        assert (got.levels, got.code_blocks, got.links) == (levels, code, links), text
    df = spark.createDataFrame([(f"{i}.md", b[0], 1) for i, b in enumerate(BLOCKS)], "path string, text string, links int")
    rows = {r.path: (r.levels, r.code_blocks, r.links) for r in outlines(df).collect()}
    assert rows == {f"{i}.md": (b[1], b[2], b[3]) for i, b in enumerate(BLOCKS)}
    assert outlines(df.limit(0)).collect() == []


@pytest.mark.parametrize("piece", ["[a", "`a", "``` ", "> ", "- ", "[](", "<", "![", "a | b\n", "]", "\\", "<!-- ", "&", "*"])
def test_blocks_in_linear_time(piece):
    def took(n):
        begin = time.time()
        outline(piece * n)
        return time.time() - begin

    assert took(2000) < 1 and took(16_000) < 8


def test_conform_says_what_a_translation_lacks(spark):
    files = spark.createDataFrame([("a.md", "A\n=\n\n[x](one.md)\n\n[y][r]\n\n[r]: two.md\n\n    code"), ("a.fr.md", "# A\n\n## B"), ("a.de.md", None), ("b.md", "no pair")], "path string, text string")
    pairs = spark.createDataFrame([("a.md", "a.fr.md", "fr"), ("a.md", "a.de.md", "de")], "source string, path string, lang string")
    got = {r.lang: r.issues for r in conform(files, pairs).collect()}
    lost = "missing link target(s): one.md, two.md"
    assert got == {"fr": ["heading count differs: source=1 translation=2", "code block count differs: source=1 translation=0", lost], "de": ["heading count differs: source=1 translation=0", "code block count differs: source=1 translation=0", lost]}


# --- Ignore files ---------------------------------------------------------------------------------------------------------------------


def matches(pattern, rest):
    """One pattern's path part against a path, segment by segment."""

    def segment(p, s):
        if not p:
            return not s
        if p[0] == "*":
            return segment(p[1:], s) or (bool(s) and segment(p, s[1:]))
        if p[0] == "[" and "]" in p[2:]:
            end = p.index("]", 2)
            body = p[1:end]
            negated = body[0] in "!^"
            return bool(s) and ((s[0] in body.lstrip("!^")) != negated) and segment(p[end + 1 :], s[1:])
        if p[0] == "\\" and len(p) > 1:
            return s[:1] == p[1] and segment(p[2:], s[1:])
        return bool(s) and p[0] in ("?", s[0]) and segment(p[1:], s[1:])

    def parts(ps, ss):
        if not ps:
            return not ss
        if ps[0] == "**":
            return (len(ps) == 1 and bool(ss)) or (len(ps) > 1 and any(parts(ps[1:], ss[k:]) for k in range(len(ss) + 1)))
        return bool(ss) and segment(ps[0], ss[0]) and parts(ps[1:], ss[1:])

    return parts(pattern, rest)


def plain_ignored(path, files):
    """Walks down to a path; at each step the last match of the strongest and deepest ignore file decides."""
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        verdict = None
        for strength in (".gitignore", ".ignore"):
            own = None
            for at in range(depth):
                folder = "/".join(parts[:at])
                for line in files.get(f"{folder}/{strength}".lstrip("/"), "").split("\n"):
                    line = line.rstrip(" \t")
                    if not line or line.startswith("#"):
                        continue
                    again = line.startswith("!")
                    glob = re.sub(r"^\\([#!])", r"\1", line[1:] if again else line)
                    only_folders, bare = glob.endswith("/"), glob.rstrip("/")
                    if only_folders and depth == len(parts):
                        continue
                    ps = bare.lstrip("/").split("/")
                    if matches(ps if "/" in bare else ["**", *ps], parts[at:depth]):
                        own = not again
            verdict = own if own is not None else verdict
        if verdict:
            return True
    return False


def test_ignored_as_a_walk_decides(spark):
    r = random.Random(4)
    folders = ["", "a/", "a/b/", "b/", "b/a/", "c/", "a/c/d/"]
    names = ["x.md", "y.md", "xy.txt", "#h.md", "!n.md", "build", "k9.log"]
    globs = ["*.md", "!x.md", "b/", "/a", "!a/b/", "**/d/**", "a/**/x.md", "a/**", "y.*", "[xk]*", "[!xk]*.md", "?.md", "\\#h.md", "\\!n.md", "# no", "", "c", "!c/", "/*/x.md", "*.log  ", "d/x.md", "**/build", "b/**/y.md"]
    for _ in range(12):
        ignore = {f"{f}{kind}": "\n".join(r.sample(globs, r.randint(1, 5))) for f in folders for kind in (".gitignore", ".ignore") if r.random() < 0.3}
        paths = [f"{f}{n}" for f in folders for n in names]
        files = spark.createDataFrame([*[(p, "") for p in paths], *ignore.items()], "path string, text string")
        got = {x.path for x in ignores.ignored_paths(files.where(~F.col("path").rlike("ignore$")), ignores.ignore_rules(files)).collect()}
        assert got == {p for p in paths if plain_ignored(p, ignore)}, ignore


def test_tree_of_real_files(spark, tmp_path):
    made = {"a.md": "A", "sub/b.md": "B", "sub/c.txt": "C", "tmp/d.md": "D", "node_modules/e.md": "E", "sub/deep/f.mdx": "F", "sub/deep/g.md": "G", ".gitignore": "tmp/\n", "sub/.gitignore": "g.md\n", "z.html": "<p>", "a b+c%.md": "odd", "sub/h[1].md": "H"}
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = str(tmp_path)
    assert sorted(map(tuple, ignore_files(spark, root).collect())) == [(".gitignore", "tmp/\n"), ("sub/.gitignore", "g.md\n")]
    whole = markdown_tree(spark, root)
    assert sorted((r.path, r.text) for r in whole.found.collect()) == [("a b+c%.md", "odd"), ("a.md", "A"), ("sub/b.md", "B"), ("sub/deep/f.mdx", "F"), ("sub/h[1].md", "H")] and whole.missing.count() == 0
    some = markdown_tree(spark, root, ["sub", "gone.md", "sub/c.txt", "./tmp/d.md"])
    assert sorted(r.path for r in some.found.collect()) == ["sub/b.md", "sub/deep/f.mdx", "sub/h[1].md", "tmp/d.md"]
    assert [r.argument for r in some.missing.collect()] == ["gone.md"] and [r.argument for r in some.passed.collect()] == ["sub/c.txt"]
    # A limit takes the first in order of path and opens no other file.
    first = markdown_tree(spark, root, limit=3).found
    assert sorted(r.path for r in first.collect()) == ["a b+c%.md", "a.md", "sub/b.md"] and len(first.inputFiles()) == 3
    assert sorted(r.text for r in markdown_tree(spark, root, ["sub"], limit=3).found.collect()) == ["B", "F", "H"]
    two = text_files(spark, root, limit=2)
    assert len(two.inputFiles()) == 2 and sorted(r.path for r in two.collect()) == ["a b+c%.md", "a.md"] and text_files(spark, root, limit=0).count() == 0
    assert first_paths(listed(spark, root), 2) == ["a b+c%.md", "a.md"] and sorted(r.path for r in translated_files(spark, root).collect()) == ["a b+c%.md", "a.md", "sub/b.md", "sub/c.txt", "sub/deep/f.mdx", "sub/deep/g.md", "sub/h[1].md", "tmp/d.md", "z.html"]


# --- JSON edit events and streams -----------------------------------------------------------------------------------------------------


def json_strings(value):
    if isinstance(value, str):
        yield value
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from json_strings(x)


def test_paths_of_events_are_those_that_a_parser_finds(spark):
    r = random.Random(2)
    texts = ["a/b", "x.md", 'q"u/o', "back\\slash/", "é/ü", "tab\t/", "no", "file:///w/x.txt", "a:b/c", "{/}", "[x].mdx", "", "x.md\n", "\u2028.md", ":/"]

    def value(depth):
        kind = r.randrange(7 if depth < 4 else 4)
        return [r.choice(texts), r.random(), None, True][kind] if kind < 4 else {r.choice(texts): value(depth + 1) for _ in range(3)} if kind < 6 else [value(depth + 1) for _ in range(3)]

    made = [{"v": value(0), "w": [value(0)]} for _ in range(200)]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=None if i % 3 else 1)) for i, v in enumerate(made)] + [(900, None), (901, ""), (902, '{"a": "x/y"'), (903, '"x/y"'), (904, "{'a': 'x/y'}")]
    got = sorted((x.i, x.path) for x in edited_paths(spark.createDataFrame(rows, "i int, value string"), keep=("i",)).collect())
    shaped = lambda t: "/" in t or t.endswith((".md", ".mdx", ".mdc", ".txt"))
    want = sorted({(i, t.removeprefix("file://")) for i, v in enumerate(made) for t in json_strings(v) if shaped(t)} | {(903, "x/y")})
    assert got == want
    inside = edited_paths(spark.createDataFrame([('["/r/a.md", "/rx/b.md"]',)], "value string"), root="/r/")
    assert sorted(x.path for x in inside.collect()) == ["/rx/b.md", "a.md"]


def run_stream(spark, tmp_path, name, schema, batches, make):
    """Rows of a stream whose files come one after the other, with a restart from the checkpoint between them."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / name / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name / "out")).collect()


def test_repeated_and_late_events(spark, tmp_path):
    from datetime import datetime as t

    at = lambda h, m=0: t(2024, 1, 1, h, m)
    event = lambda *paths: json.dumps({"paths": list(paths)})
    batches = [
        [(event("a.md", "b.md"), at(1)), (event("a.md"), at(1, 5)), (None, at(1)), ("no", at(1))],
        [(event("a.md"), at(1, 8)), (event("c.md"), at(5))],  # a.md again within the delay; the watermark is then 4:50
        [(event("b.md"), at(1, 30)), (event("a.md"), at(5, 1)), (event("c.md"), at(5, 2))],  # b.md too late, a.md edited anew
    ]
    rows = run_stream(spark, tmp_path, "once", "value string, at timestamp", batches, lambda s: edited_once(s, "10 minutes"))
    assert sorted((r.path, r.at) for r in rows if r.path != "a.md" or r.at.hour != 1) == [("a.md", at(5, 1)), ("b.md", at(1)), ("c.md", at(5))]
    assert sum(r.path == "a.md" and r.at.hour == 1 for r in rows) == 1


def plain_behind(edits):
    """Rows as edits come in order of time: a translation is told of when its source becomes newer than it."""
    changed, known, out = {}, {}, []
    for path, at in sorted(edits, key=lambda e: (e[1], ".fr." not in e[0] and ".de." not in e[0], e[0])):
        source = re.sub(r"\.(fr|de)\.md$", ".md", path)
        if source != path:
            known[path] = [at, False]
        else:
            changed[source] = at
            for p, state in sorted(known.items()):
                if re.sub(r"\.(fr|de)\.md$", ".md", p) == source and state[0] < at and not state[1]:
                    state[1] = True
                    out.append((source, p, at, state[0]))
    return sorted(out)


def test_translations_fall_behind_alike_in_one_batch_and_in_many(spark, tmp_path):
    from datetime import datetime, timedelta

    r = random.Random(7)
    names = ["a.md", "a.fr.md", "a.de.md", "d/b.md", "d/b.fr.md", "alone.md"]
    edits = [(r.choice(names), datetime(2024, 1, 1) + timedelta(minutes=k // 2)) for k in range(160)]
    schema = "path string, modified timestamp"
    rows = {}
    for name, cuts in (("one", [160]), ("many", [20, 21, 90, 160])):
        # A minute's edits stay in one batch.
        batches = [edits[a:b] for a, b in zip([0, *[c // 2 * 2 for c in cuts]], [c // 2 * 2 for c in cuts]) if edits[a:b]]
        got = run_stream(spark, tmp_path, name, schema, [*batches, [(None, datetime(2025, 1, 1)), ("a.md", None)]], fallen_behind)
        rows[name] = sorted((x.source, x.path, x.changed, x.translated) for x in got)
    assert rows["one"] == rows["many"] == plain_behind(edits) and len(rows["one"]) > 10


def test_notices_ask_for_times(spark):
    times = {"a.md": 5, "a.fr.md": 3, "a.de.md": 7}
    files = spark.createDataFrame([(p, "", t) for p, t in times.items()], "path string, text string, t int").select("path", "text", F.timestamp_seconds("t").alias("modified"))
    edits = spark.createDataFrame([("a.md",), ("b.md",)], "path string")
    none = spark.createDataFrame([], "name string, paths array<string>, exclude array<string>, message string")
    assert [r.message for r in notices(edits, files, none).collect()] == ["translation may be stale: a.fr.md"]
    assert notices(edits, files.drop("modified"), none).count() == 2


# --- Code -----------------------------------------------------------------------------------------------------------------------------

CODE = {
    "a.py": "import os\nclass A:\n    x = 1\n    def f(self):\n        def inner():\n            pass\n        return 1\n\n    async def g(self): pass\nasync def h():\n\tpass\n_x = 2\ndef _p(): pass\n",
    "b.rs": "pub(crate) fn a() {\n}\nfn private() {}\n    pub struct B;\npub async fn c() {}\npub enum\tE {}\nimpl X {\n    pub fn m() {}\n    pub const K: u8 = 1;\n}\npub (x) fn no() {}\n",
    "c.ts": "export default function f() {}\nexport const a = 1, b = 2;\nexport async const no = 1;\n  export type T$ = {};\nconst x = 1;\nexport default class {}\nexport abstract class Q {}\nexport enum E {}",
    "d.go": "func Do() {}\nfunc (r *T) Meth() {\n}\nfunc private() {}\ntype Kind int\nvar Big = 1\nconst (\n)\nfunc (r T)Other() {}\n",
    "e.md": "# A\ntext\n## B\n# A\n### Deep one!\n## A\n", "f.txt": "def no(): pass", "g.py": "", "h.py": None,
}
# The kinds of lines that declare something, written out apart from the library.
DECLARES = {
    "py": [r"\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"\s*class\s+([A-Za-z_]\w*)"], "rs": [r"\s*pub(?:\([^)]*\))?\s+(?:async\s+)?fn\s+([A-Za-z_]\w*)", r"\s*pub(?:\([^)]*\))?\s+(?:struct|enum|trait|type|const|static|mod)\s+([A-Za-z_]\w*)"],
    "ts": [r"\s*export\s+(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", r"\s*export\s+(?:default\s+)?(?:const|let|var|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)"],
    "go": [r"\s*func\s+([A-Z]\w*)", r"\s*func\s+\([^)]*\)\s*([A-Z]\w*)", r"\s*type\s+([A-Z]\w*)", r"\s*(?:const|var)\s+([A-Z]\w*)"],
}
ENDS = ("pub ", "pub(", "export ", "def ", "async def ", "class ", "func ", "type ", "const ", "var ")


def plain_spans(text, ext):
    lines = text.removesuffix("\n").split("\n") if text else []
    for i, line in enumerate(lines):
        name = next((m[1] for p in DECLARES[ext] if (m := re.match(p, line))), None)
        if name:
            indent = len(line) - len(line.lstrip())
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent and lines[j].lstrip().startswith(ENDS)), len(lines))
            yield name, i + 1, end


def test_spans_of_four_languages(spark):
    files = spark.createDataFrame(list(CODE.items()), "path string, text string")
    got = sorted((r.path, r.start_line, r.name, r.end_line) for r in declarations.spans(files).collect())
    want = sorted((p, a, n, b) for p, t in CODE.items() if p.rsplit(".", 1)[1] in DECLARES for n, a, b in plain_spans(t or "", p.rsplit(".", 1)[1]))
    assert [g for g in got if g[0] != "e.md"] == want
    # Of equal headings one inside the other, the inner one; else the first.
    assert [g for g in got if g[0] == "e.md"] == [("e.md", 1, "a", 3), ("e.md", 3, "b", 3), ("e.md", 5, "deep one", 5)]
    asked = spark.createDataFrame([("a.py", "A"), ("a.py", "_p"), ("a.py", "none"), ("e.md", "  DEEP one"), ("gone.py", "A"), ("h.py", "A")], "path string, symbol string")
    assert sorted((r.symbol, r.start_line, r.end_line) for r in project.symbol_span(files, asked).collect()) == [("  DEEP one", 5, 5), ("A", 2, 9), ("_p", 13, 13)]


def test_next_no_deeper():
    r = random.Random(1)
    for _ in range(100):
        depths = [r.randrange(5) for _ in range(r.randrange(40))]
        assert declarations.next_no_deeper(depths) == [next((j for j in range(i + 1, len(depths)) if depths[j] <= d), None) for i, d in enumerate(depths)]


def test_strings_that_read_like_copy(spark):
    lines = [
        ('<p title="Shown to all" className="not shown here">Plain words here</p>', ["Plain words here", "Shown to all"]), ('import { a } from "some words here";', []), ('export { a } from "some words here";', []), ('export const a = "some words here";', ["some words here"]),
        ('// "some words here"', []), ("/* 'some words here'", []), (" * 'some words here'", []), ('const x = require("some words here")', []), ('a = `Hello ${b} my "quoted inner words"`; c = "outer words here"', ["outer words here"]), ("x = 'it\\'s one of many'", ["it\\'s one of many"]),
        ('<a dataFoo="some words here" ARIA-label="some words here" onTap={"braced words here"} value="value words here" points="one two three words"/>', ["braced words here", "value words here"]), ('k: "./not a path here"', []), ('k: "see http://x y z"', []), ('k: "ALL CAPS HERE"', []), ('k: "one 2two"', []),
        ('k: "zwei Wörter, ja!"', ["zwei Wörter, ja!"]), ("to: 'some words here', label : 'label words here'", ["label words here"]), ('unclosed " and \'then these words\'', ["then these words"]),
    ]
    files = spark.createDataFrame([("a.TSX", "\r\n".join(x for x, _ in lines)), ("b.spec.ts", 'x = "some words here"'), ("c.js", None), ("d.py", 'x = "some words here"')], "path string, text string")
    assert sorted((r.line, r.text) for r in code_strings(files).collect()) == sorted((i + 1, t) for i, (_, ts) in enumerate(lines) for t in ts)


# --- Globs, orders, windows, reports --------------------------------------------------------------------------------------------------


def test_globs_meet_what_every_glob_on_every_path_would(spark):
    globs = ["**", "*", "*.md", "docs/**", "docs/*.md", "**/x.md", "docs/{a,b}/*.{md,py}", "src/app.py", "src/[ab]?.py", "a,b.md", "{src,docs}/**", "docs", "docs/a/x.*", "**/*.tar.gz", "src/[!a]*.py"]
    paths = ["x.md", "docs/x.md", "docs/a/x.md", "docs/a/y.py", "docs/c/y.py", "src/app.py", "src/ab.py", "src/bb.py", "a,b.md", "docs", "q.tar.gz", "d/q.tar.gz", "src/.hidden", "docs/a/x.tex", "b.md"]
    edits, rules = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g,) for g in globs], "glob string")
    got = project.globbed(edits, rules)
    assert sorted((r.path, r.glob) for r in got.collect()) == sorted((r.path, r.glob) for r in edits.crossJoin(rules).where(F.regexp_like("path", project.glob_regex(F.col("glob")))).collect())
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.glob for r in got.where("path = 'a,b.md'").collect()} == {"**", "*", "*.md", "a,b.md"} and not got.where("path = 'b.md' and glob = 'a,b.md'").count()


def test_numbers_without_one_sorting_task(spark):
    rows = [(k % 7, f"p{k * 37 % 1000:04}") for k in range(1000)]
    df = spark.createDataFrame(rows, "a int, p string").withColumn("n", F.lit("mine"))
    got = [(r.a, r.p) for r in numbered(df, "a", "p").orderBy("n").collect()]
    assert got == sorted(rows) and sorted(r.n for r in numbered(df, "a", "p").collect()) == list(range(1000))
    assert numbered(df.limit(0), "a", "p").collect() == [] and len({r.n for r in numbered(df.select("a"), "a").collect()}) == 1000
    plan = numbered(df, "a", "p")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_windows_count_bytes(spark):
    """A source counts where all of its mark stands in the 200 bytes behind a claim."""
    marks = ["](", "http://", "https://", "^1", "[1]", "[123]", "HTTP://", "[x]"]
    rows = []
    for m in marks:
        for pad in range(180, 204):
            rows += [(len(rows), f"Some say {'x' * (pad - 1)}{m} end", m, pad), (len(rows) + 1, f"Some say {'é' * ((pad - 1) // 2)}{'x' * ((pad - 1) % 2)}{m} end", m, pad)]
    found = {r.doc_id for r in detect(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), only=("vague-attribution",)).collect()}
    cited = lambda m, pad: m not in ("HTTP://", "[x]") and pad + len(m) <= 200
    assert found == {i for i, _, m, pad in rows if not cited(m, pad)}


def test_filler_phrases(spark):
    texts = {"It is important to note the date.": 23, "It's important to note that x": 27, "Its important to note the x": None, "its worth noting": 16, "It is worth noting": 18, "It is important to note that": 23, "Needless to say": 15}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.length for r in detect(docs, only=("filler-phrase",)).collect()}
    assert got == {i: n for i, n in enumerate(texts.values()) if n}


def test_one_report_of_a_project(spark):
    files = spark.createDataFrame([
        ("README.md", "# R\n\n[gone](no.md) [gone too](no2.md)\n"), ("LICENSE", "MIT"), ("CONTRIBUTING.md", "TODO"), ("z.md", "# Z\n\nWe utilize it. [lost](nope.md)\n"), ("page.html", '<a href="#x">x</a>\n'), ("POSTMORTEM.md", "# P\n\nIt was human error.\n"),
    ], "path string, text string")
    found = report.project(files, anchors=True, prose=True, only=("complex-word",))
    rules = {(r.rule_id, r.path, r.target) for r in found.collect()}
    assert {("link-broken", "README.md", "no.md"), ("link-broken", "z.md", "nope.md"), ("community-invalid-file", "CONTRIBUTING.md", None), ("community-missing-file", "SECURITY.md", None), ("anchor-broken", "page.html", "x"), ("postmortem-blame", "POSTMORTEM.md", "human error"), ("complex-word", "z.md", "utilize")} <= rules
    first = report.project(files, {"detector": {"ignoreRules": ["community-missing-file", "asset-missing-section", "postmortem-blame"]}}, limit=3)
    assert {(r.rule_id, r.path) for r in first.collect()} == {("link-broken", "README.md"), ("community-invalid-file", "CONTRIBUTING.md")}
    lines = [r.text for r in report.project_lines(first).orderBy("n").collect()]
    assert lines[:4] == ["error community-invalid-file CONTRIBUTING.md", "  community-health file has no content of its own: CONTRIBUTING.md", "error link-broken README.md -> no.md", "  linked file is missing"]
    none = first.limit(0)
    assert report.project_exit(first) == 1 and report.project_exit(none, strict=True) == 0 and report.project_exit(first.withColumn("severity", F.lit("warn"))) == 0 and report.project_exit(first.withColumn("severity", F.lit("warn")), strict=True) == 1
    assert [r.text for r in report.project_lines(none).collect()] == ["check: ok"]


def test_audit_by_path(spark):
    files = spark.createDataFrame([("b.md", "We utilize it."), ("a.md", "Fine.\n\nWe utilize it. Some say so.")], "path string, text string")
    made = report.check(files, only=("complex-word", "vague-attribution"))
    assert sorted((r.path, r.bad, r.good) for r in audit(made.findings).collect()) == [("a.md", "Some say", None), ("a.md", "utilize", "use"), ("b.md", "utilize", "use")]
    lines = [(r.path, r.text) for r in audit_lines(made.findings).orderBy("path", "n").collect()]
    assert [t for p, t in lines if p == "a.md"] == ["== a.md ==", "", "  [ai-slop]", "  3:16 warn vague-attribution — vague attribution — name the source or remove the claim", "      bad:  Some say", "", "  [clarity]", "  3:4 advisory complex-word — complex word — use 'use'", "      bad:  utilize", "      good: use", ""]
    assert [r.text for r in audit_lines(made.findings.limit(0)).collect()] == ["✓ clean — no findings"]


def test_discovery_and_templates(spark):
    tree = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(project.discovered(tree("src/a.rs", "SPEC.md", "Cargo.toml"))) == ["code-docs", "rust-manifest"] and names(project.discovered(tree("src/a.rs", "x/docs/y.md"))) == [] and names(project.discovered(tree("docs/a.md", "src/b.py"))) == ["code-docs"] and names(project.discovered(tree().limit(0))) == []
    assert project.scaffold("adr", "One", "# {{title}}\n") == ("ADR.md", "# One\n") and project.scaffold("adr")[1].startswith("# Adr\n\n## Status\n")
    got = project.templated(spark.createDataFrame([("adr", "# {{title}} {{title}}")], "archetype string, text string"), spark.createDataFrame([("adr", "X"), ("rfc", "Y")], "archetype string, title string"))
    assert [tuple(r) for r in got.collect()] == [("adr", "X", "# X X")]


def test_questions_that_a_score_raises(spark):
    from prosemill.operators.narrative import QUESTIONS, asked, narrative

    docs = spark.createDataFrame([(1, "The lesson is clear. Various things."), (2, None), (3, "plain")], "doc_id long, text string")
    scores = narrative(docs)
    got = sorted((r.doc_id, r.question, r.score) for r in asked(scores).collect())
    assert got == [(1, "stated-morals", 1), (1, "vague-allusion", 2)] and len(QUESTIONS) == 7
    assert [r.question for r in asked(scores, "docs").collect()] == ["stated-morals", "vague-allusion"]


def test_navigation_by_folder(spark):
    files = spark.createDataFrame([("mkdocs.yml", "nav:\n - a.md\n - gone.md\n"), ("docs/a.md", ""), ("docs/b.md", ""), ("sub/mkdocs.yml", "nav:\n - c.md\n - a.md"), ("sub/docs/c.md", ""), ("sub/d.md", "")], "path string, text string")
    got = {(r.rule_id, r.path, r.target) for r in project.check_navigation(files).collect()}
    assert got == {("nav-missing-target", "mkdocs.yml", "gone.md"), ("nav-orphan-page", "docs/b.md", "mkdocs.yml"), ("nav-orphan-page", "sub/docs/c.md", "mkdocs.yml"), ("nav-orphan-page", "sub/d.md", "mkdocs.yml"), ("nav-missing-target", "sub/mkdocs.yml", "a.md"), ("nav-orphan-page", "sub/d.md", "sub/mkdocs.yml")}
