import pytest

import __spark_entry__ as entry
from prosemill.functions.lists import LISTS
from prosemill.functions.patterns import entries_of
from prosemill.operators import filters, project, score
from prosemill.operators.context import context_of
from prosemill.operators.detect import detect
from prosemill.operators.rules import catalogue
from prosemill.plans import config
from prosemill.plans.projects import FIXED
from prosemill.plans.projects import SQL as PROJECT_SQL
from prosemill.sources import code_strings, edited_paths, line_units, text_files
from prosemill.sources.sinks import exit_code, json_documents
from pyspark.sql import functions as F
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def test_registry():
    assert len(LISTS) == 49 and len({r.id for r in catalogue()}) > 130
    assert entries_of("complex-word", {"complex-word": []}) == () and entries_of("complex-word", {"complex-word": "x"}) == LISTS["complex-word"].entries


@pytest.mark.parametrize("name", ["plain_rules_style", "plain_rules_google", "op_lines", "op_tokens", "op_mask", "rule_cases", "text_filters", "narrative_questions"])
def test_sql_says_the_same(spark, name):
    got, want = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert got == want


CASES = [
    ("em-dash-overuse", "A — b — c — d.", "A — b."), ("smart-quotes", "“a” ‘b’", "“a”"), ("repeated-word", "It is is so.", "I know that that had had."), ("long-sentence", "word " * 31 + ".", "word " * 30 + "."),
    ("indefinite-article", "An user and a hour.", "A user and an hour."), ("passive-voice", "It was built by us.", "It was even then."), ("violent-tech-metaphor", "Then kill it.", "Then kill -9 it."), ("bare-url", "See https://x.org now.", "See (https://x.org) now."),
    ("skipped-heading", "# A\n\n### B", "# A\n\n## B"), ("duplicate-heading", "# A\n\n## b\n\n## B", "# A\n\n## B"), ("fenced-code-language", "```\nx\n```", "```py\nx\n```"), ("missing-alt-text", "![](a.png)", "![x](a.png)"),
    ("undefined-acronym", "The QXZ works.", "A thing (QXZ) works. The QXZ works."), ("large-number-grouping", "Send 12345 now.", "Send 1234 now."), ("microsoft-ampm", "At 5 pm.", "At 5 PM"), ("unused-named-ref", "[a]: https://x.org", "[t][a]\n\n[a]: https://x.org"),
    ("complex-word", "We utilize it.", "`utilize` <b title='utilize'>x</b>\n```\nutilize\n```"), ("tricolon-overuse", "a, b, and c. d, e, and f. g, h, and i.", "a, b, and c."), ("acronym-case", "The TLA and tla.", "The TLA."),
]


def test_rules_fire_and_stay_quiet(spark):
    docs = spark.createDataFrame([(2 * i + k, case[1 + k]) for i, case in enumerate(CASES) for k in (0, 1)] + [(-1, None), (-2, "")], "doc_id long, text string")
    found = detect(docs, only=tuple(c[0] for c in CASES)).collect()
    hit = {(r.doc_id, r.rule_id) for r in found}
    assert [c[0] for i, c in enumerate(CASES) if (2 * i, c[0]) not in hit] == []
    assert [c[0] for i, c in enumerate(CASES) if (2 * i + 1, c[0]) in hit] == []
    assert not [r for r in found if r.doc_id < 0]
    texts = {2 * i + k: case[1 + k].encode() for i, case in enumerate(CASES) for k in (0, 1)}
    for r in found:
        if r.rule_id in ("complex-word", "large-number-grouping", "bare-url", "undefined-acronym"):
            assert texts[r.doc_id][r.offset : r.offset + r.length].decode() == r.span
    assert exit_code(spark.createDataFrame([(r.severity,) for r in found], "severity string"), strict=True) == 1
    assert json_documents(spark.createDataFrame(found)).count() == len({r.doc_id for r in found})


def test_overrides_zero_tolerance_and_waivers(spark):
    docs = spark.createDataFrame([(1, "One; two. Foo bar."), (2, "Foo\nbar foo")], "doc_id long, text string")
    rows = detect(docs, only=("complex-word", "semicolon-overuse"), zero=("semicolon-overuse",), overrides={"complex-word": [["foo", "baz"]]})
    got = sorted((r.doc_id, r.rule_id, r.severity, r.offset, r.message) for r in rows.collect())
    assert got == [(1, "complex-word", "advisory", 10, "complex word — use 'baz'"), (1, "semicolon-overuse", "warn", 3, "1 semicolons (250.0/1k words) — AI leans on them"), (2, "complex-word", "advisory", 0, "complex word — use 'baz'"), (2, "complex-word", "advisory", 8, "complex word — use 'baz'")]
    placed = score.located(rows, docs)
    assert {(r.line, r.col) for r in placed.where("doc_id = 2").collect()} == {(1, 1), (2, 5)}
    left = score.waive(placed, values=spark.createDataFrame([("complex-word", "Foo")], "rule_id string, span string"), spans=spark.createDataFrame([(2, 3, 2)], "doc_id long, lo int, hi int"))
    assert [r.rule_id for r in left.collect()] == ["semicolon-overuse"]
    scored = {r.doc_id: r for r in score.slop_score(docs, rows).collect()}
    assert scored[2].finding_count == 2 and scored[1].band in ("moderate", "heavy")


def test_masking_keeps_bytes_and_lines():
    text = "---\na: é\n---\n# Tïtle\n\n`é` <!-- x\ny --> {{ z }} <b>w</b>\n~~~\nç\n```\n~~~\nend"
    masked, holed = (context_of(text)[k] for k in ("masked", "holed"))
    assert len(masked.encode()) == len(text.encode()) == len(holed.encode()) and masked.count("\n") == text.count("\n")
    assert masked.split() == ["#", "Tïtle", "w", "end"]


def test_sentences_spare_abbreviations():
    sentences = context_of("Dr. Smith met e.g. Ann at 3.5 km. Then he left! Ok")["sentences"]
    assert [s[2] for s in sentences] == [10, 3, 1]


def test_prefilter_drops_no_finding(spark):
    """Findings with and without the look at literals and runs are the same, on texts of all rules' words glued in every way."""
    import random

    from prosemill.operators import detect as d
    from prosemill.operators import rules as r
    from prosemill.plans.fixtures import TEXTS, MASKED
    from prosemill.plans.cases import CASES as ALL

    rng = random.Random(11)
    pieces = [w for t in TEXTS for w in t.split(" ")] + [m.strip("«»") for _, _, m, _ in ALL if len(m) < 60] + ["was an AI language model user", "casestudies show", "İt is", "ſtudies ſhow", "ISBN123", "x_not", "énot just a but", "URLs"]
    texts = [rng.choice(["", " ", "\n", ". "]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(250)] + TEXTS + [t for t, _ in MASKED] + ["He was an AI language model user.", "Casestudies show it."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for style in ("microsoft", "google", "plain"):
        rules = r.selected(style)
        ctx = d.context(docs, style)
        known = frozenset(r.literals_of(rules))
        plain = [x if x.id not in r.RUNS else x for x in rules]
        with_look = {tuple(x) for x in d.pattern_findings(ctx, rules, (), known).collect()}
        saved, r.RUNS = r.RUNS, {}
        try:
            without = {tuple(x) for x in d.pattern_findings(ctx, plain, (), frozenset()).collect()}
        finally:
            r.RUNS = saved
        assert with_look == without and len(without) > 100
        if style == "microsoft":
            assert {x[1] for x in with_look if x[0][1] == len(texts) - 2} >= {"assistant-meta"} and {x[1] for x in with_look if x[0][1] == len(texts) - 1} >= {"vague-attribution"}


def test_syllables_of_a_text_are_those_of_its_words(spark):
    import random

    from prosemill.functions import readability

    rng = random.Random(3)
    parts = ["a", "e", "i", "o", "u", "y", "b", "c", "l", "es", "ed", "le", "ia", "the", "every", "queue", "é", "-", "'", "1", "t"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(3000)] + list(readability.EXCEPTIONS) * 3 + ["freed", "does", "y", "rhythm", "Table"]
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 30]) for i in range(0, len(words), 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = {r.i: r.n for r in df.select("i", readability.syllables_of_text(F.col("t")).alias("n")).collect()}
    each = {r.i: r.n for r in df.select("i", F.explode(F.split("t", " ")).alias("w")).groupBy("i").agg(F.sum(readability.syllables(F.col("w"))).alias("n")).collect()}
    assert whole == each


def test_counts_over_bytes_are_those_of_expressions(spark):
    """words, letters and syllables of many texts at once, as the expressions count them one by one; white space and letters of every script."""
    import random

    from prosemill.functions import readability

    rng = random.Random(4)
    parts = ["a", "e", "i", "o", "u", "y", "Y", "b", "C", "l", "es", "ed", "le", "ia", "eo", "the", "Every", "queue", "being", "é", "ß", "—", "-", "'", "1", ".", "K", "İ", "\x1c", "😀", " ", " ", " ", "\u212a", "\n", "\t", "\x85", "\xa0", "\u2003", "\u3000", "\u2028", "\x00"]
    texts = ["", " ", "y", "e", "the", "\u212aia", "İdle ed"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(1500)] + [w for w in readability.EXCEPTIONS]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", F.regexp_count("t", F.lit(r"(?U)\S+")).alias("w"), F.regexp_count("t", F.lit("[A-Za-z0-9]")).alias("l"), readability.syllables_of_text(F.col("t")).alias("s")).orderBy("i").collect()
    assert [tuple(map(int, x)) for x in zip(*readability.counts_of_texts(texts))] == [(r.w, r.l, r.s) for r in rows]
    assert [len(x) for x in readability.counts_of_texts([])] == [0, 0, 0]


def test_context_holds_what_rules_read(spark, tmp_path):
    """columns that the plans of the rules scan are among those that a context for these rules is asked for, and no others are made."""
    from prosemill.operators import detect as d
    from prosemill.operators import rules as r
    from prosemill.operators.context import GRADED, SCHEMA

    spark.createDataFrame([], f"doc_id struct<row:long,id:long>, {SCHEMA}").write.parquet(str(tmp_path / "c"))
    ctx = spark.read.parquet(str(tmp_path / "c"))

    def scanned(df):
        leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
        return {n for i in range(leaves.size()) for n in leaves.apply(i).requiredSchema().fieldNames()} - {"doc_id"}

    seen = set()
    for style in r.PACKS:
        known = frozenset(r.literals_of(r.selected(style)))
        for rule, plan in d.structural_findings(ctx, style, known=known) if style in ("microsoft", "google", "plain") else []:
            if style == "microsoft" or d.OWN.get(rule) == style:
                assert scanned(plan) <= set(d.READS[rule].split()) and set(d.READS[rule].split()) <= scanned(plan) | {"words"}, rule
                seen.add(rule)
        one = {(x.on, frozenset(d.reads([x], set(), known))): x for x in r.selected(style)}
        assert all(scanned(d.pattern_findings(ctx, [x], (), known)) <= names for (_, names), x in one.items())
    assert seen == d.STRUCTURAL
    plain = [x for x in r.selected("plain") if x.pack == "plain"]
    assert d.reads(plain, {"plain-long-sentence", "reading-grade"}, frozenset(r.literals_of(plain, lists=False))) == {"masked", "words", "present", "long_sentences", *GRADED}


def test_rules_alone_find_what_they_find_among_all(spark):
    from prosemill.plans.fixtures import TEXTS
    from prosemill.plans.queries import PACK_STRUCTURAL, family_of

    texts = [*TEXTS, " ".join(TEXTS), "This institution shall terminate unnecessary organizational responsibilities " * 5 + ".", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.id for r in family_of("plain")["plain"]} | set(PACK_STRUCTURAL["plain"])
    alone, all_ = ({tuple(x) for x in df.collect()} for df in (detect(docs, "plain", only=tuple(ids)), detect(docs, "plain").where(F.col("rule_id").isin(*ids))))
    assert alone == all_ and {x[1] for x in alone} >= {"reading-grade", "plain-shall", "plain-double-negative"}


def test_a_line_of_many_sentences_is_held_once():
    """what stands before a sentence in its line isn't held again for each sentence, but for a list's number."""
    sentences = context_of("Here is one more. " * 2000 + "\n\n12. Ends here. 3 left.\n\n 7) 8 more")["sentences"]
    assert len(sentences) == 2004 and sum(len(s[4]) for s in sentences) < 20
    assert [s[4] for s in sentences[2000:]] == ["12.", "12. ", "", " 7) "]


def test_long_sentences_are_those_of_all():
    text = "# Head\n\n" + "".join("word " * n + "end. " for n in (19, 20, 29, 30, 0)) + "\n\n1. " + "é " * 3 + "x " * 21 + "!\n- " + "y " * 40
    out = context_of(text)
    assert out["long_sentences"] == [s[:4] for s in out["sentences"] if s[2] > 20] and [s[2] for s in out["long_sentences"]] == [21, 30, 31, 21, 40]
    assert out["grade_sentences"] == len(out["sentences"])


def test_a_row_group_is_dealt_to_all_cores(spark, tmp_path):
    """a file of one row group is read by one task, in how many parts its bytes may come."""
    from prosemill.operators.storage import spread

    spark.range(20_000).selectExpr("id AS doc_id", "sha2(string(id), 512) || sha2(string(-id), 512) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        rows = lambda x: [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
        assert df.rdd.getNumPartitions() >= 4 and len(rows(df)) == 1
        even = spread(df)
        assert sum(rows(even)) == 20_000 and max(rows(even)) * 4 <= 1.5 * 20_000 and even.exceptAll(df).isEmpty()
        assert spread(even) is even and spread(df.where("doc_id < 0")).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_filters_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("docs/a.fr.md", "x"), ("CHANGELOG.md", "x"), ("a.md", "漢" * 100), ("b.md", "x" * 3000), ("c.md", "!!"), ("d.md", "fine text")], "path string, text string")
    assert [r[0] for r in df.select(filters.skip_reason(F.col("path"), F.col("text"))).collect()] == ["translation", "generated file", "mostly non-Latin text", "data, not prose", "no prose content", None]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("one\n\ntwo")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.md").write_text("no")
    files = text_files(spark, str(tmp_path))
    assert [(r.path, r.text) for r in files.collect()] == [("sub/a.md", "one\n\ntwo")] and line_units(files).count() == 2
    code = spark.createDataFrame([("a.tsx", '<p title="Not shown here">Hello big world</p>\nconst x = "Save all your files"; const c = "abc";'), ("a.test.ts", '"Hello big world"')], "path string, text string")
    assert sorted(r.text for r in code_strings(code).collect()) == ["Hello big world", "Not shown here", "Save all your files"]
    events = spark.createDataFrame([('{"tool_input": {"file_path": "a.md"}}',), ('{"x": [{"uri": "file:///b.md"}]}',), ("no",)], "value string")
    assert sorted(r.path for r in edited_paths(events).collect()) == ["/b.md", "a.md"]


@pytest.mark.parametrize("name", [*PROJECT_SQL, "check_anchors"])
def test_project_sql_says_the_same(spark, name):
    got, want = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert got == want and got


def test_project_checks(spark):
    files = spark.createDataFrame([*FIXED, ("POSTMORTEM.md", "# Incident\n\n## Summary\n\nIt was human error.\n\n## Impact\n")], "path string, text string")
    assert sorted((r.target, r.message) for r in project.check_links(files).collect()) == [("docs/gone.md", "linked file is missing"), ("docs/setup.md#nowhere", "linked anchor is missing")]
    assert sorted(r.target for r in project.check_navigation(files).where("severity = 'error'").collect()) == ["missing.md", "p1/1.md"]
    rules = spark.createDataFrame([("docs", ["docs/**", "*.{py,rs}"], ["**/skip.md"], "tell")], "name string, paths array<string>, exclude array<string>, message string")
    edits = spark.createDataFrame([("docs/a.md",), ("docs/skip.md",), ("src/app.py",), ("x.txt",)], "path string")
    assert sorted(r.path for r in project.notified(edits, rules).collect()) == ["docs/a.md", "src/app.py"]
    spans = project.symbol_span(files, spark.createDataFrame([("POSTMORTEM.md", "Summary")], "path string, symbol string")).collect()
    assert [(r.start_line, r.end_line) for r in spans] == [(3, 6)]


def test_report_from_files_and_configuration(spark, tmp_path):
    from prosemill.plans import report

    files = spark.createDataFrame([("a.md", "We utilize it.\n\nWe utilize é utilize."), ("b.md", "We utilize it."), ("skip/c.md", "We utilize it."), ("d.md", "Fine."), ("e.md", None)], "path string, text string")
    layer = {"detector": {"ignoreFiles": ["skip/*"], "ignoreSpans": {"a.md": [[1, 1]]}, "ignoreRules": ["avoid-we"]}}
    made = report.check(files, layer, only=("complex-word",))
    assert sorted((r.path, r.line, r.col) for r in made.findings.collect()) == [("a.md", 3, 4), ("a.md", 3, 14), ("b.md", 1, 4)]
    lines = [(r.path, r.text) for r in report.text_lines(made).orderBy(F.col("path").asc_nulls_last(), "n").collect()]
    assert lines == [("a.md", "a.md"), ("a.md", "  3:4 advisory complex-word — complex word — use 'use'  [utilize]"), ("a.md", "  3:14 advisory complex-word — complex word — use 'use'  [utilize]"), ("a.md", ""), ("b.md", "b.md"), ("b.md", "  1:4 advisory complex-word — complex word — use 'use'  [utilize]"), ("b.md", ""), (None, "3 finding(s) in 2 file(s)")]
    import json

    rows = {r.path: json.loads(r.json) for r in report.json_lines(made).collect()}
    assert sorted(rows) == ["a.md", "b.md", "d.md", "e.md"] and [f["col"] for f in rows["a.md"]["findings"]] == [4, 14] and rows["d.md"]["findings"] == [] and rows["b.md"]["score"]["findingCount"] == 1
    assert json.loads(report.summary_json(made).first().json) == {"files": 4, "findings": 3, "errors": 0, "warns": 0, "advisories": 3}
    assert report.score_lines(made).where("path = 'd.md'").first().text == "d.md: slop score 0 (clean) — 0 findings / 1 words, density 0.0/1k, discount 0.0"
    none = report.check(files.limit(0), layer, only=("complex-word",))
    assert [r.text for r in report.text_lines(none).collect()] == ["✓ clean — no findings"]
    waived = report.check(files, layer, {"detector": {"ignoreValues": {"complex-word": ["utilize"]}}}, only=("complex-word",))
    assert waived.findings.count() == 0
    got = report.units(line_units(files.where("path = 'a.md'")), only=("complex-word",))
    assert sorted((r.path, r.line, r.col) for r in got.collect()) == [("a.md", 1, 4), ("a.md", 3, 4), ("a.md", 3, 14)]


def test_links_assets_spans_and_nudges(spark):
    files = spark.createDataFrame([
        ("a.md", "# A\n\n[x][one] and [two] and [three][] in `[no](no.md)`\n\n```\n[no](no2.md)\n```\n\n[one]: b.md\n[Two]: gone.md\n[three]: <c.md>\n"), ("b.md", "# B"), ("c.md", "# C"), ("ops/old-runbook.md", "# x"), ("notes/x.md", "# Incident Review\n"), ("y.md", "# P\n\n## Mine\n\n## Yours\n"),
        ("m.py", "class A:\n    pass\n\ndef b():\n    pass\n"), ("m.fr.md", "x"), ("m.md", "x"),
    ], "path string, text string")
    assert sorted((r.path, r.target) for r in project.links(files).collect()) == [("a.md", "b.md"), ("a.md", "c.md"), ("a.md", "gone.md")]
    own = spark.createDataFrame([("adr", "Mine"), ("adr", "Yours")], "archetype string, section string")
    assert sorted((r.path, r.archetype) for r in project.asset_types(files, own).collect()) == [("notes/x.md", "postmortem"), ("ops/old-runbook.md", "runbook"), ("y.md", "adr")]
    spans = project.symbol_span(files, spark.createDataFrame([("m.py", "A"), ("m.py", "b")], "path string, symbol string")).collect()
    assert sorted((r.symbol, r.start_line, r.end_line) for r in spans) == [("A", 1, 3), ("b", 4, 5)]  # what follows the last line feed is no line
    timed = files.withColumn("modified", F.when(F.col("path") == "m.md", F.lit("2024-02-01")).otherwise(F.lit("2024-01-01")).cast("timestamp"))
    assert [(r.source, r.lang, r.layout, r.stale, r.ok) for r in project.localization(timed).collect()] == [("m.md", "fr", "suffix", True, False)]
    nudges = spark.createDataFrame([("n", "*.py", ["skip*"], ["README.md"], "say why")], "name string, file string, exclude array<string>, edit array<string>, message string")
    edits = spark.createDataFrame([("m.py",), ("skip.py",), ("m.md",)], "path string")
    assert [(r.path, r.text) for r in project.nudged(edits, nudges).collect()] == [("m.py", "m.py changed — edit README.md — say why")]


def test_terms_and_templates(spark):
    once = project.with_term("# Style\n", "sign in", ("log in", "login"))
    twice = project.with_term(once + "\n## Next\n\ntext\n", "email", ("e-mail",))
    rows = project.glossary(spark.createDataFrame([("STYLE.md", twice)], "path string, text string")).collect()
    assert sorted((r.use, r.variant) for r in rows) == [("email", "e-mail"), ("sign in", "log in"), ("sign in", "login")] and twice.endswith("## Next\n\ntext\n")
    own = project.template_sections(spark.createDataFrame([("templates/adr.md", "# T\n\n## Mine\n\n## Yours\n"), ("x/adr.md", "## No")], "path string, text string"))
    assert sorted(map(tuple, own.collect())) == [("adr", "Mine"), ("adr", "Yours")]


def test_config_is_written_and_lists_change(tmp_path):
    c = config.with_item(config.with_item({}, "detector.ignoreRules", "a"), "detector.ignoreRules", "a")
    config.write(tmp_path / "x" / "c.json", c)
    assert config.read(tmp_path / "x" / "c.json") == {"detector": {"ignoreRules": ["a"]}} and config.without_item({"rules": [{"name": "n"}, {"name": "m"}]}, "rules", "n") == {"rules": [{"name": "m"}]}


def test_config_layers():
    c = config.layers({"detector": {"styleGuide": "google", "lists": {"a": ["b"]}}, "extra": {"x": 1}}, {"extra": None, "hook": {"maxFindings": 5}})
    assert c["detector"]["styleGuide"] == "google" and c["hook"] == {"maxFindings": 5, "grammar": False, "quiet": False} and "extra" not in c
    assert config.coerced("on", False) is True and config.coerced("7", 20) == 7 and config.get(config.put(c, "a.b", 1), "a.b") == 1 and config.read("/nowhere") == {}


def test_stream_equals_batch(spark, tmp_path):
    from prosemill.streaming import detect_stream

    docs = spark.createDataFrame([(1, "We utilize it."), (2, "Fine.")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    rows = []
    query = detect_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), lambda df, n: rows.extend(df.collect()), str(tmp_path / "cp"), only=("complex-word",))
    query.awaitTermination(120)
    assert [(r.doc_id, r.rule_id) for r in rows] == [(r.doc_id, r.rule_id) for r in detect(docs, only=("complex-word",)).collect()]
