"""Detection: pattern rules scanned together, structural rules over the context's arrays, waivers and order.

One Arrow pass makes the context, one projection runs all regular expressions, and what follows moves hits, not texts: the window
that adds up offsets is over (document, rule) with the lengths of the parts between hits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prosemill.functions.patterns import NOCASE, entries_of, keys_of, phrases, quoted
from prosemill.functions.readability import with_grade
from prosemill.operators import rules as R
from prosemill.operators.context import COLUMNS, GRADED, SCHEMA, WORD, with_context
from prosemill.operators.storage import materialized, spread

FINDING = ["doc_id", "rule_id", "family", "severity", "offset", "length", "span", "message"]
#: What structural rules read of a context, and the rules that one style alone has.
READS = {
    "bold-lead-in-list": "items", "excessive-bold": "bolds words", "listicle-reflex": "items", "emphasis-as-heading": "lines", "emoji-decoration": "lines", "uniform-cadence": "sentences", "overused-word": "masked words present", "long-sentence": "sentences",
    "repeated-word": "masked words", "undefined-acronym": "masked words", "sentence-case-heading": "headings", "heading-end-punctuation": "headings", "terminology-consistency": "masked words present", "acronym-case": "shouted", "fenced-code-language": "fences",
    "duplicate-heading": "headings", "inconsistent-capitalization": "titled", "thematic-break-before-heading": "breaks", "bullet-overuse": "items lines", "tracking-param-in-citation": "links", "unused-named-ref": "refs", "vague-link-text": "links", "skipped-heading": "headings",
    "tech-historical-terms": "masked words present", "missing-alt-text": "links", "bare-url": "masked words present refs", "no-numeral-sentence-start": "sentences", "microsoft-heading-acronyms": "headings", "microsoft-heading-colons": "headings", "no-gerund-heading": "headings",
    "no-link-in-heading": "headings", "plain-long-sentence": "long_sentences", "reading-grade": "masked " + " ".join(GRADED),
}
STRUCTURAL = set(READS)
OWN = {"no-numeral-sentence-start": "microsoft", "microsoft-heading-acronyms": "microsoft", "microsoft-heading-colons": "microsoft", "no-gerund-heading": "google", "no-link-in-heading": "google", "plain-long-sentence": "plain", "reading-grade": "plain"}


def shown(text: Column) -> Column:
    """A span as findings show it: white space collapsed, 80 characters at most."""
    return F.left(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(80))


def scan(ctx: DataFrame, patterns: list[tuple[str, str]], possible: list[str] | None = None) -> DataFrame:
    """(doc_id, words, k, i, offset, match, n): every match of the patterns (column, regex), k being the pattern's place; n counts a
    document's matches of a pattern. ``possible`` are SQL conditions without which a pattern isn't tried."""
    if not patterns:
        return ctx.sparkSession.createDataFrame([], f"doc_id {ctx.schema['doc_id'].dataType.simpleString()}, words int, k int, i int, offset int, match string, n long")

    def ascii_only(pattern: str) -> str:
        return re.sub(r"^\(\?([a-zU]+)\)", lambda m: f"(?{m[1].replace('U', '')})", pattern) if pattern.isascii() else pattern

    def hits_of(on: str, pattern: str) -> str:
        """On ASCII texts the ASCII classes mean the same, and the JVM finds them several times faster."""
        wide, narrow = (f"regexp_extract_all({on}, {R.sql_text(p)}, 0)" for p in (pattern, ascii_only(pattern)))
        return wide if narrow == wide else f"if(plain, {narrow}, {wide})"

    columns = sorted({on for on, _ in patterns})
    if "octets" in columns:  # a character a byte, so that a pattern's window counts bytes; its matches are ASCII
        ctx = ctx.withColumn("octets", F.decode(F.encode("masked", "UTF-8"), "ISO-8859-1"))
    ctx = ctx.withColumn("plain", F.length("masked") == F.octet_length("masked"))
    parts = []
    for k, (on, pattern) in enumerate(patterns):
        hits = f"named_struct('k', {k}, 'hits', {hits_of(on, pattern)})"
        parts.append(f"if({possible[k]}, {hits}, null)" if possible and possible[k] != "true" else hits)
    # Texts that can't have a match aren't searched, and only those that have one are split.
    # The array stands inside the generator: as a column of its own, filters inferred from it would compute it again.
    found = ctx.select("doc_id", "words", "plain", *columns, F.expr(f"explode(filter(array_compact(array({', '.join(parts)})), p -> size(p.hits) > 0))").alias("p"))
    # The pattern of a split is looked up by the rule's place: it is compiled for each text anyway, and the plan stays small.
    said = F.from_json(F.lit(json.dumps([[on, ascii_only(pattern), pattern] for on, pattern in patterns])), "array<array<string>>")
    mine = F.element_at(said, F.col("p.k") + 1)
    pattern = F.when(F.col("plain"), mine[1]).otherwise(mine[2])
    text = reduce(lambda rest, name: F.when(mine[0] == name, F.col(name)).otherwise(rest), columns[1:], F.col(columns[0]))
    gaps = F.split(text, pattern, -1)
    rows = found.select("doc_id", "words", "p.k", F.size("p.hits").cast("long").alias("n"), F.posexplode(F.arrays_zip(F.col("p.hits").alias("match"), F.transform(gaps, lambda x: F.when(mine[0] == "octets", F.length(x)).otherwise(F.octet_length(x))).alias("gap"))).alias("i", "z"))
    rows = rows.where("z.match is not null").select("doc_id", "words", "k", "n", "i", "z.match", "z.gap")
    by = W.partitionBy("doc_id", "k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    offset = (F.sum(F.col("gap") + F.octet_length("match")).over(by) - F.octet_length("match")).cast("int")
    return rows.withColumn("offset", offset).select("doc_id", "words", "k", "i", "offset", "match", "n")


def pattern_findings(ctx: DataFrame, rules: list[R.Rule], zero: tuple[str, ...] = (), known: frozenset = frozenset()) -> DataFrame:
    """Findings of the pattern rules; ``known`` are the literals that the context was asked for."""
    hits = scan(ctx, [(r.on, r.pattern) for r in rules], [R.possible(r, known) for r in rules])
    match, n, words = F.col("match"), F.col("n"), F.greatest(F.col("words"), F.lit(1))
    keep, severity = [], F.lit(None).cast("string")
    for k, r in enumerate(rules):
        here, lifted = F.col("k") == k, r.zero and r.id in zero
        conditions = ([] if lifted or r.gate is None else [r.gate(n, words)]) + ([F.col("i") == 0] if r.first and not lifted else [])
        if conditions:
            keep.append(F.when(here, reduce(lambda a, b: a & b, conditions)))
        if r.warn_if is not None:
            severity = F.when(here & r.warn_if(match, n, words), F.lit("warn")).otherwise(severity)
    if keep:
        hits = hits.where(F.coalesce(*keep, F.lit(True)))
    # What is fixed for a rule stands in one constant, by the rule's place.
    fixed = [{"rule_id": r.id, "family": r.family, "severity": "warn" if r.zero and r.id in zero else r.severity, "message": r.message, "head": r.head, "to": r.mapping} for r in rules]
    table = F.from_json(F.lit(json.dumps(fixed)), "array<struct<rule_id:string,family:string,severity:string,message:string,head:boolean,to:map<string,string>>>")
    hits = hits.withColumn("r", F.element_at(table, F.col("k") + 1)).withColumn("to", F.try_element_at("r.to", F.lower(match)))
    # A match that is its replacement already, letter for letter, needs no finding.
    hits = hits.where((F.size("r.to") == 0) | (F.col("to") != match))
    # Some expressions match more than the finding: that is the head of the match, and its last word is the message's {w}.
    hits = hits.withColumn("last", F.lower(F.regexp_extract(match, "([A-Za-z-]+)$", 1))).withColumn("match", F.when(F.col("r.head"), F.regexp_extract(match, "^[A-Za-z]+", 0)).otherwise(match))
    text = F.col("r.message")
    values = {"{to}": F.coalesce("to", F.lit("")), "{m}": match, "{w}": F.col("last"), "{n}": n.cast("string"), "{rate}": F.format_string("%.1f", n * 1000.0 / words), "{grouped}": F.regexp_replace(match, r"(?<=\d)(?=(?:\d{3})+$)", ","), "{cp}": F.lpad(F.hex(F.ascii(match)), 4, "0")}
    for mark, value in values.items():
        text = F.when(F.contains(F.col("r.message"), F.lit(mark)), F.replace(text, F.lit(mark), value)).otherwise(text) if mark != "{to}" else F.replace(text, F.lit(mark), value)
    return hits.select("doc_id", "r.rule_id", "r.family", F.coalesce(severity, F.col("r.severity")).alias("severity"), "offset", F.octet_length("match").alias("length"), shown(match).alias("span"), text.alias("message"))


def _table(mapping: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")


def _out(df: DataFrame, rule: str, family: str, severity, offset, length, span, message) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("doc_id", F.lit(rule).alias("rule_id"), F.lit(family).alias("family"), lit(severity).alias("severity"), offset.cast("int").alias("offset"), length.cast("int").alias("length"), shown(span).alias("span"), lit(message).alias("message"))


def structural_findings(ctx: DataFrame, style: str = "microsoft", overrides: dict | None = None, glossary: tuple = (), grade_target: float = 8.0, wanted: Callable[[str], bool] = lambda rule: True, known: frozenset = frozenset()) -> list[tuple[str, DataFrame]]:
    """Plans of the wanted rules over headings, lists, links, lines, sentences and whole documents."""
    c, raw = F.col, F.octet_length
    heads = ctx.select("doc_id", F.posexplode("headings").alias("i", "h")).select("doc_id", "i", "h.*")
    links = ctx.select("doc_id", F.explode("links").alias("l")).select("doc_id", "l.*")
    bolds, items = c("bolds"), c("items")
    lines = ctx.select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*")
    sentences = ctx.select("doc_id", F.posexplode("sentences").alias("i", "s")).select("doc_id", "i", "s.*")
    in_doc = W.partitionBy("doc_id").orderBy("i")
    out = []

    def add(df, rule, family, severity, offset, length, span, message):
        if wanted(rule):
            out.append((rule, _out(df, rule, family, severity, offset, length, span, message)))

    # Weighted words: distinct bases and their weights over the document decide whether and how loudly all hits count.
    weighted = entries_of("overused-word", overrides)
    if weighted and wanted("overused-word"):
        base = _table({w.lower(): b for w, b, _ in weighted})
        weight = F.from_json(F.lit(json.dumps({w.lower(): v for w, _, v in weighted})), "map<string,double>")
        pattern = rf"{NOCASE}\b(?:{'|'.join(quoted(w) for w, _, _ in weighted)})\b"
        doc = W.partitionBy("doc_id")
        hits = scan(ctx, [("masked", pattern)], [R.present(R.folded_all([w for w, _, _ in weighted]), known)]).withColumns({"base": F.element_at(base, F.lower("match")), "weight": F.element_at(weight, F.lower("match")), "words": F.greatest("words", F.lit(1))})
        hits = hits.withColumns({"kinds": F.size(F.collect_set("base").over(doc)), "mass": F.sum("weight").over(doc) * 1000 / c("words"), "rate": c("n") * 1000 / c("words")}).where("kinds >= 2 or n >= 2 and rate >= 4")
        add(hits, "overused-word", "ai-slop", F.when((c("kinds") >= 3) | (c("mass") >= 20), F.lit("warn")).otherwise(F.lit("advisory")), c("offset"), raw("match"), c("match"), F.format_string("AI-overused word cluster — %.1f/1k, weighted %.1f", "rate", "mass"))
    # Lists.
    lead = r"(?U)^\s*(?:\*\*[^*]+\*\*|__[^_]+__)\s*[:—-]"
    shaped = ctx.select("doc_id", F.posexplode("items").alias("i", "t")).select("doc_id", "i", "t.*").where(c("text").rlike(lead))
    runs = shaped.withColumn("run", c("line") - F.row_number().over(in_doc)).groupBy("doc_id", "run").agg(F.count("*").alias("n"), F.min_by(F.struct("start", "text"), "line").alias("f")).where("n >= 3")
    add(runs, "bold-lead-in-list", "ai-slop", "warn", c("f.start"), F.lit(2), F.left("f.text", F.lit(2)), "AI listicle template — use real headings or plain bullets")
    per100 = F.size(bolds) * 100 / F.greatest(c("words"), F.lit(1))
    add(ctx.where((F.size("bolds") >= 4) & (per100 >= 3)), "excessive-bold", "ai-slop", "advisory", bolds[0]["start"], bolds[0]["length"], bolds[0]["text"], F.format_string("excessive bold emphasis — %d spans, %.1f/100 words", F.size("bolds"), per100))
    short = F.size(F.filter(items, lambda t: F.regexp_count(t["text"], F.lit(WORD)) <= 4))
    add(ctx.where((F.size("items") >= 5) & (short * 2 >= F.size("items"))), "listicle-reflex", "ai-slop", "advisory", items[0]["line_start"], F.lit(1), F.left(items[0]["raw"], F.lit(1)), "listicle reflex — expand or group short bullets")
    filled = F.size(F.filter("lines", lambda x: F.trim(x["text"]) != ""))
    add(ctx.where((F.size("items") >= 8) & (F.size("items") * 2 >= filled)), "bullet-overuse", "style", "advisory", items[0]["line_start"], raw(items[0]["raw"]), items[0]["raw"], "too much of the document is bullets")
    # Lines.
    add(lines.where(~c("table") & c("text").rlike(r"^[ \t]*(?:\*\*|__).{0,47}[^.:!?,;](?:\*\*|__)[ \t]*$")), "emphasis-as-heading", "ai-slop", "advisory", c("start"), raw("text"), c("text"), "bold line used as a heading — use a real heading")
    emoji = r"^[ \t]*(?:[-*+] |\d+[.)] )?[ \t]*([\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{1F000}-\x{1FAFF}])"
    deco = lines.where(c("text").rlike(emoji)).withColumns({"e": F.regexp_extract("text", emoji, 1)}).withColumn("at", c("start") + raw(F.expr("substring_index(text, e, 1)")))
    add(deco, "emoji-decoration", "ai-slop", "warn", c("at"), raw("e"), c("e"), "line-initial emoji decoration — an AI listicle tell")
    # Sentences.
    stats = sentences.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("words").alias("m"), (F.stddev_pop("words") / F.avg("words")).alias("cv"), F.min("start").alias("start")).where("n >= 6 and m >= 4 and cv < 0.25")
    add(stats, "uniform-cadence", "ai-slop", "advisory", c("start"), F.lit(0), F.lit(""), F.format_string("uniform sentence cadence (CV %.2f < 0.25 over %d sentences) — vary rhythm", "cv", "n"))
    add(sentences.where("words > 30"), "long-sentence", "clarity", "warn", c("start"), c("length"), c("text"), F.format_string("long sentence — %d words", "words"))
    # Tokens: equal neighbours without a sentence end between.
    twice = r"(?diU)(?<![A-Za-z0-9'’-])([A-Za-z0-9]++(?:['’-][A-Za-z0-9]++)*)[^.!?\nA-Za-z0-9]++(?=\1(?![A-Za-z0-9])(?!['’-][A-Za-z0-9]))"
    again = scan(ctx, [("masked", twice)]).withColumn("w", F.regexp_extract("match", r"^[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*", 0)).where("lower(w) not in ('that', 'had')")
    add(again, "repeated-word", "clarity", "warn", c("offset"), raw("match") + raw("w"), F.concat("match", "w"), "repeated word")
    caps = scan(ctx, [("masked", r"(?dU)\b[A-Z]{3,5}s?\b")]).withColumn("tok", F.regexp_replace("match", "s+$", "")).where(~c("tok").isin(*R.KNOWN_ACRONYMS.split()))
    first = caps.groupBy("doc_id", "tok").agg(F.min_by(F.struct("offset", "match"), "offset").alias("f"))
    first = first.join(ctx.select("doc_id", F.regexp_extract_all("masked", F.lit(r"([A-Z]{3,5})\)"), F.lit(1)).alias("defined")), "doc_id").where("not array_contains(defined, tok)")
    add(first, "undefined-acronym", "clarity", "advisory", c("f.offset"), raw("f.match"), c("f.match"), "undefined acronym — spell it out on first use")
    small = ctx.select("doc_id", F.explode("shouted").alias("s")).select("doc_id", "s.*").where(~c("low").isin(*R.CASELESS_ACRONYMS.split()))
    add(small, "acronym-case", "style", "advisory", c("start"), raw("low"), c("low"), F.concat(F.lit("inconsistent acronym case — use '"), c("word"), F.lit("'")))
    # Variants of a term: the second distinct one by first place.
    groups = [*entries_of("terminology-consistency", overrides), *glossary]
    if groups and wanted("terminology-consistency"):
        variants = scan(ctx, [("masked", rf"{NOCASE}(?<![A-Za-z0-9_])(?:{'|'.join(quoted(v) for v in sorted(g, key=lambda x: -len(x)))})(?![A-Za-z0-9_])") for g in groups], [R.present(R.folded_all(g), known) for g in groups])
        firsts = variants.groupBy("doc_id", "k", F.lower("match").alias("low")).agg(F.min_by(F.struct("offset", "match"), "offset").alias("f"))
        second = firsts.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "k").orderBy("f.offset"))).where("nth = 2")
        add(second, "terminology-consistency", "style", "advisory", c("f.offset"), raw("f.match"), c("f.match"), F.concat(F.lit("mixed terminology — choose one form, preferably '"), F.element_at(F.array(*[F.lit(g[0]) for g in groups]), c("k") + 1), F.lit("'")))
    title = ctx.select("doc_id", F.explode("titled").alias("t")).select("doc_id", "t.*")
    add(title, "inconsistent-capitalization", "style", "advisory", c("start"), raw("phrase"), c("phrase"), F.concat(F.lit("'"), c("phrase"), F.lit("' is also written lowercase elsewhere — pick one form")))
    # Headings.
    small_words = F.array(*[F.lit(w) for w in R.HEADING_SMALL.split()])
    lead_words = F.filter(F.split(F.regexp_extract("text", "^[^:—]*", 0), r"(?U)\s+"), lambda w: w != "")
    clean = lambda w: F.regexp_replace(w, r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    capped = F.filter(F.slice("ws", 2, F.size("ws")), lambda w: ~clean(w).rlike("^[A-Z]*$") & ~F.array_contains(small_words, F.lower(clean(w))) & clean(w).rlike("^[A-Z]"))
    case = heads.withColumn("ws", lead_words).where((F.size("ws") >= 3) & (F.size(capped) >= 2)).withColumn("all", F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    rewrite = F.array_join(F.concat(F.slice("all", 1, 1), F.transform(F.slice("all", 2, F.size("all")), lambda w: F.when(~w.rlike("[a-z]"), w).otherwise(F.lower(w)))), " ")
    add(case, "sentence-case-heading", "style", "advisory", c("start"), raw("text"), c("text"), F.concat(F.lit("heading should use sentence case — use '"), rewrite, F.lit("'")))
    add(heads.where(c("text").rlike("[.:!]$")), "heading-end-punctuation", "style", "warn", c("start"), raw("text"), c("text"), "heading ends with punctuation — remove it")
    dup = heads.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", F.lower(F.trim("text"))).orderBy("i"))).where("nth > 1")
    add(dup, "duplicate-heading", "style", "advisory", c("start"), raw("text"), c("text"), "duplicate heading text")
    levels = heads.withColumns({"before": F.lag("level").over(in_doc), "tops": F.sum((c("level") == 1).cast("int")).over(in_doc)})
    add(levels.where("level > before + 1"), "skipped-heading", "inclusive", "warn", c("start"), raw("text"), c("text"), F.format_string("heading skips from h%d to h%d — don't skip levels", "before", "level"))
    add(levels.where("level = 1 and tops >= 2"), "skipped-heading", "inclusive", "advisory", c("start"), raw("text"), c("text"), "second h1 — use a single top-level heading")
    fences = ctx.select("doc_id", F.explode("fences").alias("f")).select("doc_id", "f.*").where("info = ''")
    add(fences, "fenced-code-language", "style", "advisory", c("start"), F.lit(3), F.lit("```"), "code fence missing a language")
    breaks = ctx.select("doc_id", F.explode("breaks").alias("b")).select("doc_id", "b.*").where("heading_next")
    add(breaks, "thematic-break-before-heading", "style", "advisory", c("start"), c("length"), F.lit("---"), "thematic break before heading reads like scaffold — remove it")
    refs = ctx.select("doc_id", F.explode("refs").alias("r")).select("doc_id", "r.*").where("not used")
    add(refs, "unused-named-ref", "style", "advisory", c("start"), raw("id") + 2, F.concat(F.lit("["), c("id"), F.lit("]")), "unused named reference definition")
    # Links and images.
    track = r"(?i)[?&](?:utm_[A-Za-z0-9_]+|fbclid|gclid)="
    tracked = links.withColumns({"hit": F.regexp_extract("target", track, 0)}).where("hit <> '' and not image")
    add(tracked, "tracking-param-in-citation", "style", "warn", c("start") + c("length") - 1 - raw("target") + raw(F.expr("substring_index(target, hit, 1)")), raw("hit"), c("hit"), "tracking parameter in citation URL — remove it")
    vague = [v.lower() for v in keys_of("vague-link-text", overrides)]
    if vague:
        add(links.where(~c("image") & F.lower(F.trim("text")).isin(*vague)), "vague-link-text", "inclusive", "warn", c("start"), c("length"), c("text"), "vague link text — describe the destination (WCAG)")
    add(links.where(c("image") & (F.trim("text") == "")), "missing-alt-text", "inclusive", "warn", c("start"), c("length"), c("target"), "image has empty alt text — describe it for screen readers")
    urls = scan(ctx, [("masked", r"""(?dU)(?<![("'<=\]])https?://\S+""")], [R.present(("://",), known)]).join(ctx.select("doc_id", "refs"), "doc_id").where(~F.exists("refs", lambda r: (r["start"] <= c("offset")) & (c("offset") < r["start"] + r["length"])))
    add(urls, "bare-url", "inclusive", "advisory", c("offset"), raw("match"), c("match"), "bare URL in prose — use descriptive link text")
    # Advisory legacy terms, unless a warning covers them or their surroundings explain them.
    soft = entries_of("tech-inclusive-advisory", overrides)
    if soft and wanted("tech-historical-terms"):
        near = r"(?diU)(?<!master's.{0,6}|scrum .{0,6}|native .{0,6}|primitive .{0,6})(?!master's|master class|native speaker|native to|primitive type)"
        table = {a.lower(): b for a, b in reversed(soft)}
        hard = keys_of("tech-inclusive", overrides)
        both = scan(ctx, [("masked", near + phrases([a for a, _ in soft])), *([("masked", phrases(hard))] if hard else [])], [R.present(R.folded_all([a for a, _ in soft]), known), *([R.present(R.folded_all(hard), known)] if hard else [])])
        weak, strong = both.where("k = 0"), both.where("k = 1").select(F.col("doc_id").alias("d"), F.col("offset").alias("o"), raw("match").alias("l"))
        weak = weak.join(strong, F.expr("doc_id = d and offset < o + l and o < offset + octet_length(match)"), "left_anti")
        add(weak, "tech-historical-terms", "inclusive", "advisory", c("offset"), raw("match"), c("match"), F.concat(F.lit("context-dependent legacy term — consider '"), F.element_at(_table(table), F.lower("match")), F.lit("'")))
    if style == "microsoft":
        numeral = sentences.where(c("text").rlike("^[0-9]") & ~c("lead").rlike(r"^\s*\d+[.)]\s*$"))
        add(numeral, "no-numeral-sentence-start", "style", "advisory", c("start"), F.lit(1), F.left("text", F.lit(1)), "don't start a sentence with a numeral")
        for rule, pattern, message in (("microsoft-heading-acronyms", r"\b[A-Z]{2,4}\b", "avoid acronyms in headings"), ("microsoft-heading-colons", ": [a-z]", "capitalize the first word after a colon in a heading")):
            found = heads.withColumn("hit", F.regexp_extract("text", pattern, 0)).where("hit <> ''").withColumn("before", raw(F.element_at(F.split("text", pattern, 2), 1)))
            add(found, rule, "style", "advisory", c("start") + c("before"), raw("hit"), c("hit"), message)
    if style == "google":
        gerund = heads.withColumn("w", F.regexp_replace(F.regexp_extract("text", r"^\S+", 0), "^[^A-Za-z]+|[^A-Za-z]+$", "")).where(c("w").rlike("(?i)ing$") & (F.length("w") > 4))
        add(gerund, "no-gerund-heading", "style", "warn", c("start"), raw("text"), c("text"), "Google style avoids gerund headings")
        add(heads.where(c("text").rlike(r"\](?:\(|\[)")), "no-link-in-heading", "style", "warn", c("start"), raw("text"), c("text"), "Google style avoids links in headings")
    if style == "plain":
        long = ctx.select("doc_id", F.explode("long_sentences").alias("s")).select("doc_id", "s.*")
        add(long.where("words between 21 and 30"), "plain-long-sentence", "clarity", "advisory", c("start"), c("length"), c("text"), F.format_string("plain language target is under 20 words — this sentence has %d", "words"))
        hard = with_grade(ctx).where((c("grade.words") >= 30) & (c("grade.grade") > grade_target))
        add(hard, "reading-grade", "clarity", "advisory", F.lit(0), F.least(F.lit(80), raw("masked")), F.left("masked", F.lit(80)), F.format_string("reading grade %.1f exceeds target %.1f (%d words, %d sentences)", "grade.grade", F.lit(grade_target), "grade.words", "grade.sentences"))
    return out


def context(docs: DataFrame, style: str = "microsoft", overrides: dict | None = None, glossary: tuple = (), columns: tuple[str, ...] = COLUMNS, literals: tuple[str, ...] | None = None) -> DataFrame:
    """The context that ``detect`` makes: written once to the shared folder and read by column, all columns and literals unless some are
    named. Rows are told apart by a number of their own inside ``doc_id``, a struct (row, id), so documents that share an id or have none stay apart."""
    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id")).alias("doc_id"), "text")
    asked = R.literals_of(R.selected(style, (), overrides), overrides, glossary) if literals is None else literals
    return materialized(with_context(spread(keyed), columns=columns, literals=asked))


def reads(rules: list[R.Rule], structural: set[str], known: frozenset) -> set[str]:
    """Columns of the context that the plans of these pattern rules and structural rules read."""
    out = {c for rule in structural for c in READS[rule].split()}
    for r in rules:
        look = R.possible(r, known)
        out |= {"masked", "words"} | {c for c in ("vocab", "present") if f"arrays_overlap({c}," in look} | ({r.on} & set(COLUMNS))
    return out


def _whole(ctx: DataFrame) -> DataFrame:
    """``ctx`` with nulls for what it wasn't asked for: the plans of rules that don't run are made over them, and left."""
    missing = [f for f in StructType.fromDDL(SCHEMA).fields if f.name not in ctx.columns]
    return ctx.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else ctx


def detect(docs: DataFrame, style: str = "microsoft", ignore: tuple[str, ...] = (), zero: tuple[str, ...] = (), overrides: dict | None = None, glossary: tuple = (), only: tuple[str, ...] | None = None, made: DataFrame | None = None) -> DataFrame:
    """Findings of documents (doc_id, text): ``FINDING`` columns, one row each. Use ``ordered`` for their order.

    ``only`` restricts the plan to some rules; rules that don't run never reach it, and the context holds what the others read. ``made`` is
    a ``context`` of the same documents, style and lists, to be used again. A null text has no findings; rows that repeat an id each have their own.
    """
    wanted = lambda rule: rule not in ignore and (only is None or rule in only)
    chosen = [r for r in R.selected(style, ignore, overrides) if wanted(r.id)]
    structural = {rule for rule in STRUCTURAL if wanted(rule) and OWN.get(rule, style) == style}
    literals = R.literals_of(R.selected(style, (), overrides), overrides, glossary)
    if made is None:
        literals = R.literals_of(chosen, overrides, glossary, any("present" in READS[rule].split() for rule in structural))
        columns = reads(chosen, structural, frozenset(literals))
        made = context(docs, style, overrides, glossary, tuple(c for c in COLUMNS if c in columns), literals)
    ctx, known, parts = made, frozenset(literals), []
    if chosen:
        parts.append(pattern_findings(ctx, chosen, zero, known))
    if only is None or STRUCTURAL & set(only):
        parts += [p for _, p in structural_findings(_whole(ctx), style, overrides, glossary, wanted=wanted, known=known)]
    return reduce(DataFrame.unionByName, parts).withColumn("doc_id", F.col("doc_id.id"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("doc_id", "offset", "rule_id", "length", "message")
