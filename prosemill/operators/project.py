"""Project checks over files (path, text): anti joins between what is referred to and what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.operators.commonmark import conform
from prosemill.operators.declarations import nested_keys, spans, symbol_span  # noqa: F401
from prosemill.operators.filters import SOURCE_LANGUAGES, basename, is_markdown, language_of
from prosemill.operators.ignores import SALT, above, folder_of

# Fixed values.
REQUIRED = {"README.md": "error", "LICENSE": "error", "CONTRIBUTING.md": "error", "CODE_OF_CONDUCT.md": "warn", "SECURITY.md": "warn", "CHANGELOG.md": "warn"}
ARCHETYPES = {
    "runbook": ("RUNBOOK.md", ["Overview", "Prerequisites", "Steps", "Rollback", "Escalation"]),
    "adr": ("ADR.md", ["Status", "Context", "Decision", "Consequences"]),
    "postmortem": ("POSTMORTEM.md", ["Summary", "Impact", "Timeline", "Root Cause", "Action Items", "Lessons"]),
    "rfc": ("RFC.md", ["Summary", "Motivation", "Alternatives", "Drawbacks", "Rollout Plan", "Open Questions"]),
    "contributing": ("CONTRIBUTING.md", ["Getting Started", "Development", "Testing", "Pull Requests", "Code of Conduct"]),
    "code-of-conduct": ("CODE_OF_CONDUCT.md", ["Our Pledge", "Our Standards", "Enforcement Responsibilities", "Enforcement"]),
    "governance": ("GOVERNANCE.md", ["Roles", "Decision Process", "Membership", "Amendments"]),
    "security": ("SECURITY.md", ["Supported Versions", "Reporting a Vulnerability", "Response Process"]),
}
BLAME = ["human error", "operator error", "careless", "negligent", "should have known"]
PLATFORMS = {
    "mkdocs": ["mkdocs.yml", "mkdocs.yaml"], "docusaurus": ["docusaurus.config.js", "docusaurus.config.ts"], "sphinx": ["docs/conf.py", "conf.py"],
    "hugo": ["hugo.toml", "hugo.yaml", "config.toml", "config.yaml"], "jekyll": ["_config.yml", "_config.yaml"], "mdbook": ["book.toml"], "antora": ["antora.yml", "antora-playbook.yml"],
    "docsify": ["index.html", ".nojekyll"], "vitepress": ["docs/.vitepress/config.ts", ".vitepress/config.ts"], "starlight": ["astro.config.mjs", "astro.config.ts"],
    "gitbook": [".gitbook.yaml", "SUMMARY.md"], "readthedocs": [".readthedocs.yaml", "readthedocs.yml"],
}
#: Programs whose calls in documents are commands.
TOOLS = "cargo git gh npm pnpm yarn make docker kubectl python python3 node".split()


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, text) with lines from 1."""
    return files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def headings(files: DataFrame) -> DataFrame:
    """(path, line, level, text): ATX headings outside of fences; a fence is open after an odd number of fence lines."""
    rows = lines_of(files).withColumn("fence", F.col("text").rlike(r"^ {0,3}(?:```|~~~)").cast("int"))
    open_ = F.sum("fence").over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)) % 2
    heads = rows.withColumn("open", open_).where("open = 0 and fence = 0").withColumn("hashes", F.regexp_extract("text", r"^ {0,3}(#{1,6})[ \t]+\S", 1)).where("hashes <> ''")
    return heads.select("path", "line", F.length("hashes").alias("level"), F.regexp_replace(F.regexp_replace("text", r"^ {0,3}#{1,6}[ \t]+", ""), r"[ \t]+#*[ \t]*$", "").alias("text"))


def slug(heading: Column) -> Column:
    """An anchor as code hosts make it: lower case, punctuation dropped, blanks as hyphens."""
    return F.replace(F.regexp_replace(F.lower(F.trim(heading)), r"(?U)[^\w\- ]", ""), F.lit(" "), F.lit("-"))


def anchors(files: DataFrame) -> DataFrame:
    """(path, slug): repeats of a slug get -1, -2 and so on."""
    rows = headings(files).withColumn("s", slug(F.col("text")))
    nth = F.row_number().over(W.partitionBy("path", "s").orderBy("line")) - 1
    return rows.select("path", F.when(nth == 0, F.col("s")).otherwise(F.concat("s", F.lit("-"), nth)).alias("slug"))


#: From a fence line to the next one, or to the end.
_FENCED = r"(?ms)^ {0,3}(?:```|~~~)[^\n]*\n?+.*?(?:^ {0,3}(?:```|~~~)[^\n]*|\z)"


def _outside_code(files: DataFrame) -> DataFrame:
    """(path, text) without fenced blocks and inline code; a fence is open after an odd number of fence lines."""
    plain = F.when(F.col("text").rlike("```|~~~"), F.regexp_replace("text", _FENCED, "")).otherwise(F.col("text"))
    return files.select("path", F.regexp_replace(plain, r"`[^`\n]*`", "").alias("text"))


def links(files: DataFrame) -> DataFrame:
    """(path, target) of inline links and images as written, and of references by way of their definitions; code holds none."""
    plain = _outside_code(files)
    inline = plain.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]\n]*\]\(([^)\s]+)(?:\s+\"[^\"\n]*\")?\)"), F.lit(1))).alias("target"))
    said = plain.where(F.contains("text", F.lit("]:")))
    defined = said.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^ {0,3}(\[[^\]\n]+\]:[ \t]+\S+)"), F.lit(1))).alias("d"))
    defined = defined.select("path", F.lower(F.regexp_extract("d", r"^\[([^\]]+)\]", 1)).alias("id"), F.regexp_extract("d", r"\]:[ \t]+<?([^\s>]+)", 1).alias("target")).dropDuplicates(["path", "id"])
    # [text][id], [id][] and [id]; a definition isn't a use.
    uses = F.regexp_extract_all("text", F.lit(r"\[([^\]\[\n]+)\](?:\[([^\]\n]*)\])?(?![(:\[])"), F.lit(0))
    used = said.select("path", F.explode(uses).alias("u")).select("path", F.lower(F.regexp_extract("u", r"\[([^\]\[]+)\](?:\[\])?$", 1)).alias("id"))
    return inline.unionByName(used.join(defined, ["path", "id"]).select("path", "target"))


def normalized(path: Column) -> Column:
    """``a/./b/../c`` as ``a/c``; parts that climb above the root stay."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), lambda acc, p: F.when(F.size(acc) == 0, F.when(p.isin("", "."), acc).otherwise(F.array(p))).otherwise(step(acc, p))), "/")


def check_links(files: DataFrame) -> DataFrame:
    """link-broken (path, target, message): relative links without their file, or without their heading in a markdown file."""
    md = files.where(is_markdown(F.col("path")))
    unescape = F.coalesce(F.try_url_decode(F.replace(F.col("target"), F.lit("+"), F.lit("%2B"))), F.col("target"))
    rel = links(md).where(~F.col("target").rlike("(?i)^(?:https?://|mailto:|tel:|//)")).withColumn("t", unescape)
    rel = rel.withColumns({"file": F.regexp_extract("t", "^[^#?]*", 0), "anchor": F.regexp_extract("t", "#(.*)$", 1)})
    folder = F.regexp_replace("path", "[^/]*$", "")
    rel = rel.withColumn("file", F.when(F.col("file") == "", F.col("path")).when(F.col("file").startswith("/"), normalized(F.col("file"))).otherwise(normalized(F.concat(folder, F.col("file")))))
    there = files.select("path").union(files.select(F.regexp_replace("path", "/?(?:README|index)\\.md$", "").alias("path"))).distinct().withColumnRenamed("path", "file")
    gone = rel.join(there, "file", "left_anti").select("path", "target", F.lit("linked file is missing").alias("message"))
    asked = rel.where("anchor <> '' and file rlike '(?i)[.](md|markdown|mdx|mdc)$'").join(there, "file", "left_semi")
    lost = asked.join(anchors(md).select(F.col("path").alias("file"), F.col("slug").alias("anchor")), ["file", "anchor"], "left_anti")
    lost = lost.select("path", "target", F.when(F.col("file") == F.col("path"), "anchor is missing in this file").otherwise("linked anchor is missing").alias("message"))
    return gone.unionByName(lost).withColumns({"rule_id": F.lit("link-broken"), "severity": F.lit("error")})


def check_anchors(pages: DataFrame) -> DataFrame:
    """anchor-broken (path, target, line): ``href="#x"`` without an ``id="x"`` in the same file."""
    ids = pages.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"""\bid\s*=\s*\{?["']([^"']+)["']"""), F.lit(1))).alias("target")).distinct()
    hrefs = lines_of(pages).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"""\bhref\s*=\s*\{?["']#([^"']+)["']"""), F.lit(1))).alias("target"))
    return hrefs.join(ids, ["path", "target"], "left_anti").withColumns({"rule_id": F.lit("anchor-broken"), "severity": F.lit("error")})


def check_navigation(files: DataFrame) -> DataFrame:
    """nav-missing-target and nav-orphan-page (rule_id, path, target): a navigation file and the pages below its folder, by an equi join on that folder.

    Targets are paths from the file's folder or from its ``docs``. The pages below one folder are dealt to ``SALT`` places.
    """
    nav = files.where(basename(F.col("path")).isin("mkdocs.yml", "mkdocs.yaml", "_toc.yml")).withColumn("root", folder_of(F.col("path")))
    named = nav.select(F.col("path").alias("nav"), "root", F.explode(F.split("text", r"[\s\"'\[\](),]+")).alias("t")).where("t rlike '[.]md($|#)' and not t rlike '^https?:'").select("nav", "root", F.regexp_replace("t", "#.*$", "").alias("target")).distinct()
    docs = files.where(is_markdown(F.col("path")) & ~F.col("path").startswith(".") & ~basename(F.col("path")).isin(*REQUIRED)).select("path").distinct()
    places = F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")
    below = docs.select("path", F.explode(above(F.col("path"))).alias("root"), places.alias("salt"))
    roots = nav.select(F.col("path").alias("nav"), "root", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    own = F.when(F.col("root") == "", F.col("path")).otherwise(F.substr("path", F.length("root") + 2))
    pages = below.join(roots, ["root", "salt"]).select("nav", "path", own.alias("own"), F.regexp_replace(own, "^docs/", "").alias("short"))
    there = pages.select("nav", F.explode(F.array_distinct(F.array("own", "short"))).alias("target"))
    missing = named.join(there, ["nav", "target"], "left_anti").select(F.lit("nav-missing-target").alias("rule_id"), F.col("nav").alias("path"), "target", F.lit("error").alias("severity"))
    orphan = pages.join(named.select("nav", F.col("target").alias("short")), ["nav", "short"], "left_anti").join(named.select("nav", F.col("target").alias("own")), ["nav", "own"], "left_anti")
    return missing.unionByName(orphan.select(F.lit("nav-orphan-page").alias("rule_id"), "path", F.col("nav").alias("target"), F.lit("warn").alias("severity")))


def check_community(files: DataFrame) -> DataFrame:
    """community-missing-file and community-invalid-file (rule_id, path, severity)."""
    spark = files.sparkSession
    wanted = spark.createDataFrame(list(REQUIRED.items()), "path string, severity string")
    missing = wanted.join(files.select("path"), "path", "left_anti").withColumn("rule_id", F.lit("community-missing-file"))
    body = F.trim("text")
    bad = files.join(wanted, "path").where(F.col("text").isNull() | body.isin("", "TODO", "<TODO>") | (is_markdown(F.col("path")) & ~F.col("text").rlike(r"(?m)^# \S"))).select("path", "severity", F.lit("community-invalid-file").alias("rule_id"))
    return missing.unionByName(bad)


def sections(spark) -> DataFrame:
    return spark.createDataFrame([(a, f, i, s) for a, (f, names) in ARCHETYPES.items() for i, s in enumerate(names)], "archetype string, file string, ordinal int, section string")


def _norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def check_sections(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """asset-missing-section (path, target): sections of an archetype's file that have no heading; overrides (archetype, section) replace a list."""
    wanted = sections(files.sparkSession)
    if overrides is not None:
        names = wanted.select("archetype", "file").distinct()
        wanted = wanted.join(overrides.select("archetype").distinct(), "archetype", "left_anti").select("archetype", "file", "section").unionByName(overrides.join(names, "archetype").select("archetype", "file", "section"))
    assets = files.withColumn("file", basename(F.col("path"))).join(wanted, "file").select("path", "section")
    have = headings(files).select("path", _norm(F.col("text")).alias("key"))
    return assets.withColumn("key", _norm(F.col("section"))).join(have, ["path", "key"], "left_anti").select("path", F.col("section").alias("target"), F.lit("asset-missing-section").alias("rule_id"), F.lit("error").alias("severity"))


def postmortem_blame(files: DataFrame) -> DataFrame:
    phrases = F.array(*[F.lit(p) for p in BLAME])
    return files.where(basename(F.col("path")) == ARCHETYPES["postmortem"][0]).select("path", F.explode(F.filter(phrases, lambda p: F.contains(F.lower("text"), p))).alias("target"), F.lit("postmortem-blame").alias("rule_id"), F.lit("error").alias("severity"))


#: What names an archetype in a file name or in the headings, in order.
KEYWORDS = [
    ("postmortem", ["postmortem"], ["postmortem", "incident review"]), ("runbook", ["runbook"], ["runbook"]), ("rfc", ["rfc"], ["request for comments"]), ("adr", ["adr"], ["architecture decision"]),
    ("contributing", ["contributing"], []), ("code-of-conduct", ["code_of_conduct", "code-of-conduct"], []), ("governance", ["governance"], []), ("security", ["security"], []),
]


def asset_types(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(path, archetype): by file name, else by a word of the name or the headings, else the first that has three of its sections as
    headings, else one of which ``overrides`` (archetype, section) names two."""
    spec, order = sections(files.sparkSession), {a: i for i, a in enumerate(ARCHETYPES)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    name, heads = F.lower(basename(F.col("path"))), headings(files)
    by_name = files.select("path", name.alias("file")).join(spec.select(F.lower("file").alias("file"), "archetype").distinct(), "file").select("path", "archetype", F.lit(0).alias("rank"))
    said = files.select("path", name.alias("name")).join(heads.groupBy("path").agg(F.lower(F.array_join(F.collect_list("text"), " ")).alias("said")), "path", "left")
    word = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains("name", F.lit(x)) for x in names] + [F.contains(F.coalesce("said", F.lit("")), F.lit(x)) for x in phrases]), F.struct(F.lit(a).alias("archetype"), F.lit(100 + i).alias("rank"))) for i, (a, names, phrases) in enumerate(KEYWORDS)])
    by_word = said.withColumn("w", word).where("w is not null").select("path", "w.archetype", "w.rank")

    def by_sections(wanted: DataFrame, least: int, rank: int) -> DataFrame:
        met = heads.select("path", _norm(F.col("text")).alias("key")).distinct().join(wanted.withColumn("key", _norm(F.col("section"))), "key")
        return met.groupBy("path", "archetype").agg(F.countDistinct("key").alias("n")).where(F.col("n") >= least).select("path", "archetype", (place[F.col("archetype")] + rank).alias("rank"))

    found = by_name.unionByName(by_word).unionByName(by_sections(spec, 3, 200))
    if overrides is not None:
        found = found.unionByName(by_sections(overrides, 2, 300))
    return found.groupBy("path").agg(F.min_by("archetype", "rank").alias("archetype"))


def platforms(files: DataFrame) -> DataFrame:
    """(platform, marker): the first marker file of each platform that is there."""
    marks = files.sparkSession.createDataFrame([(p, i, m) for p, ms in PLATFORMS.items() for i, m in enumerate(ms)], "platform string, ordinal int, path string")
    return marks.join(files.select("path"), "path").groupBy("platform").agg(F.min_by("path", "ordinal").alias("marker"))


def source_of(path: Column) -> Column:
    """The source document's path of a translation in any of four layouts; null for other paths."""
    lang = language_of(path)
    quoted = F.regexp_replace(lang, "-", "\\\\-")
    suffix = F.regexp_replace(path, F.concat(F.lit(r"(?i)\."), quoted, F.lit(r"(\.[^./]+)$")), "$1")
    docusaurus = F.regexp_replace(path, r"(?i)^i18n/[^/]+/docusaurus-plugin-content-docs/current/", "docs/")
    hugo = F.regexp_replace(path, r"(?i)(^|/)content\.[^/]+/", "$1content/")
    folder = F.regexp_replace(path, F.concat(F.lit("(?i)(^|/)"), quoted, F.lit("/")), "$1")
    found = F.when(suffix != path, suffix).when(docusaurus != path, docusaurus).when(hugo != path, hugo).otherwise(folder)
    return F.when(lang.isNotNull() & ~lang.isin(*SOURCE_LANGUAGES), found)


def translations(files: DataFrame) -> DataFrame:
    """(source, path, lang): translations and their sources, by an equi join on the derived path."""
    found = files.select("path", source_of(F.col("path")).alias("source"), language_of(F.col("path")).alias("lang")).where("source is not null")
    return found.join(files.select(F.col("path").alias("source")), "source", "left_semi").dropDuplicates(["path"])


def structure(files: DataFrame) -> DataFrame:
    """(path, levels, fences, targets) of markdown files."""
    heads = headings(files).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "level"))), lambda x: x["level"]).alias("levels"))
    return files.select("path", F.floor(F.regexp_count("text", F.lit(r"(?m)^ {0,3}(?:```|~~~)")) / 2).alias("fences"), F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)))).alias("targets")).join(heads, "path", "left").withColumn("levels", F.coalesce("levels", F.array().cast("array<int>")))


def conformed(files: DataFrame) -> DataFrame:
    """(source, path, lang, issues) of all translations, by their blocks: headings, code blocks and links that the source has (see ``commonmark``)."""
    return conform(files, translations(files))


def check_translations(files: DataFrame) -> DataFrame:
    """(path, source, issue): headings, levels, code blocks and links that a translation lacks."""
    s = structure(files)
    pair = translations(files).join(s.select(F.col("path").alias("source"), F.col("levels").alias("sl"), F.col("fences").alias("sf"), F.col("targets").alias("st")), "source").join(s, "path")
    lost = F.array_except("st", "targets")
    issues = F.array_compact(
        F.concat(
            F.array(
                F.when(F.size("sl") != F.size("levels"), F.format_string("heading count differs: %d in source, %d here", F.size("sl"), F.size("levels"))).when(F.col("sl") != F.col("levels"), "heading levels differ"),
                F.when(F.col("sf") != F.col("fences"), F.format_string("code block count differs: %d in source, %d here", "sf", "fences")),
            ),
            F.transform(lost, lambda t: F.concat(F.lit("missing link: "), t)),
        )
    )
    return pair.select("path", "source", F.explode(issues).alias("issue"))


def localization(files: DataFrame) -> DataFrame:
    """(source, lang, path, layout, stale, issues, ok): a row a translation; stale where the source was modified later (files may have ``modified``)."""
    modified = files.select(F.col("path").alias("p"), F.col("modified").alias("m") if "modified" in files.columns else F.lit(None).cast("timestamp").alias("m"))
    pairs = translations(files).join(modified.select(F.col("p").alias("path"), F.col("m").alias("mine")), "path").join(modified.select(F.col("p").alias("source"), F.col("m").alias("theirs")), "source")
    issues = conformed(files).select("path", "issues")
    rows = pairs.join(issues, "path", "left").withColumns({"issues": F.coalesce("issues", F.array().cast("array<string>")), "stale": F.coalesce(F.col("theirs") > F.col("mine"), F.lit(False))})
    p = F.col("path")
    layout = F.when(p.rlike("^i18n/[^/]+/docusaurus-plugin-content-docs/"), "docusaurus").when(p.rlike(r"(?:^|/)content\.[^/]+/"), "hugo").when(p.rlike(r"\.[^./]+\.[^./]+$"), "suffix").otherwise("directory")
    return rows.select("source", "lang", "path", layout.alias("layout"), "stale", "issues", (~F.col("stale") & (F.size("issues") == 0)).alias("ok"))


def surface(files: DataFrame, tools: tuple[str, ...] = ()) -> DataFrame:
    """(kind, name, file, line, signature) of public symbols, headings, commands in documents (of ``TOOLS`` and ``tools``) and configuration keys."""
    rows = lines_of(files).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    named = spans(files.where(F.col("path").rlike(r"(?i)\.(?:rs|tsx?|jsx?|py|go)$"))).where("not (kind = 'python' and startswith(name, '_'))")
    code = named.select("kind", "name", "path", F.col("start_line").alias("line"), "signature")
    prose = rows.where(F.col("ext").isin("md", "mdx")).withColumn("text", F.trim("text"))
    heads = prose.where(F.col("text").rlike("^#{1,6} ")).select(F.lit("heading").alias("kind"), F.trim(F.regexp_replace("text", "^#{1,6} ", "")).alias("name"), "path", "line", F.col("text").alias("signature"))
    return reduce(DataFrame.unionByName, [code, heads, _commands(prose, (*TOOLS, *tools)), _config_keys(files, rows)]).withColumnRenamed("path", "file")


def _commands(prose: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Lines of fenced blocks (without a prompt) and spans of inline code that begin with a tool or a path of the project."""
    fence = F.col("text").rlike("^(?:```|~~~)")
    lines = prose.withColumn("fences", F.sum(fence.cast("int")).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0))).where(~fence)
    spans = F.transform(F.regexp_extract_all("text", F.lit("`([^`]*)`"), F.lit(1)), lambda x: F.trim(x))
    said = lines.select("path", "line", F.explode(F.when(F.col("fences") % 2 == 1, F.array(F.regexp_replace("text", r"^\$ ", ""))).otherwise(spans)).alias("signature")).withColumn("name", F.regexp_extract("signature", r"^\S+", 0))
    return said.where(F.col("name").startswith("./") | F.regexp_replace("name", r"^\./", "").isin(*tools)).select(F.lit("command").alias("kind"), "name", "path", "line", "signature")


def _config_keys(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of TOML, YAML and JSON by their whole dotted path: in TOML below the last section, elsewhere below the keys that are
    open at the line's indentation."""
    trimmed = F.trim(F.col("text"))
    live = rows.where((F.col("ext") == "toml") & (trimmed != "") & ~trimmed.startswith("#"))
    toml = live.select("path", "line", trimmed.alias("signature"), F.nullif(F.regexp_extract(trimmed, r"^\[{1,2}\s*([\w.-]+)\s*\]{1,2}$", 1), F.lit("")).alias("section"), F.nullif(F.regexp_extract(trimmed, r"^([A-Za-z_][\w-]*)\s*=", 1), F.lit("")).alias("key"))
    within = F.last("section", ignorenulls=True).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    flat = toml.withColumn("name", F.when(F.col("section").isNotNull(), F.col("section")).when(F.col("key").isNotNull(), F.concat_ws(".", within, "key"))).where("name is not null").select("path", "line", "name", "signature")
    return flat.unionByName(nested_keys(files)).select(F.lit("config").alias("kind"), "name", "path", "line", "signature")


def glob_regex(glob: Column) -> Column:
    """A glob as a regular expression: ``*`` and ``**`` cross folders, ``?`` is one character, ``{a,b}`` and ``[ab]`` are choices."""
    out = F.regexp_replace(glob, r",(?=[^{}]*\})", "\u0003")
    out = F.regexp_replace(F.regexp_replace(out, r"([.+^$()|\\])", r"\\$1"), r"\?", ".")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*/", "\u0001"), r"\*+", ".*")
    out = F.replace(out, F.lit("\u0001"), F.lit("(?:.*/)?"))
    out = F.regexp_replace(F.regexp_replace(out, r"\{", "(?:"), r"\}", ")")
    return F.concat(F.lit("^(?:"), F.regexp_replace(F.replace(out, F.lit("\u0003"), F.lit("|")), r"\[!", "[^"), F.lit(")$"))


def globbed(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """``globs`` (glob, ...) beside each of ``paths`` (path) that they match, without running every glob on every path.

    What is fixed in a glob are join keys: the folder before its first mark, and the extension behind its last one. A path is dealt out by
    the folders above it, with and without its extension, so it meets only globs that agree in both; the whole glob is tried on these.
    The paths below one folder are dealt to ``SALT`` places, as many globs begin with no folder.
    """
    fixed = F.regexp_extract("glob", r"^[^*?\[{\\]*", 0)
    keyed = globs.withColumns({"_folder": folder_of(fixed), "_ext": F.regexp_extract("glob", r"(?<!\\)(\.[A-Za-z0-9]+)$", 1), "_salt": F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))})
    ext = F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)
    asked = paths.select("path").distinct().select("path", F.explode(above(F.col("path"))).alias("_folder"), F.array_distinct(F.array(F.lit(""), ext)).alias("_exts"), F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int").alias("_salt"))
    met = asked.withColumn("_ext", F.explode("_exts")).drop("_exts").join(keyed, ["_folder", "_ext", "_salt"])
    return met.where(F.regexp_like("path", glob_regex(F.col("glob")))).drop("_folder", "_ext", "_salt")


def _spared(exclude: str) -> Column:
    return ~F.exists(F.coalesce(F.col(exclude), F.array().cast("array<string>")), lambda g: F.regexp_like("path", glob_regex(g)))


def notified(edits: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, name, message): edited paths that a rule's globs match and none of its excludes; rules (name, paths, exclude, message) are configuration.
    A rule says its message once for a path."""
    hits = globbed(edits, rules.select("name", "message", "exclude", F.explode(F.array_distinct("paths")).alias("glob")))
    return hits.where(_spared("exclude")).select("path", "name", "message").distinct()


def nudged(edits: DataFrame, nudges: DataFrame) -> DataFrame:
    """(path, name, text): edited paths that a nudge's ``file`` glob matches, and none of its ``exclude``; nudges (name, file, exclude, edit, message) are configuration."""
    hits = globbed(edits, nudges.where("file is not null").select("name", "exclude", "edit", "message", F.col("file").alias("glob"))).where(_spared("exclude"))
    why = F.when(F.coalesce(F.length("message"), F.lit(0)) > 0, F.concat(F.lit(" — "), "message")).otherwise("")
    return hits.select("path", "name", F.concat("path", F.lit(" changed — edit "), F.array_join("edit", ", "), why).alias("text"))


# Rules that a project's own files suggest.
PROPOSED = {
    "code-docs": (["src/**"], "Code changed; check docs, SPEC.md, and examples for drift."),
    "rust-manifest": (["Cargo.toml", "Cargo.lock"], "Rust manifest changed; check install, build, and dependency docs."),
}


def discovered(files: DataFrame) -> DataFrame:
    """(name, paths, message, exclude) of the notices that the files (path) suggest: for code that has documents, and for a manifest of Rust."""
    p = F.col("path")
    has = files.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in {"src": p.startswith("src/"), "docs": p.startswith("docs/") | (p == "SPEC.md"), "rust": p == "Cargo.toml"}.items()])
    rows = [F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, globs)).alias("paths"), F.lit(said).alias("message"), F.array().cast("array<string>").alias("exclude")) for n, (globs, said) in PROPOSED.items()]
    return has.select(F.explode(F.array_compact(F.array(F.when(F.col("src") & F.col("docs"), rows[0]), F.when(F.col("rust"), rows[1])))).alias("r")).select("r.*")


def check_nudges(files: DataFrame, nudges: DataFrame) -> DataFrame:
    """(name, error) for nudges (name, path, symbol): a path that isn't there, or a symbol that the file lacks; globs are passed over."""
    plain = nudges.where("path is null or not path rlike '[*?\\\\[{]'")
    none = plain.where("path is null").select("name", F.lit("missing path").alias("error"))
    absent = plain.where("path is not null").join(files.select("path"), "path", "left_anti").select("name", F.concat(F.lit("path is absent: "), "path").alias("error"))
    symbols = surface(files).select(F.col("file").alias("path"), F.col("name").alias("symbol"))
    lost = plain.where("symbol is not null").join(files.select("path"), "path", "left_semi").join(symbols, ["path", "symbol"], "left_anti").select("name", F.concat(F.lit("symbol is unresolved: "), "symbol").alias("error"))
    return none.unionByName(absent).unionByName(lost)


def template_sections(files: DataFrame, folder: str = "templates") -> DataFrame:
    """(archetype, section) of template files ``folder/<archetype>.md``: their headings below the first level."""
    own = headings(files.where(F.col("path").startswith(f"{folder}/") & is_markdown(F.col("path")))).where("level > 1")
    return own.select(F.lower(F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", "")).alias("archetype"), F.col("text").alias("section"))


def scaffold(archetype: str, title: str | None = None, template: str | None = None) -> tuple[str, str]:
    """(file, text) of a new document of an archetype: its template with ``{{title}}`` filled in, else a heading and its sections."""
    file, names = ARCHETYPES[archetype]
    said = title or archetype.replace("-", " ").title()
    if template is not None:
        return file, template.replace("{{title}}", said)
    return file, f"# {said}\n" + "".join(f"\n## {n}\n\nTODO\n" for n in names)


def templated(templates: DataFrame, titles: DataFrame) -> DataFrame:
    """(archetype, title, text): template texts (archetype, text) filled in for each of the titles (archetype, title)."""
    return titles.join(templates.select("archetype", "text"), "archetype").select("archetype", "title", F.replace("text", F.lit("{{title}}"), F.col("title")).alias("text"))


def with_term(text: str, use: str, variants: tuple[str, ...]) -> str:
    """A style document with one more row in the table under its heading Terminology; the heading and table are added where there are none."""
    row, lines = f"| {use} | {', '.join(variants)} |", text.split("\n")
    at = next((i for i, x in enumerate(lines) if x.lstrip("#").strip().lower() == "terminology" and x.startswith("#")), None)
    if at is None:
        return f"{text.rstrip()}\n\n## Terminology\n\n| use | not |\n| --- | --- |\n{row}\n".lstrip()
    end = next((i for i in range(at + 1, len(lines)) if lines[i].startswith("#")), len(lines))
    table = [i for i in range(at + 1, end) if lines[i].lstrip().startswith("|")]
    new = [row] if table else ["", "| use | not |", "| --- | --- |", row]
    place = (table[-1] if table else at) + 1
    return "\n".join(lines[:place] + new + lines[place:])


def glossary(style: DataFrame) -> DataFrame:
    """(path, use, variant) rows of the pipe table under the heading Terminology."""
    rows = lines_of(style).withColumn("head", F.when(F.col("text").rlike(r"^#{1,6}\s"), F.lower(F.trim(F.regexp_replace("text", r"^#+|#+\s*$", "")))))
    rows = rows.withColumn("section", F.last("head", ignorenulls=True).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0))).where("section = 'terminology' and text rlike '^\\\\s*[|]' and not text rlike '^[\\\\s|:-]+$'")
    cells = F.transform(F.split(F.regexp_replace("text", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("c", cells).withColumn("nth", F.row_number().over(W.partitionBy("path").orderBy("line"))).where("nth > 1 and size(c) >= 2")
    return rows.select("path", F.col("c")[0].alias("use"), F.explode(F.split(F.col("c")[1], r"\s*,\s*")).alias("variant"))
