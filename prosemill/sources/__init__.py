"""Sources: documents, line units, code strings and edit events as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators.filters import in_skipped_folder, is_generated, is_markdown
from prosemill.operators.ignores import Walk, ignore_rules, walk

MARKDOWN = "*.{md,markdown,mdx,mdc}"
CODE = "*.{js,jsx,ts,tsx}"
MARKUP = "*.{html,htm,jsx,tsx}"
TRANSLATED = "*.{md,markdown,mdx,mdc,txt,html,htm}"
SURFACE = "*.{rs,ts,tsx,js,jsx,py,go,md,mdx,toml,yaml,yml,json}"

# Attributes and keys whose strings nobody reads, and beginnings of such names.
NOT_COPY = "classname class href src id key type rel htmlfor name to path role style target method action xmlns viewbox d points as variant size color testid".split()
NOT_COPY_PREFIXES = ("data", "aria", "on")


def _below(path: Column, root: str) -> Column:
    """A file's path as it stands below ``root``."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, "\\+", "%2B")), "^.*?" + re.escape(root.rstrip("/").split(":", 1)[-1]) + "/", "")


def text_files(spark: SparkSession, root: str, pattern: str = MARKDOWN, limit: int | None = None) -> DataFrame:
    """(path relative to ``root``, text, modified) of files below ``root``, without skipped folders; the name filter prunes the listing.

    With a ``limit`` the first so many files in order of path are read and no others: they are chosen from the listing alone.
    """
    source = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern)
    if limit is None:
        files = source.option("recursiveFileLookup", True).load(root)
    else:
        names = listed(spark, root, pattern).orderBy("path").limit(max(0, limit)).select("full").collect()  # as many as are asked for
        files = source.load([r["full"] for r in names]) if names else spark.createDataFrame([], "value string, _metadata struct<file_path:string,file_modification_time:timestamp>")
    out = files.select(_below(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    return out.where(~in_skipped_folder(F.col("path")))


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, full) of the files below ``root`` without skipped folders, from the listing: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    # A path is read again as it stands, so what a pattern would take for a mark is escaped.
    full = F.regexp_replace("path", r"([\[\]{}*?\\])", r"\\$1")
    out = files.select(_below(F.col("_metadata.file_path"), root).alias("below"), F.col("modificationTime").alias("modified"), full.alias("full")).withColumnRenamed("below", "path")
    return out.where(~in_skipped_folder(F.col("path")))


def ignore_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the ignore files below ``root``. Spark's own readers pass over names that begin with a dot, so the shared storage is asked for
    them by Hadoop's globs, one a depth of the tree; they are configuration, and only they are read by the driver."""
    depth = listed(spark, root).agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    jvm, base = spark.sparkContext._jvm, root.rstrip("/")
    rows = []
    for k in range(depth):
        at = jvm.org.apache.hadoop.fs.Path(base + "/*" * k + "/{.gitignore,.ignore}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.globStatus(at) or []:
            stream = fs.open(status.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            parts = status.getPath().toString().split("/")
            rows.append(("/".join(parts[len(parts) - k - 1 :]), text))
    return spark.createDataFrame(rows, "path string, text string")


def markdown_tree(spark: SparkSession, root: str, arguments: list[str] | None = None, limit: int | None = None) -> Walk:
    """Markdown (path, text, modified) below ``root`` that the arguments name, without what ignore files leave out, and the arguments that name
    nothing. The files are chosen from the listing, so only those found are opened; a ``limit`` takes the first of them in order of path."""
    names = listed(spark, root)
    made = walk(names, arguments, ignore_rules(ignore_files(spark, root)))
    if limit is None:
        return Walk(text_files(spark, root).join(made.found.select("path"), "path", "left_semi"), made.missing, made.passed)
    chosen = [r["full"] for r in made.found.orderBy("path").limit(max(0, limit)).select("full").collect()]
    if not chosen:
        return Walk(text_files(spark, root, limit=0), made.missing, made.passed)
    files = spark.read.format("text").option("wholetext", True).load(chosen)
    return Walk(files.select(_below(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified")), made.missing, made.passed)


def translated_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, modified) of the texts that may have or be translations: Markdown, plain text and HTML."""
    return text_files(spark, root, TRANSLATED)


def markdown_documents(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Markdown below ``root``, without generated files and those that a glob of ``ignore`` names by path or base name."""
    from prosemill.operators.filters import basename
    from prosemill.operators.project import glob_regex

    out = text_files(spark, root).where(is_markdown(F.col("path")) & ~is_generated(F.col("path")))
    for glob in ignore:
        pattern = glob_regex(F.lit(glob))
        out = out.where(~F.regexp_like(F.col("path"), pattern) & ~F.regexp_like(basename(F.col("path")), pattern))
    return out


def one_document(spark: SparkSession, text: str, path: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(path, text)], "path string, text string")


def line_units(docs: DataFrame, key: str = "path") -> DataFrame:
    """Each line that isn't blank as a document of its own: (key, line from 1, text)."""
    return docs.select(key, F.posexplode(F.split("text", "\r?\n")).alias("i", "text")).where(F.trim("text") != "").select(key, (F.col("i") + 1).alias("line"), "text")


#: A string literal with the name that it is the value of, if any. Literals are read from left to right, so a quote inside one begins none.
_LITERAL = r"""(?U)(?:(?<![A-Za-z_])[A-Za-z_][\w-]*+\s*+[=:]\s*+)?(?:"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`)"""


def code_strings(files: DataFrame) -> DataFrame:
    """(path, line, text): text nodes and string literals of JS and TS sources that read like copy.

    Left out are tests, lines that import, export from elsewhere, require or begin a comment, values of names that nobody reads
    (``NOT_COPY``), and templates with values inside.
    """
    rows = files.where(F.col("path").rlike(r"(?i)\.(?:js|jsx|ts|tsx)$") & ~F.col("path").rlike(r"\.(?:test|spec)\.[^/]*$")).select("path", F.posexplode(F.split("text", "\r?\n")).alias("i", "row"))
    head = F.regexp_replace("row", r"(?U)^\s+", "")
    passed = head.rlike(r"^(?:import |//|/\*|\*)|require\(") | (F.startswith(head, F.lit("export ")) & F.contains(head, F.lit(" from ")))
    rows = rows.where(~passed)
    nodes = F.transform(F.regexp_extract_all("row", F.lit(">([^<>{}]+)<"), F.lit(1)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    name = lambda m: F.lower(F.regexp_extract(m, r"^([A-Za-z_][\w-]*+)\s*+[=:]", 1))
    unread = lambda m: name(m).isin(*NOT_COPY) | name(m).rlike(f"^(?:{'|'.join(NOT_COPY_PREFIXES)})")
    literals = F.filter(F.regexp_extract_all("row", F.lit(_LITERAL), F.lit(0)), lambda m: ~unread(m) & ~(F.endswith(m, F.lit("`")) & F.contains(m, F.lit("${"))))
    inner = F.transform(literals, lambda m: F.regexp_replace(m, r"""(?Us)^(?:[A-Za-z_][\w-]*+\s*+[=:]\s*+)?["'`]|.\z""", ""))
    out = rows.select("path", (F.col("i") + 1).alias("line"), F.explode(F.concat(nodes, inner)).alias("text"))
    return out.where(is_copy(F.col("text")))


def is_copy(text: Column) -> Column:
    """Whether a string reads like prose: a blank, a lower-case letter, two words of letters alone, and no address or path."""
    s = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    words = F.transform(F.split(s, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"""^[.,!?:;"']+|[.,!?:;"']+$""", ""))
    plain = F.size(F.filter(words, lambda w: w.rlike(r"^\p{IsAlphabetic}{2,}$")))
    return (F.octet_length(s) >= 4) & F.contains(s, F.lit(" ")) & ~s.rlike(r"://|^\.{0,2}/") & s.rlike("[a-z]") & (plain >= 2)


def json_texts(column: str) -> Column:
    """The strings that stand as values anywhere in a JSON text, at any depth and decoded; null where the text isn't JSON.

    Quotes in JSON begin and end strings and nothing else, so its strings are read off from left to right; keys are those before a colon. What is
    left is decoded as one array. An array grows with one event, nothing is shuffled, and a stream reads it like a table.
    """
    strings = F.regexp_extract_all(column, F.lit(r'"(?:\\.|[^"\\])*"(?:\s*:)?'), F.lit(0))
    values = F.filter(strings, lambda t: ~F.endswith(t, F.lit(":")))
    return F.when(F.try_parse_json(F.col(column)).isNotNull(), F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>"))


def looks_like_path(text: Column) -> Column:
    return text.rlike(r"\.(?:md|mdx|mdc|txt)\z|/")


def edited_paths(events: DataFrame, column: str = "value", keep: tuple[str, ...] = (), root: str = "") -> DataFrame:
    """(keep..., path): a row for each path that a JSON edit event names, at any depth and under any key, once an event.

    A string is a path if it has a slash or ends like a text file. ``file://`` is taken off, and ``root`` from paths below it. Events that are null or not
    JSON name none; columns of ``events`` by other names are left out. Rows are told apart by the caller (``distinct``, or
    ``prosemill.streaming.edited_once`` on a stream).
    """
    found = F.transform(F.filter(json_texts(column), looks_like_path), lambda t: F.regexp_replace(t, "^file://", ""))
    base = root.rstrip("/") + "/"
    below = found if not root else F.transform(found, lambda p: F.when(F.startswith(p, F.lit(base)), F.substr(p, F.lit(len(base) + 1))).otherwise(p))
    return events.select(*keep, F.explode(F.array_distinct(below)).alias("path"))
