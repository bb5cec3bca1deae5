"""Ignore files of a project: patterns scoped by folder, the last match wins, and what lies in an ignored folder stays ignored.

The tree is a relation: folders and files stand beside their ancestors, patterns beside the folder of their file, so one equi join on folders finds
every pattern that a path is asked for.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.operators.filters import basename, in_skipped_folder, is_markdown

# Names of ignore files, the stronger one last.
IGNORE_FILES = [".gitignore", ".ignore"]
SALT = 16  #: places that the paths below one folder are dealt to


class Walk(NamedTuple):
    """found: rows of files in order of path; missing: (argument) that nothing stands for; passed: (argument) that are files of another kind."""

    found: DataFrame
    missing: DataFrame
    passed: DataFrame


def folder_of(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def above(path: Column, own: bool = False) -> Column:
    """The folders that hold a path, the top (empty) first, and with ``own`` the path itself last."""
    parts = F.split(path, "/")
    size = F.size(parts) if own else F.size(parts) - 1
    return F.concat(F.array(F.lit("")), F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>")))


def _body(glob: Column) -> Column:
    """A pattern's path part as an expression: ``*`` and ``?`` stay in a folder, ``**`` between slashes crosses folders."""
    out = F.regexp_replace(glob, r"(?<!\\)([.+^$(){}|])", r"\\$1")
    out = F.regexp_replace(out, r"(?<!\\)\[\\?[!^]", "[^")
    out = F.regexp_replace(out, r"^\*\*/", "\u0001")
    out = F.regexp_replace(out, r"/\*\*/", "/\u0001")
    out = F.regexp_replace(out, r"/\*\*$", "/\u0002")
    out = F.regexp_replace(out, r"(?<!\\)\*+", "[^/]*")
    out = F.regexp_replace(out, r"(?<!\\)\?", "[^/]")
    return F.replace(F.replace(out, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".+"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """(folder, strength, line, again, folders, pattern) of the patterns in ignore files (path, text).

    ``again`` takes back what an earlier pattern ignored (``!``), ``folders`` asks for folders alone (a slash at the end). A pattern with a slash
    elsewhere counts from its file's folder, another in any folder below. Blank lines and comments are none; a backslash takes a mark's
    meaning. A null text has no patterns.
    """
    rows = files.where(basename(F.col("path")).isin(*IGNORE_FILES)).select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "row"))
    row = F.regexp_replace("row", r"(?<!\\)[ \t]+$", "")
    rows = rows.select("path", "line", row.alias("row")).where("row <> '' and not startswith(row, '#')")
    again = F.startswith("row", F.lit("!"))
    glob = F.when(again, F.substr("row", F.lit(2))).otherwise(F.col("row"))
    rows = rows.select("path", "line", again.alias("again"), F.regexp_replace(glob, r"^\\([#!])", "$1").alias("glob"))
    folders = F.endswith("glob", F.lit("/"))
    bare = F.regexp_replace("glob", "/$", "")
    anchored = F.contains(bare, F.lit("/"))
    inner = F.regexp_replace(bare, "^/", "")
    pattern = F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), _body(inner), F.lit("$"))
    strength = F.when(basename(F.col("path")) == IGNORE_FILES[1], 1).otherwise(0)
    return rows.select(folder_of(F.col("path")).alias("folder"), strength.alias("strength"), "line", "again", folders.alias("folders"), pattern.alias("pattern")).where("pattern not in ('^$', '^(?:.*/)?$')")


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of the files in ``paths`` (path) that ``ignore_rules`` leave out: the last pattern of the strongest and deepest ignore file that
    matches the file, or a folder that holds it, ignores it.

    Each folder is decided once, however many files it holds. The paths below one folder are dealt to ``SALT`` places, each with that folder's
    patterns, so the top folder's patterns meet no single task with all paths.
    """
    files = paths.select("path").distinct()
    folders = files.select(F.explode(above(F.col("path"))).alias("path")).where("path <> ''").distinct()
    entries = files.select("path", F.lit(False).alias("is_folder")).unionByName(folders.select("path", F.lit(True).alias("is_folder")))
    asked = entries.select("path", "is_folder", F.explode(above(F.col("path"))).alias("folder")).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int"))
    dealt = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substr("path", F.length("folder") + 2))
    met = asked.join(dealt, ["folder", "salt"]).where((~F.col("folders") | F.col("is_folder")) & F.regexp_like(below, F.col("pattern")))
    order = F.struct("strength", F.length("folder").alias("depth"), "line")
    decided = met.groupBy("path", "is_folder").agg(F.max_by("again", order).alias("again")).where("not again")
    own = decided.where("not is_folder").select("path")
    inside = files.select("path", F.explode(above(F.col("path"))).alias("in")).join(decided.where("is_folder").select(F.col("path").alias("in")), "in", "left_semi").select("path")
    return own.unionByName(inside).distinct()


def walk(files: DataFrame, arguments: list[str] | None = None, rules: DataFrame | None = None) -> Walk:
    """Markdown that the arguments name, as files or as folders that are walked; without arguments the whole tree.

    ``files`` has (path, ...), every file of the tree; patterns are taken from its ignore files where ``rules`` gives none. Skipped and ignored
    folders are left out of a folder's walk; a file that an argument names is found in any case. Arguments without a file or folder are
    ``missing``, files that aren't Markdown ``passed``. A file that two arguments reach is found once.
    """
    spark = files.sparkSession
    names = list(dict.fromkeys(a.rstrip("/").removeprefix("./") or "." for a in arguments or ["."]))
    asked = spark.createDataFrame([(a, "" if a == "." else a) for a in names], "argument string, at string")
    held = files.select("path").distinct()
    reach = held.select("path", F.explode(above(F.col("path"), own=True)).alias("at")).join(F.broadcast(asked), "at")
    exact = reach.where("path = at")
    passed = exact.where(~is_markdown(F.col("path"))).select("argument").distinct()
    # What is skipped is looked for below the argument's folder only.
    below = F.when(F.col("at") == "", F.col("path")).otherwise(F.substr("path", F.length("at") + 2))
    walked = reach.where("path <> at").where(is_markdown(F.col("path")) & ~in_skipped_folder(folder_of(below)))
    left_out = ignored_paths(held, ignore_rules(files) if rules is None else rules)
    found = exact.where(is_markdown(F.col("path"))).select("path").unionByName(walked.select("path").join(left_out, "path", "left_anti")).distinct()
    missing = asked.join(reach.select("argument").distinct(), "argument", "left_anti").where("argument <> '.'").select("argument")
    return Walk(files.join(found, "path", "left_semi"), missing, passed)
