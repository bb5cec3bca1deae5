"""Declarations in code and headings in documents, with the lines that each one spans.

A declaration line is read word by word: modifiers, a keyword, a name. A span ends before the next line that stands no deeper, which for all
marks of a file at once is the next smaller element, found with a stack in one walk over its lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.operators.filters import is_markdown


class Language(NamedTuple):
    """kind, the word that a declaration must begin with (if any), words that may follow it, keywords, and whether a name may be taken."""

    kind: str
    lead: str
    between: tuple[str, ...]
    keywords: frozenset[str]
    public: re.Pattern


def _language(kind: str, lead: str, between: str, keywords: str, public: str = r"[A-Za-z_]\w*$") -> Language:
    return Language(kind, lead, tuple(between.split()), frozenset(keywords.split()), re.compile(public, re.ASCII))


# What declares something in each language.
LANGUAGES = {
    "rs": _language("rust", "pub", "async", "fn struct enum trait type const static mod"),
    "ts": _language("js-ts", "export", "default async", "function const let var class interface type enum", r"[A-Za-z_$][\w$]*$"),
    "py": _language("python", "", "async", "def class"),
    "go": _language("go", "", "", "func type const var", r"[A-Z]\w*$"),
}
LANGUAGES |= {"tsx": LANGUAGES["ts"], "js": LANGUAGES["ts"], "jsx": LANGUAGES["ts"]}
#: Words behind which ``async`` may stand before the keyword.
ASYNC_OF = {"fn", "function", "def"}
#: What a line begins with that ends the span before it.
STARTS = ("pub ", "pub(", "export ", "def ", "async def ", "class ", "func ", "type ", "const ", "var ")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\([^)]*\)|\S", re.ASCII)
_DOCUMENTS = ("md", "mdx", "mdc", "markdown")


def declared(line: str, language: Language) -> str | None:
    """The name that a line declares, by its words; None where it declares nothing that others see."""
    words = [m.group() for m in _TOKEN.finditer(line)]
    ends = {m.start(): m.end() for m in _TOKEN.finditer(line)}
    at = 0
    if language.lead:
        if words[:1] != [language.lead]:
            return None
        at = 1
        # A scope in parentheses touches its modifier.
        if language.kind == "rust" and words[1:2] and words[1].startswith("(") and len(words[1]) > 1:
            lead = next(iter(ends.values()))
            if line[lead : lead + 1] != "(":
                return None
            at = 2
    said = set()
    while words[at : at + 1] and words[at] in language.between and words[at] not in said:
        if words[at] == "default" and said:
            return None
        said.add(words[at])
        at += 1
    keyword = words[at] if at < len(words) else ""
    if keyword not in language.keywords or ("async" in said and keyword not in ASYNC_OF):
        return None
    at += 1
    if language.kind == "go" and keyword == "func" and words[at : at + 1] and words[at].startswith("(") and len(words[at]) > 1:
        at += 1
    name = words[at] if at < len(words) else ""
    if language.kind != "js-ts":
        name = name.split("$")[0]
    return name if language.public.match(name) else None


def lines_of(text: str) -> list[str]:
    """Lines by line feeds, without the carriage return before one; what follows the last line feed is a line only if it isn't empty."""
    rows = text.split("\n")
    return [r.removesuffix("\r") for r in (rows[:-1] if rows[-1] == "" else rows)]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def normal(symbol: str) -> str:
    """A heading or symbol by which it is asked for: ASCII letters and digits, blanks, hyphens and underscores, in lower case."""
    return " ".join("".join(c for c in symbol if (c.isascii() and c.isalnum()) or c.isspace() or c in "-_").lower().split())


def next_no_deeper(depths: list[int]) -> list[int | None]:
    """For each element the place of the next one that is no larger; None where there is none. Places wait on a stack until one comes."""
    out: list[int | None] = [None] * len(depths)
    waiting: list[int] = []
    for i, d in enumerate(depths):
        while waiting and depths[waiting[-1]] >= d:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def code_spans(text: str, language: Language) -> Iterator[tuple[str, str, int, int]]:
    """(name, line as written, first line, last line) of the declarations of a file, in order."""
    lines = lines_of(text)
    names = [declared(x, language) for x in lines]
    # Lines that end a span, and those that begin one and are none of them.
    marks = [i for i, x in enumerate(lines) if x.lstrip().startswith(STARTS) or names[i]]
    ending = [i for i in marks if lines[i].lstrip().startswith(STARTS)]
    depth = [_indent(lines[i]) for i in ending]
    following = dict(zip(ending, next_no_deeper(depth)))
    for i in marks:
        if names[i] is None:
            continue
        if i in following:
            end = following[i]
        else:
            end = next((k for k, j in enumerate(ending) if j > i and depth[k] <= _indent(lines[i])), None)
        yield names[i], lines[i], i + 1, ending[end] if end is not None else len(lines)


def heading_spans(text: str) -> Iterator[tuple[str, str, int, int]]:
    """The same for headings, each with the name asked for by; of equal names, one inside the other, the inner one is the span."""
    lines = lines_of(text)
    marks = []
    for i, line in enumerate(lines):
        t = line.strip()
        level = len(t) - len(t.lstrip("#"))
        if 1 <= level <= 6 and t[level : level + 1] == " ":
            marks.append((i, level, normal(t[level:].strip().strip("#").strip()), line))
    following = next_no_deeper([m[1] for m in marks])
    places: dict[str, list[int]] = {}
    for k, m in enumerate(marks):
        places.setdefault(m[2], []).append(k)
    for name, own in places.items():
        at = 0
        while at + 1 < len(own) and (following[own[at]] is None or own[at + 1] < following[own[at]]):
            at += 1
        end = following[own[at]]
        yield name, marks[own[at]][3], marks[own[at]][0] + 1, marks[end][0] if end is not None else len(lines)


_KEYS = {"json": re.compile(r'\s*"([^"]+)"\s*:(.*)', re.S), "yaml": re.compile(r"\s*([A-Za-z_][\w.-]*)\s*:(.*)", re.S | re.ASCII)}


def config_keys(text: str, ext: str) -> Iterator[tuple[str, int, str]]:
    """(dotted name, line, line as written) of the keys in a YAML or JSON text: below those that are open at its line's indentation."""
    pattern, waiting = _KEYS["json" if ext == "json" else "yaml"], []
    for i, line in enumerate(re.split(r"\r?\n", text)):
        trimmed = line.strip(" ")
        if not trimmed or trimmed.startswith("#") or (ext != "json" and trimmed.startswith("-")) or not (m := pattern.match(line)):
            continue
        indent, value = _indent(line), m[2].strip(" ")
        while waiting and waiting[-1][0] >= indent:
            waiting.pop()
        yield ".".join([k for _, k in waiting] + [m[1]]), i + 1, trimmed
        if value[:1] in ("{", "[") and value if ext == "json" else not value:
            waiting.append((indent, m[1]))


def nested_keys(files: DataFrame) -> DataFrame:
    """(path, line, name, signature) of the keys of YAML and JSON files (path, text), by their whole dotted path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, line, name, said) for path, text in zip(batch.column(0).to_pylist(), batch.column(1)) for name, line, said in config_keys(text.as_py() or "", path.rsplit(".", 1)[-1].lower())]
            types = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "line", "name", "signature"])

    return files.where(F.col("path").rlike(r"(?i)\.(?:ya?ml|json)$")).select("path", "text").mapInArrow(read, "path string, line int, name string, signature string")


def spans(files: DataFrame) -> DataFrame:
    """(path, kind, name, start_line, end_line, signature) of the declarations in code and the headings in Markdown, from files (path, text).

    A declaration spans the lines before the next one that is indented no deeper, a heading those before the next of its level or
    above. Headings go by their normal name, once each. A null text and files of other kinds have none; repeated rows repeat.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, ext = value.as_py() or "", (path or "").rsplit(".", 1)[-1].lower()
                found = heading_spans(text) if ext in _DOCUMENTS else code_spans(text, LANGUAGES[ext]) if ext in LANGUAGES else ()
                kind = "heading" if ext in _DOCUMENTS else LANGUAGES[ext].kind if ext in LANGUAGES else ""
                out += [(path, kind, name, first, last, line.strip()) for name, line, first, last in found]
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["path", "kind", "name", "start_line", "end_line", "signature"])

    return files.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(read, "path string, kind string, name string, start_line int, end_line int, signature string")


def symbol_span(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, symbol, start_line, end_line) of the asked symbols (path, symbol): a heading by its normal name, a declaration by its name as written,
    the first of several. What isn't there gives no row. Only asked files are read."""
    asked = wanted.select("path", "symbol").distinct()
    found = spans(files.join(asked.select("path").distinct(), "path", "left_semi"))
    key = F.when(is_markdown(F.col("path")), F.trim(F.regexp_replace(F.lower(F.regexp_replace("symbol", r"[^A-Za-z0-9\s_-]", "")), r"\s+", " "))).otherwise(F.col("symbol"))
    met = asked.withColumn("name", key).join(found.select("path", "name", "start_line", "end_line"), ["path", "name"])
    return met.groupBy("path", "symbol").agg(F.min(F.struct("start_line", "end_line")).alias("s")).select("path", "symbol", "s.*")
