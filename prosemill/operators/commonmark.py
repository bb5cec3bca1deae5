"""Markdown structure by blocks: a stack of containers (quotes, list items, footnotes) over the lines, then links by a map of references.

A text is read once, line by line, inside the task that holds it; what leaves the task is a row of structure, not the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Outline(NamedTuple):
    """Levels and texts of headings in order, the number of code blocks, and the distinct link targets, sorted."""

    levels: list[int]
    headings: list[str]
    code_blocks: int
    links: list[str]


_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_MARKER = re.compile(r"([-+*]|(\d{1,9})[.)])( +|$)")
_NOTE = re.compile(r"\[\^([^\]\s]+)\]:")
_DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(
    r"""[ ]{0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)"""
    r"""(?:(?:[ \t]*\n[ \t]*|[ \t]+)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)"""
)
# Names of elements that begin a block of HTML.
_ELEMENTS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
#: Kinds of HTML blocks: what begins one, what ends it (None: a blank line), whether it may stand right behind a paragraph's line.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True), (re.compile("<!--"), re.compile("-->"), True), (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile("<![A-Za-z]"), re.compile(">"), True), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True), (re.compile(rf"</?(?:{'|'.join(_ELEMENTS)})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(r"""(?:<[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$"""), None, False),
]


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _cells(row: str) -> list[str]:
    """A table row's cells; a pipe behind a backslash divides nothing."""
    return re.split(r"(?<!\\)\|", re.sub(r"^\s*\||(?<!\\)\|\s*$", "", row))


class Blocks:
    """The open containers and the open leaf, fed line by line."""

    def __init__(self, text: str) -> None:
        self.containers: list[list] = []  # [kind, width of a list item's content, whether the item is still empty]
        self.leaf: tuple | None = None  # ("text", lines), ("fence", mark, length), ("code",), ("html", end), ("table",)
        self.headings: list[tuple[int, str]] = []
        self.code_blocks = 0
        self.inline: list[str] = []  # texts whose links count
        self.defined: dict[str, str] = {}
        for line in re.split(r"\r\n?|\n", text):
            self.feed(line.expandtabs(4))
        self.close()

    def close(self, level: int = 0) -> None:
        """Ends the leaf. A paragraph gives up the definitions at its head; with a level the rest is a heading."""
        if self.leaf and self.leaf[0] == "text":
            rest = "\n".join(self.leaf[1])
            while m := _DEFINITION.match(rest):
                if _label(m[1]):
                    self.defined.setdefault(_label(m[1]), m[2][1:-1] if m[2].startswith("<") else m[2])
                rest = rest[m.end() :]
            if rest.strip():
                self.inline.append(rest)
                if level:
                    self.headings.append((level, rest))
            elif level == 1:  # definitions alone: the underline is text
                self.leaf = ("text", ["==="])
                return
        self.leaf = None

    def feed(self, line: str) -> None:
        rest, kept = line, 0
        for c in self.containers:
            indent = len(rest) - len(rest.lstrip(" "))
            if c[0] == "quote":
                if indent > 3 or rest[indent : indent + 1] != ">":
                    break
                rest = rest[indent + 1 :]
                rest = rest[1:] if rest.startswith(" ") else rest
            elif not rest.strip():
                if c[2]:
                    break
            elif indent >= c[1]:
                rest = rest[c[1] :]
            else:
                break
            if rest.strip():
                c[2] = False
            kept += 1
        whole = kept == len(self.containers)
        if self.leaf and self.leaf[0] in ("fence", "html"):
            if whole:
                self.inside(rest)
                return
            self.leaf = None
        rest, fresh = self.open(rest, kept, whole)
        self.start(rest, whole and not fresh, kept, fresh)

    def inside(self, rest: str) -> None:
        kind, *more = self.leaf
        if kind == "fence":
            mark = rest.strip()
            if len(rest) - len(rest.lstrip(" ")) <= 3 and len(mark) >= more[1] and set(mark) == {more[0]}:
                self.leaf = None
        elif (more[0] is None and not rest.strip()) or (more[0] is not None and more[0].search(rest)):
            self.leaf = None

    def reach(self, kept: int) -> None:
        """Closes what the line isn't part of."""
        if kept < len(self.containers):
            self.close()
            del self.containers[kept:]

    def open(self, rest: str, kept: int, whole: bool) -> tuple[str, bool]:
        """Opens the containers that the line begins: (what is left of it, whether any was opened)."""
        fresh = False
        while True:
            indent = len(rest) - len(rest.lstrip(" "))
            body = rest[indent:]
            text_open = self.leaf is not None and self.leaf[0] == "text" and whole and not fresh
            if indent > 3 or not body:
                return rest, fresh
            if body.startswith(">"):
                self.reach(kept)
                self.close()
                self.containers.append(["quote", 0, False])
                rest = body[2:] if body[1:2] == " " else body[1:]
            elif (m := _NOTE.match(body)) and not text_open:
                self.reach(kept)
                self.close()
                self.containers.append(["note", 4, False])
                rest = body[m.end() :].lstrip(" ")
            elif (text_open and _UNDERLINE.match(body)) or _BREAK.match(body):
                return rest, fresh
            elif m := _MARKER.match(body):
                after = body[m.end() :]
                if text_open and (not after.strip() or (m[2] and m[2] != "1")):
                    return rest, fresh
                self.reach(kept)
                self.close()
                marker = len(m[1])
                gap = len(m[3]) if after.strip() and len(m[3]) <= 4 else 1
                self.containers.append(["item", indent + marker + gap, not after.strip()])
                rest = body[marker + gap :] if after.strip() else ""
            else:
                return rest, fresh
            fresh = True
            kept = len(self.containers)

    def start(self, rest: str, whole: bool, kept: int, fresh: bool) -> None:
        """The leaf that what is left of a line begins or goes on with."""
        indent = len(rest) - len(rest.lstrip(" "))
        body = rest[indent:]
        running = self.leaf is not None and self.leaf[0] == "text" and not fresh  # a paragraph that the line may lengthen
        settle = (lambda: None) if fresh else (lambda: self.reach(kept))
        if not body.strip():
            settle()
            if self.leaf and self.leaf[0] != "code":
                self.close()
            return
        if indent > 3 and not running:
            settle()
            if not (self.leaf and self.leaf[0] == "code"):
                self.close()
                self.code_blocks += 1
                self.leaf = ("code",)
            return
        if indent <= 3:
            if m := _ATX.match(body):
                settle()
                self.close()
                self.headings.append((len(m[1]), m[2] or ""))
                self.inline.append(m[2] or "")
                return
            if m := _FENCE.match(body):
                settle()
                self.close()
                self.code_blocks += 1
                mark = m[1] or m[3]
                self.leaf = ("fence", mark[0], len(mark))
                return
            for begin, end, anywhere in _HTML if body.startswith("<") else ():
                if begin.match(body) and (anywhere or not running):
                    settle()
                    self.close()
                    if end is None or not end.search(body):
                        self.leaf = ("html", end)
                    return
            if running and whole:
                if m := _UNDERLINE.match(body):
                    self.close(1 if m[1][0] == "=" else 2)
                    return
                if "|" in self.leaf[1][-1] + body and _DELIMITER.match(body) and len(_cells(body)) == len(_cells(self.leaf[1][-1])):
                    head = self.leaf[1].pop()
                    self.close()
                    self.inline += _cells(head)
                    self.leaf = ("table",)
                    return
            if _BREAK.match(body):
                settle()
                self.close()
                return
        if self.leaf and self.leaf[0] == "table" and whole:
            self.inline += _cells(body)
            return
        if running:  # also where containers weren't continued: a lazy line
            self.leaf[1].append(body)
            return
        settle()
        self.close()
        self.leaf = ("text", [body])


_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_TAG = re.compile(r"""</?[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>""", re.S)
_TITLE = r"""(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?"""
_INLINE = re.compile(rf"""\(\s*(?:(<(?:[^<>\n\\]|\\.)*>)|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))*)?){_TITLE}\s*\)""")
_LABEL_MOST = 1000  #: fixed value: characters of a reference's name
_FULL = re.compile(rf"\[((?:[^\[\]\\]|\\.){{0,{_LABEL_MOST}}})\]")
_EMPTY, _TICKS, _PLAIN = re.compile(r"\[\]"), re.compile("`+"), re.compile(r"[^\\`<\[\]!]+")


def link_targets(text: str, defined: dict[str, str]) -> Iterator[str]:
    """Targets of links in a paragraph, heading or cell: inline, by reference, and in angle brackets; images and code give none."""
    open_: list[list] = []  # [place behind the bracket, whether an image, whether it may still become a link]
    i, n = 0, len(text)
    unclosed: set[int] = set()  # lengths of runs of backticks that nothing closes from here on
    while i < n:
        if m := _PLAIN.match(text, i):
            i = m.end()
            continue
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            run = _TICKS.match(text, i).end() - i
            end = None if run in unclosed else re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, i + run)
            if end is None:
                unclosed.add(run)
            i = end.end() if end else i + run
        elif c == "<" and (m := _AUTO.match(text, i)):
            yield m[1]
            i = m.end()
        elif c == "<" and (m := _TAG.match(text, i)):
            i = m.end()
        elif c == "!" and text[i + 1 : i + 2] == "[":
            open_.append([i + 2, True, True])
            i += 2
        elif c == "[":
            open_.append([i + 1, False, True])
            i += 1
        elif c == "]" and open_:
            begin, image, live = open_.pop()
            i += 1
            if not live:
                continue
            target = None
            if m := _INLINE.match(text, i):
                target = m[1][1:-1] if m[1] else m[2] or ""
            elif (m := _FULL.match(text, i)) and m[1].strip():
                target = defined.get(_label(m[1]))
            if target is None:
                m = _EMPTY.match(text, i)
                target = None if text[begin : begin + 1] == "^" or i - begin > _LABEL_MOST else defined.get(_label(text[begin : i - 1]))
            if target is not None:
                i = m.end() if m else i
                if not image:
                    yield html.unescape(_ESCAPED.sub(r"\1", target))
                    for o in open_:
                        o[2] = o[2] and o[1]
        else:
            i += 1


def outline(text: str | None) -> Outline:
    """The structure of one text; a null or empty one has none."""
    b = Blocks(text or "")
    links = {t.strip() for piece in b.inline for t in link_targets(piece, b.defined)}
    return Outline([k for k, _ in b.headings], [" ".join(re.sub(r"[`*]", "", t).split()) for _, t in b.headings], b.code_blocks, sorted(links - {""}))


def outlines(files: DataFrame) -> DataFrame:
    """(path, levels, headings, code_blocks, links) of Markdown texts (path, text).

    Headings are those of ``#`` and of underlines, inside quotes, list items and footnotes too; code blocks are fenced or indented; links are inline
    ones, references with a definition anywhere in the text, and addresses in angle brackets. A null text has none of them; rows that repeat
    stay; an empty table gives none; other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [outline(t.as_py()) for t in part.column(1)]
                types = [pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate(types))], ["path", "levels", "headings", "code_blocks", "links"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(read, "path string, levels array<int>, headings array<string>, code_blocks int, links array<string>")


def conform(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, path, lang, issues): what each translation's structure lacks against its source's; an empty list where they agree.

    ``pairs`` has (source, path, lang). Only texts of a pair are read for their structure. A heading count that differs hides the levels.
    """
    needed = pairs.select(F.explode(F.array("source", "path")).alias("path")).distinct()
    made = outlines(files.join(needed, "path", "left_semi"))
    theirs = made.select(F.col("path").alias("source"), *[F.col(c).alias(f"s_{c}") for c in ("levels", "code_blocks", "links")])
    rows = pairs.join(theirs, "source").join(made.select("path", "levels", "code_blocks", "links"), "path")
    sequence = lambda c: F.array_join(F.transform(c, lambda k: F.concat(F.lit("h"), k)), " > ")
    lost = F.array_except("s_links", "links")
    issues = F.array_compact(
        F.array(
            F.when(F.size("s_levels") != F.size("levels"), F.format_string("heading count differs: source=%d translation=%d", F.size("s_levels"), F.size("levels"))).when(
                F.col("s_levels") != F.col("levels"), F.concat(F.lit("heading level sequence differs: source="), sequence("s_levels"), F.lit(" translation="), sequence("levels"))
            ),
            F.when(F.col("s_code_blocks") != F.col("code_blocks"), F.format_string("code block count differs: source=%d translation=%d", "s_code_blocks", "code_blocks")),
            F.when(F.size(lost) > 0, F.concat(F.lit("missing link target(s): "), F.array_join(lost, ", "))),
        )
    )
    return rows.select("source", "path", "lang", issues.alias("issues"))
