"""The analysis context of a document: masked text, sentences and markdown structure, made once and shared by all rules.

Masking and structure follow a line automaton (fences) and a union of overlapping ranges, which relational operators can't express
without one pass per document; it is one Arrow pass. All rules then run on its columns in the JVM. Offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from prosemill.functions.readability import counts_of_texts

HOLE = "\x01"  #: stands for each blanked byte in ``holed``: no space, so that nothing matches across a hole
WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"

#: vocab: runs of letters and digits, folded; present: the literals asked for that the folded text holds anywhere. Both decide
#: whether a rule's expression runs on a text at all. shouted: words that stand in capitals and small; titled: Title Case phrases that
#: also stand in lower case. lead: a list's number before a sentence in its line, where nothing else is; else empty. grade_*: the counts
#: of the reading grade. long_sentences: those of more than ``LONG`` words.
SCHEMA = (
    "masked string, holed string, untabled string, words int, raw_words int, grade_words int, grade_letters int, grade_syllables int, grade_sentences int, vocab array<string>, present array<string>, "
    "sentences array<struct<start:int,length:int,words:int,text:string,lead:string>>, long_sentences array<struct<start:int,length:int,words:int,text:string>>, "
    "headings array<struct<level:int,text:string,line:int,start:int,raw:string>>, "
    "items array<struct<line:int,start:int,line_start:int,marker:string,text:string,raw:string>>, "
    "links array<struct<text:string,target:string,start:int,length:int,image:boolean>>, "
    "bolds array<struct<text:string,start:int,length:int>>, "
    "lines array<struct<line:int,start:int,text:string,blank:boolean,table:boolean>>, "
    "fences array<struct<start:int,info:string>>, "
    "refs array<struct<id:string,start:int,length:int,line:int,used:boolean>>, breaks array<struct<line:int,start:int,length:int,heading_next:boolean>>, "
    "shouted array<struct<word:string,low:string,start:int>>, titled array<struct<phrase:string,start:int>>"
)
COLUMNS = tuple(re.findall(r"(?:^|, )(\w+) (?=string|int|array)", SCHEMA))
GRADED = ("grade_words", "grade_letters", "grade_syllables", "grade_sentences")
LONG = 20
PART_ROWS, PART_CHARS = 500, 2_000_000  #: texts that a task reads at once

# Words before a full stop that doesn't end a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc inc ltd co no fig al eg ie e.g i.e u.s u.k a.m p.m approx".split())

_PLAIN = re.compile("[a-z0-9]+")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_FRONT = re.compile(r"\A(---|\+\+\+)[ \t]*\n.*?\n\1[ \t]*(?:\n|\Z)", re.S)
_HOLES = [re.compile(r"(`{1,3})[^`\n]+?\1"), re.compile(r"<!--[\s\S]*?-->"), re.compile(r"\{\{[\s\S]*?\}\}"), re.compile(r"</?[a-zA-Z][^>\n]*>")]
_MARKS = ("`", "<", "~", "{{")
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"([ \t]*)([-*+]|\d+[.)])[ \t]+(.*)$")
_TARGET = r"\[([^\]]*)\]\(([^)\s]*)[^)]*\)"
_LINK, _IMAGE = re.compile("(?<!!)" + _TARGET), re.compile("!" + _TARGET)
_BOLD = re.compile(r"\*\*([^*\n]+)\*\*|__([^_\n]+)__")
_BREAK = re.compile(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*$")
_SEPARATOR = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$")
_REF = re.compile(r"\s{0,3}\[([^\]]+)\]:\s+\S")
_REF_USES = [re.compile(r"\]\[([^\]]+)\]"), re.compile(r"(?<!!)\[([^\]\[]+)\](?![\[(:])")]
_SHOUT = re.compile(r"\b[A-Z]{2,5}\b", re.A)
_TITLE = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b")
_ANY_WORD = re.compile(r"\w+")
# Words of a sentence's start that a Title Case phrase sheds.
TITLE_STOPS = frozenset("the a an this that these those it he she they we you i if when while for and but or not as at by in on to of is are was were be note tip see use run add get set so such each any all".split())
_END = re.compile(r"[.!?]+[\"')\]”’]?(\s+|$)")
_GAP, _NUMBER, _LEAD = re.compile(r"[\s(]"), re.compile(r"\d*[.)]?\s*"), re.compile(r"\s*\d+[.)]\s*")
_OF_SENTENCES = ("sentences", "long_sentences", "grade_sentences")
_LONGEST = max(map(len, ABBREVIATIONS))


def _ranges(text: str) -> list[tuple[int, int]]:
    """What masking blanks: front matter and fences first, then the union of four passes over what those leave."""
    if not any(m in text for m in _MARKS) and not text.startswith(("---", "+++")):
        return []
    out: list[tuple[int, int]] = []
    if m := _FRONT.match(text):
        out.append(m.span())
    at, fence, front = 0, None, out[0][1] if out else 0
    for line in text.split("\n"):
        end = at + len(line)
        m = _FENCE.match(line) if at >= front else None
        if fence is None and m:
            fence = (at, m[1][0], len(m[1]))
        elif fence and m and m[1][0] == fence[1] and len(m[1]) >= fence[2] and not m[2].strip():
            out.append((fence[0], end))
            fence = None
        at = end + 1
    if fence:
        out.append((fence[0], len(text)))
    base = _blank(text, out, " ", by_byte=False)
    return out + [m.span() for p in _HOLES for m in p.finditer(base)]


def _blank(text: str, ranges: list[tuple[int, int]], fill: str, by_byte: bool = True) -> str:
    """Ranges replaced by ``fill``, a mark for each UTF-8 byte (or each character); line feeds stay, so line numbers and byte offsets do too."""
    if not ranges:
        return text
    out, at = [], 0
    for a, b in _merged(ranges):
        out += [text[at:a], "".join(c if c == "\n" else fill * (len(c.encode("utf-8", "surrogatepass")) if by_byte else 1) for c in text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


class _Bytes:
    """Byte offsets of ascending code point offsets, each part of the text encoded once."""

    def __init__(self, text: str) -> None:
        self.text, self.plain, self.at, self.bytes = text, text.isascii(), 0, 0

    def __call__(self, i: int) -> int:
        if self.plain:
            return i
        if i < self.at:
            self.at = self.bytes = 0
        self.bytes += len(self.text[self.at : i].encode("utf-8", "surrogatepass"))
        self.at = i
        return self.bytes


_ALNUM, _JOINS = (np.isin(np.arange(256), list(cs)) for cs in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", b"'-"))


class _Words:
    """How many words (``WORD``) of a text begin before a place in it: in one pass, so that parts that cut no word are counted by a difference."""

    def __init__(self, text: str) -> None:
        a = np.frombuffer(text.encode() if text.isascii() else text.replace("’", "'").encode("ascii", "replace"), np.uint8)  # a byte a character
        alnum = _ALNUM[a]
        begins = alnum.copy()
        begins[1:] &= ~alnum[:-1]
        begins[2:] &= ~(_JOINS[a[1:-1]] & alnum[:-2])
        self.before = np.zeros(len(a) + 1, np.int32)
        np.cumsum(begins, out=self.before[1:])
        self.all = int(self.before[-1])

    def between(self, begins: list[int], ends: list[int]) -> list[int]:
        return (self.before[ends] - self.before[begins]).tolist() if begins else []


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def is_table_line(line: str) -> bool:
    return line.lstrip().startswith("|") or bool(_SEPARATOR.match(line)) or line.count("|") >= 2


def folded(text: str) -> str:
    """Case-folded as the JVM compares letters: what matches regardless of case is equal here."""
    return text.replace("İ", "i").casefold()


def context_of(text: str, wanted: tuple[str, ...] = COLUMNS, finder: Callable[[str], list[str]] = lambda low: []) -> dict:
    """The wanted columns of ``SCHEMA`` for one text, but for the counts of ``counts_of_texts``; ``finder`` gives the literals that a folded text holds."""
    ranges = _ranges(text)
    masked = _blank(text, ranges, " ")
    out: dict = {"masked": masked, "present": []}
    asks = lambda *names: any(n in wanted for n in names)
    if asks("holed"):
        out["holed"] = _blank(text, ranges, HOLE) if ranges else masked
    words = _Words(masked) if asks("words", "raw_words", *_OF_SENTENCES) else None
    if asks("words", "raw_words"):
        out["words"] = words.all
        out["raw_words"] = _Words(text).all if ranges and asks("raw_words") else words.all
    if asks("vocab", "present"):
        low = folded(masked)
        out["vocab"], out["present"] = list(set(_PLAIN.findall(low))) if asks("vocab") else [], finder(low)
    if asks("bolds"):
        pos = _Bytes(masked)
        out["bolds"] = [((m[1] or m[2]), pos(m.start()), _size(m[0])) for m in _BOLD.finditer(masked)] if "**" in masked or "__" in masked else []
    if asks("links"):
        pos = _Bytes(masked)
        found = sorted((m.start(), image, m) for image, p in ((True, _IMAGE), (False, _LINK)) for m in p.finditer(masked)) if "](" in masked else []
        out["links"] = [(m[1], m[2], pos(at), _size(m[0]), image) for at, image, m in found]
    if asks("fences"):
        out["fences"] = list(_fences(text))
    if asks("shouted"):
        out["shouted"] = list(_shouted(masked))
    if asks("lines", "untabled", "headings", "items", "breaks", "refs", "titled", *_OF_SENTENCES):
        _by_line(text, masked, bool(ranges), out, asks, words)
    return out


def _by_line(text: str, masked: str, holes: bool, out: dict, asks: Callable[..., bool], words: _Words | None) -> None:
    """Columns that follow the lines: structure, blocks and their sentences."""
    pos = _Bytes(masked)
    raw_lines = text.split("\n") if holes else None
    headings, items, blocks, breaks, refs, lines, tables = [], [], [], [], [], [], set()
    start, at, waiting = None, 0, []
    # Masking keeps bytes, not characters: where lines have holes, a place in the raw line is one in bytes.
    raw_part = lambda raw, line, a, b: line[a:b] if raw is line else raw.encode("utf-8", "surrogatepass")[_size(line[:a]) : _size(line[:b])].decode("utf-8", "surrogatepass")
    for i, line in enumerate(masked.split("\n")):
        raw = raw_lines[i] if holes else line
        mark, begin = line.strip()[:1], pos(at)  # what a line begins with says which structure it can be
        blank = not mark
        table = "|" in line and is_table_line(line)
        if table:
            tables.add(i)
        lines.append((i, begin, raw, blank, table))
        h = _HEADING.match(line) if mark == "#" else None
        item = _ITEM.match(line) if mark and mark in "-*+" or mark.isdecimal() else None
        if waiting and raw.strip():
            is_heading = bool(re.match(r"#[ #]", raw.lstrip()))
            breaks += [(*w, is_heading) for w in waiting]
            waiting = []
        if h:
            headings.append((len(h[1]), raw_part(raw, line, *h.span(2)), i, begin + _size(line[: h.start(2)]), raw))
        if item:
            items.append((i, begin + _size(line[: item.start(3)]), begin, item[2], raw_part(raw, line, *item.span(3)), raw))
        if not blank:
            if mark in "-*_" and _BREAK.match(line):
                waiting.append((i, begin, _size(raw)))
            if mark == "[" and (r := _REF.match(line)):
                refs.append((raw_part(raw, line, *r.span(1)).lower(), begin, _size(line), i))
        if (blank or h or item) and start is not None:
            blocks.append((start, at))
            start = None
        if item:
            blocks.append((at, at + len(line)))
        elif not blank and not h and start is None:
            start = at
        at += len(line) + 1
    if start is not None:
        blocks.append((start, len(masked)))
    used = {m[1].lower() for p in _REF_USES for m in p.finditer(masked)} if refs else set()
    out |= {"lines": lines, "headings": headings, "items": items, "breaks": breaks + [(*w, False) for w in waiting], "refs": [(*r, r[0] in used) for r in refs]}
    if asks("untabled"):
        out["untabled"] = "\n".join(" " * _size(x) if i in tables else x for i, x in enumerate(masked.split("\n"))) if tables else masked
    if asks(*_OF_SENTENCES):
        parts = _cut(masked, blocks, words)
        out["grade_sentences"] = len(parts)
        if asks("sentences"):
            out["sentences"] = list(_sentences(masked, parts, _Bytes(masked)))
        if asks("long_sentences"):
            out["long_sentences"] = [x[:4] for x in _sentences(masked, [p for p in parts if p[2] > LONG], _Bytes(masked))]
    if asks("titled"):
        out["titled"] = list(_titled(masked, {h[2] for h in headings} | tables))


def _fences(text: str) -> Iterator[tuple[int, str]]:
    """(start, info) of the fences that open; every second one closes."""
    if "```" not in text and "~~~" not in text:
        return
    opened, at = False, 0
    for line in text.split("\n"):
        body = line.lstrip()
        if body.startswith(("```", "~~~")):
            if not opened:
                yield at + _size(line) - _size(body), body.lstrip("`~").strip()
            opened = not opened
        at += _size(line) + 1


def _shouted(masked: str) -> Iterator[tuple[str, str, int]]:
    """(WORD, word, start): words of 2 to 5 capitals that also stand in small letters, with the first such place."""
    caps = {m[0].lower(): m[0] for m in _SHOUT.finditer(masked)}
    if caps:
        pos = _Bytes(masked)
        for m in _ANY_WORD.finditer(masked):
            if m[0] in caps:
                yield caps.pop(m[0]), m[0], pos(m.start())


def _titled(masked: str, left_out: set[int]) -> Iterator[tuple[str, int]]:
    """(phrase, start): Title Case phrases outside headings and tables that also stand in lower case; each phrase once."""
    pos, at, line, seen = _Bytes(masked), 0, 0, {}
    for m in _TITLE.finditer(masked):
        line += masked.count("\n", at, m.start())
        at = m.start()
        if line in left_out:
            continue
        words = m[0].split(" ")
        while words and words[0].lower() in TITLE_STOPS:
            words.pop(0)
        phrase = " ".join(words)
        low = phrase.lower()
        if len(words) < 2:
            continue
        if low not in seen:
            seen[low] = bool(re.search(rf"(?<![A-Za-z0-9]){low}(?![A-Za-z0-9])", masked))
        if seen[low]:
            seen[low] = False
            yield phrase, pos(m.end() - len(phrase))


def _cut(masked: str, blocks: list[tuple[int, int]], words: _Words) -> list[tuple[int, int, int]]:
    """(begin, end, words) of the sentences of blocks, which begin with a line each; what holds no word is none."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b in blocks:
        cursor = a
        for m in _END.finditer(masked, a, b):
            at, end = m.span()
            if masked[at] == ".":
                if at > a and end < b and masked[at - 1].isdigit() and masked[end].isdigit():
                    continue
                # The last word; of one that is longer than all abbreviations, its end.
                if _GAP.split(masked[max(cursor, at - _LONGEST - 1) : at])[-1].lower().rstrip(".") in ABBREVIATIONS:
                    continue
            begins.append(cursor)
            ends.append(end)
            cursor = end
        begins.append(cursor)
        ends.append(b)
    return [x for x in zip(begins, ends, words.between(begins, ends)) if x[2]]


def _sentences(masked: str, parts: list[tuple[int, int, int]], pos: _Bytes) -> Iterator[tuple]:
    """(start, length, words, text, lead) of sentences, in order."""
    line = seen = 0  # the start of the line that holds ``seen``
    for a, b, count in parts:
        text = masked[a:b]
        body = text.strip()
        first = a + len(text) - len(text.lstrip()) if text[0].isspace() else a
        line, seen = max(line, masked.rfind("\n", seen, first) + 1), first
        lead = None if masked[line].isalpha() else _LEAD.fullmatch(masked, line, _NUMBER.match(masked, first, first + len(body)).end())
        start = pos(a)
        yield start, pos(b) - start, count, body, lead[0] if lead else ""


def with_context(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = COLUMNS, literals: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the asked columns of ``SCHEMA``; a null text is an empty one. ``present`` looks for ``literals``, folded as by ``folded``."""
    wanted = tuple(c for c in COLUMNS if c in columns)
    added = StructType([f for f in StructType.fromDDL(SCHEMA).fields if f.name in wanted])
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS])
    at = source.columns.index(text)
    arrow = [pa.field(f.name, to_arrow_type(f.dataType)) for f in added.fields]

    graded = any(c in GRADED[:3] for c in wanted)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(literals)
        for batch in batches:
            for part in _parts(batch, at):
                rows = [context_of(v.as_py() or "", wanted, finder) for v in part.column(at)]
                counts = dict(zip(GRADED, counts_of_texts([r["masked"] for r in rows]))) if graded else {}
                new = [pa.array(counts[f.name] if f.name in counts else [r[f.name] for r in rows], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *wanted])

    return source.mapInArrow(parse, StructType([*source.schema.fields, *added.fields]))


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``PART_ROWS`` texts at most, that hold little more than ``PART_CHARS`` bytes (or one text)."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if i > start and (i - start == PART_ROWS or size + n > PART_CHARS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(batch) > start:
        yield batch.slice(start)


def _finder(literals: tuple[str, ...]) -> Callable[[str], list[str]]:
    """Which of the literals stand anywhere in a text: one pass over it, however many there are."""
    if not literals:
        return lambda low: []
    machine = ahocorasick.Automaton()
    for x in literals:
        machine.add_word(x, x)
    machine.make_automaton()
    return lambda low: list({x for _, x in machine.iter(low)})
