"""Syllables and the reading grade: as column expressions, and counted over the bytes of many texts at once."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words whose syllables the rules below get wrong.
EXCEPTIONS = {
    "every": 2, "business": 2, "different": 3, "comfortable": 3, "vegetable": 3, "february": 4, "area": 3, "idea": 3, "science": 2, "being": 2, "create": 2, "people": 2,
    "simile": 3, "queue": 1, "the": 1, "average": 3, "naive": 2, "real": 1, "cereal": 3,
}


def syllables(word: Column) -> Column:
    """Vowel groups of at most two, after silent endings; one more for a consonant before ``le`` and for a hiatus; 0 without letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = (
        F.when(w.endswith("es") & (F.length(w) > 3), F.regexp_replace(w, "(?<=[aeiouy])([^aeiouyl])es$", "$1"))
        .when(w.endswith("ed") & (F.length(w) > 3), F.regexp_replace(w, "ed$", ""))
        .when(w.endswith("e") & ~w.endswith("le") & (F.length(w) > 2), F.regexp_replace(w, "e$", ""))
        .otherwise(w)
    )
    groups = F.regexp_count(F.regexp_replace(stem, "^y", ""), F.lit("[aeiouy]{1,2}"))
    more = F.when(w.rlike("[^aeiouy]le$"), 1).otherwise(0) + F.when(w.rlike("ia|io|ua|eo"), 1).otherwise(0)
    table = F.create_map(*[F.lit(x) for kv in EXCEPTIONS.items() for x in kv])
    return F.when(w == "", 0).otherwise(F.coalesce(F.try_element_at(table, w), F.greatest(F.lit(1), groups + more)))


_ENDINGS = "(?:(?<=[aeiouy])([^aeiouyl ])es|(?<=[a-z]{2})ed|(?<=[a-z]{2})(?<!l)e)(?![a-z])"


def _by_rule(word: str) -> int:
    """What the rules alone say of a word of letters."""
    stem = re.sub("^y", "", re.sub(_ENDINGS, lambda m: m[1] or "", word))
    return max(1, len(re.findall("[aeiouy]{1,2}", stem)) + bool(re.search("[^aeiouy]le$", word)) + bool(re.search("ia|io|ua|eo", word)))


def syllables_of_text(text: Column) -> Column:
    """The sum of ``syllables`` over the words between white space, by counts over the whole text: no word is taken out of it."""
    w = F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")), "[^a-z ]", "")
    stems = F.regexp_replace(F.regexp_replace(w, _ENDINGS, "$1"), "(?<![a-z])y", "")
    count = lambda t, p: F.regexp_count(t, F.lit(p))
    # Words without a vowel in their stem count once.
    bare = count(w, "[a-z]+") - count(stems, "(?<![a-z])[^aeiouy ]*[aeiouy][a-z]*")
    total = count(stems, "[aeiouy]{1,2}") + count(w, "[^aeiouy ]le(?![a-z])") + count(w, "(?:ia|io|ua|eo)[a-z]*") + bare
    off: dict[int, list[str]] = {}
    for word, n in EXCEPTIONS.items():
        off.setdefault(n - _by_rule(word), []).append(word)
    return sum((count(w, f"(?<![a-z])(?:{'|'.join(ws)})(?![a-z])") * d for d, ws in off.items() if d), total)


#: White space outside ASCII, as the JVM's (?U)\\s has it.
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ALL, _LETTERS, _BLANKS = bytes(range(256)), b"abcdefghijklmnopqrstuvwxyz", b"\t\n\x0b\x0c\r "
_OTHERS = bytes(c for c in _ALL if bytes([c]).lower() not in {bytes([x]) for x in _LETTERS + _BLANKS})
_ALNUMS = _LETTERS + _LETTERS.upper() + b"0123456789"
#: Letters in lower case and one blank, with a deletion of the others; white space as a truth; vowels as one.
_LOWER = bytes(32 if c in _BLANKS else c for c in _ALL.lower())
_IS_BLANK, _IS_VOWEL = (bytes(c in cs for c in _ALL) for cs in (_BLANKS, b"aeiouy"))
_BLANK = 32


def _ascii(text: str) -> bytes:
    """A byte a character: a blank for white space, a mark for other characters outside ASCII; two of them have an ASCII letter as lower case."""
    return text.encode() if text.isascii() else _SPACES.sub(" ", text).replace("\u212a", "k").replace("\u0130", "i").encode("ascii", "replace")


def counts_of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space, letters and digits, and syllables of each text: the sums of ``syllables``, in passes over all texts' bytes."""
    parts = [_ascii(t) + b"\n" for t in texts]  # no word goes on in the next text
    said = [p.translate(_LOWER, _OTHERS) for p in parts]  # letters and blanks alone
    before = lambda sizes: np.cumsum([0, *sizes])
    letters = [len(p) - len(p.translate(None, _ALNUMS)) for p in parts]
    letters = [n if t.isascii() else n - t.count("\u212a") - t.count("\u0130") for n, t in zip(letters, texts)]
    blank = np.frombuffer(b"".join(parts).translate(_IS_BLANK), bool)
    words = np.diff(np.searchsorted(np.flatnonzero(blank[1:] > blank[:-1]) + 1, before(map(len, parts))))  # by their ends
    # Four blanks in front: a look at a word's last four letters stays inside.
    joined = b"    " + b"".join(said)
    at = before(map(len, said)) + 4
    w, vowel = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_IS_VOWEL), bool)
    edges = np.flatnonzero((w[1:] == _BLANK) != (w[:-1] == _BLANK)) + 1
    first, end = edges[::2].copy(), edges[1::2].copy()
    size, last, second, third = end - first, w[end - 1], w[end - 2], vowel[end - 3]
    # Stems: what an ending or a first y has of vowels doesn't count.
    before_e = (second == ord("e")) & (size > 3)
    es = before_e & (last == ord("s")) & vowel[end - 4] & ~third & (w[end - 3] != ord("l"))
    ed = before_e & (last == ord("d"))
    e = (last == ord("e")) & (second != ord("l")) & (size > 2)
    stem = vowel.copy()
    stem[end[es | ed] - 2] = False
    stem[end[e] - 1] = False
    stem[first[w[first] == ord("y")]] = False
    runs = np.flatnonzero(stem[1:] != stem[:-1]) + 1
    begins = runs[::2]
    # Words without a vowel in their stem count once, those with a hiatus once more.
    more = ((last == ord("e")) & (second == ord("l")) & (size > 2) & ~third).astype(np.int64)
    vowels, hiatus = np.cumsum(stem, dtype=np.int32), np.zeros(len(first), bool)
    more += vowels[end - 1] == vowels[first - 1]
    hiatus[np.searchsorted(first, _hiatus_at(w, np.flatnonzero(vowel[1:] & vowel[:-1])), "right") - 1] = True
    more += hiatus
    by_size: dict[int, np.ndarray] = {}
    for word, n in EXCEPTIONS.items():
        same = by_size[len(word)] if len(word) in by_size else by_size.setdefault(len(word), np.flatnonzero(size == len(word)))
        for k, c in enumerate(word.encode()):
            same = same[w[first[same] + k] == c]
        more[same] += n - _by_rule(word)
    sums = lambda places, values: np.diff(np.concatenate([[0], np.cumsum(values)])[np.searchsorted(places, at)])
    syllables = sums(begins, (runs[1::2] - begins + 1) // 2) + sums(first, more)
    return words.astype(np.int32), np.array(letters, np.int32), syllables.astype(np.int32)


def _hiatus_at(w: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Those of the places at which ia, io, ua or eo stand."""
    a, b = w[places], w[places + 1]
    return places[((a == ord("i")) | (a == ord("u"))) & (b == ord("a")) | ((a == ord("i")) | (a == ord("e"))) & (b == ord("o"))]


def with_grade(df: DataFrame) -> DataFrame:
    """``df``, a context with ``GRADED``, with grade: the mean of two formulas over words between white space, their letters and syllables, and sentences."""
    rows = df.withColumn("grade", F.struct(F.col("grade_words").alias("words"), F.col("grade_sentences").alias("sentences"), F.col("grade_syllables").alias("syllables"), F.col("grade_letters").alias("letters")))
    g = lambda k: F.col(f"grade.{k}")
    words, many = F.greatest(g("words"), F.lit(1)).cast("double"), F.greatest(g("sentences"), F.lit(1)).cast("double")
    grade = (0.39 * (words / many) + 11.8 * (g("syllables") / words) - 15.59 + 0.0588 * (g("letters") / words * 100.0) - 0.296 * (many / words * 100.0) - 15.8) / 2
    return rows.withColumn("grade", F.struct("grade.*", grade.alias("grade")))
