"""Format-preserving pseudonyms: validated personal numbers and dates are permuted, by key, within their own format."""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prosemill.llm.common import table

KEY_SETTING = "spark.prosemill.pii.key"
ROUNDS = 10
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\w)")
_CARD = re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w.-])(?:\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
_DATE = re.compile(r"(?<![\w./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?!(?![Tt][0-9])[\w/-])")
_WHOLE = re.compile(r"(?s:.*)")
_NEEDS = re.compile(r"[\d@]")
_FOREIGN = re.compile(r"(?![0-9])\d")  #: digits of other scripts

#: Lengths of IBANs by country, from the registry.
_IBAN_LENGTHS = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in names.split()
}


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over the next even number of bits, walked until it is back in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    name = tweak.encode()
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            data = bytes([i]) + name + b"|" + right.to_bytes((half + 7) // 8, "big")
            left, right = right, left ^ (int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=16).digest(), "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _walk(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool]) -> int:
    """The next valid value of the permutation's cycle: a permutation of the valid values."""
    while not valid(value := feistel(value, size, key, tweak)):
        pass
    return value


def _refill(shape: str, new: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _mod97(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _by_class(text: str, key: bytes, tweak: str) -> str:
    """Permutes letters and digits within texts of the same shape: same classes in the same places."""
    classes = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text if c.isalnum()]
    chars = [c for c in text if c.isalnum()]
    value, size = 0, 1
    for c, k in zip(chars, classes):
        value, size = value * len(k) + k.index(c), size * len(k)
    value, out = feistel(value, size, key, tweak + "".join(k[0] for k in classes)), []
    for k in reversed(classes):
        value, r = divmod(value, len(k))
        out.append(k[r])
    return _refill(text, "".join(reversed(out)))


def _email(m: re.Match, key: bytes) -> str | None:
    local, domain = m[0].rsplit("@", 1)
    return f"{_by_class(local, key, 'email@' + domain.lower())}@{domain}"


def _iban(m: re.Match, key: bytes) -> str | None:
    compact = m[0].replace(" ", "")
    if not 15 <= len(compact) <= 34 or _mod97(compact) != 1:
        return None
    body = _by_class(compact[4:], key, "iban" + compact[:2])
    check = 98 - _mod97(compact[:2] + "00" + body)
    return _refill(m[0], f"{compact[:2]}{check:02d}{body}")


#: Ranges of addresses with a use of their own, as (first address, bits that are free); a pseudonym stays in its range.
_RANGES = [(0x00000000, 24), (0x0A000000, 24), (0x64400000, 22), (0x7F000000, 24), (0xA9FE0000, 16), (0xAC100000, 20), (0xC0A80000, 16), (0xE0000000, 28), (0xF0000000, 28)]


def _range(value: int) -> tuple[int, int] | None:
    return next(((first, bits) for first, bits in _RANGES if value >> bits == first >> bits), None)


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    value = int.from_bytes(bytes(parts), "big")
    if own := _range(value):
        value = own[0] + feistel(value - own[0], 1 << own[1], key, f"ip{own[0]}")
    else:
        value = _walk(value, 1 << 32, key, "ip", lambda x: _range(x) is None)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = f"{feistel(int(digits[:-1]), 10**n, key, f'card{n}'):0{n}d}"
    return _refill(m[0], body + next(c for c in "0123456789" if luhn(body + c)))


def _valid_ssn(value: int) -> bool:
    area, rest = divmod(value, 10**6)
    return area not in (0, 666) and area < 900 and rest // 10**4 > 0 and rest % 10**4 > 0


def _ssn(m: re.Match, key: bytes) -> str | None:
    value = int(m[0].replace("-", ""))
    return _refill(m[0], f"{_walk(value, 10**9, key, 'ssn', _valid_ssn):09d}") if _valid_ssn(value) else None


def _valid_phone(value: int) -> bool:
    """Ten digits by the North American plan: an area from 2 on, and an exchange that doesn't begin with 0 (with 1 it is met in examples)."""
    return value // 10**9 >= 2 and value // 10**6 % 10 >= 1


def _phone(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    country, value = digits[:-10], int(digits[-10:])
    if country in ("", "1"):
        if not _valid_phone(value):
            return None
        new = _walk(value, 10**10, key, "phone", _valid_phone)
    elif country[0] == "0" or len(set(digits[-10:])) == 1:
        return None
    else:
        new = feistel(value, 10**10, key, "phone" + country)
    return _refill(m[0], f"{country}{new:010d}")


def _date(m: re.Match, key: bytes) -> str | None:
    """A date's new day is one with as many digits in day and in month, so each keeps its width; the three orders share one permutation."""
    if m[1]:
        orders = [(1, 3, 4)]
    else:  # month first with slashes where that is a date, else day first
        orders = [(8, 7, 5), (8, 5, 7)]
        if m[6] == "/":
            orders.reverse()
    for order in orders:
        y, mo, d = (int(m[k]) for k in order)
        try:
            day = datetime.date(y, mo, d).toordinal()
        except ValueError:
            continue
        if not _FIRST <= day <= _LAST:
            return None
        short = lambda x: ((t := datetime.date.fromordinal(_FIRST + x)).month < 10, t.day < 10)
        own = (mo < 10, d < 10)
        new = datetime.date.fromordinal(_FIRST + _walk(day - _FIRST, _LAST - _FIRST + 1, key, "date", lambda x: short(x) == own))
        by = dict(zip(order, (new.year, new.month, new.day)))
        return (m[2] or m[6]).join(f"{by[k]:0{len(m[k])}d}" for k in sorted(order))
    return None


def _card_spans(m: re.Match) -> list[tuple[int, int]]:
    """The whole match, then what is left of 13 digits at least between groups, the longest first."""
    gaps = [at for at in range(m.start(), m.end()) if m.string[at] in " -"]
    digits = lambda a, b: b - a - sum(a <= g < b for g in gaps)
    spans = [(a, b) for a in [m.start(), *[g + 1 for g in gaps]] for b in [*gaps, m.end()] if b - a >= 13 and digits(a, b) >= 13]
    return sorted(spans, key=lambda s: (-digits(*s), s))


def _iban_spans(m: re.Match) -> list[tuple[int, int]]:
    """The country's length if a group ends there, then the whole match; of an unknown country, all ends of groups, the last first."""
    ends = [m.end(), *[at for at in range(m.end() - 1, m.start(), -1) if m.string[at] == " "]]
    if (n := _IBAN_LENGTHS.get(m[0][:2])) is not None:
        ends = [at for at in ends if len(m.string[m.start() : at].replace(" ", "")) == n] + ends[:1]
    return [(m.start(), at) for at in ends]


#: What may be the value inside a match of a kind, in the order of trial; of other kinds only the match itself is tried.
SPANS: dict[str, Callable[[re.Match], list[tuple[int, int]]]] = {"iban": _iban_spans, "card": _card_spans}

#: In order of precedence: a later kind leaves alone what an earlier one has taken.
KINDS: list[tuple[str, re.Pattern, Callable[[re.Match, bytes], str | None]]] = [
    ("email", _EMAIL, _email), ("iban", _IBAN, _iban), ("ip", _IP, _ip), ("card", _CARD, _card), ("ssn", _SSN, _ssn), ("phone", _PHONE, _phone), ("date", _DATE, _date),
]


def _in_script(new: str, old: str) -> str:
    """A new value with the digits of the script that the old one has, place by place; where their lengths differ, those of its first digit."""
    zeros = [ord(c) - unicodedata.decimal(c) for c in old if c.isdecimal()]
    if set(zeros) <= {48}:
        return new
    at = [ord(c) - unicodedata.decimal(c) if c.isdecimal() else zeros[0] for c in old] if len(new) == len(old) else [zeros[0]] * len(new)
    return "".join(chr(z + int(c)) if "0" <= c <= "9" else c for c, z in zip(new, at))


def pseudonymized(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the spans (kind, start, end) of the values in the old text, by start."""
    if not _NEEDS.search(text):
        return text, []
    # Digits of all scripts are read as ASCII's, so that equal numbers are linked however they are written.
    whole, text = text, text.translate({ord(c): str(unicodedata.decimal(c)) for c in set(_FOREIGN.findall(text))}) if _FOREIGN.search(text) else text
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(0)
    for kind, pattern, new in KINDS:
        if kind == "email" and "@" not in text:
            continue
        at = 0
        while m := pattern.search(text, at):
            # A value may begin later in a match of which none is taken.
            at = m.start() + 1
            for start, end in SPANS[kind](m) if kind in SPANS else [m.span()]:
                if covered and any(covered[start:end]):
                    continue
                if (value := new(m if (start, end) == m.span() else _WHOLE.fullmatch(text, start, end), key)) is not None:
                    covered = covered or bytearray(len(text))
                    covered[start:end] = b"\1" * (end - start)
                    taken.append((start, end, kind, value))
                    at = end
                    break
    taken.sort()
    out, at = [], 0
    for a, b, _, value in taken:
        out += [whole[at:a], value if whole is text else _in_script(value, whole[a:b])]
        at = b
    return "".join([*out, whole[at:]]), [(k, a, b) for a, b, k, _ in taken]


def key_of(spark: SparkSession) -> bytes:
    """The session's key by ``spark.prosemill.pii.key``. Where it is unset, a random one: then values stay linked within one call alone."""
    key = spark.conf.get(KEY_SETTING, None)
    return hashlib.blake2b(key.encode()).digest() if key else secrets.token_bytes(64)


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the spans of what was replaced (in the old text) in ``spans``.

    A value is replaced only if it validates: check digits of cards and IBANs, ranges of numbers, phones and addresses, calendar
    dates from 1900 to 2099. Equal values of a kind get equal pseudonyms in every document under one key, different values different
    ones; separators, widths, the shape and the digits' script stay. International phones in other groups than 3, 3 and 4, IPv6 addresses and
    dates with a month's name are no kinds of this operator and stay. A null text stays null and has no spans; rows and other columns stay, but a column
    by the name of ``spans`` is replaced.
    """
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != spans.lower()])
    at = source.columns.index(text)
    schema = StructType([*source.schema.fields, *StructType.fromDDL(f"`{spans}` array<struct<kind:string,start:int,end:int>>").fields])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, found = [], []
            for value in batch.column(at):
                t = value.as_py()
                new, where = pseudonymized(t, key) if t else (t, [])
                texts.append(new)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in where])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*batch.schema.names, spans])

    return source.mapInArrow(replace, schema)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, and how many values of each were replaced."""
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_values"), F.array_join(F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
