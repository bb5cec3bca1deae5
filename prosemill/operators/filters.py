"""Which documents are prose at all: path and text filters, and the reason for skipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = "ar bg cs da de el en en-gb en-us es et fi fr he hi hr hu id it ja ko lt lv ms nl no pl pt pt-br ro ru sk sl sv th tr uk vi zh zh-cn zh-tw".split()
SOURCE_LANGUAGES = ("en", "en-us", "en-gb")
SKIPPED_FOLDERS = (
    "node_modules .git dist build .next coverage testdata test-data fixtures __fixtures__ golden snapshots __snapshots__ target out vendor vendored 3rdparty thirdparty "
    "third_party third-party"
).split()
GENERATED = ("CHANGELOG", "HISTORY", "LICENSE", "NOTICE")
_LATIN, _OTHER = r"[A-Za-z\x{C0}-\x{FF}]", r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_markdown(path: Column) -> Column:
    return path.rlike(r"(?i)\.(?:md|markdown|mdx|mdc)$")


def in_skipped_folder(path: Column, more: tuple[str, ...] = ()) -> Column:
    """``more`` names folders of tools that keep their own files in a project."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in (*SKIPPED_FOLDERS, *more)]))


def is_generated(path: Column) -> Column:
    return F.upper(F.regexp_replace(basename(path), r"\.[^.]*$", "")).isin(*GENERATED) | (F.lower(basename(path)) == "llms.txt")


def is_non_latin(text: Column) -> Column:
    other = F.regexp_count(text, F.lit(_OTHER))
    return (other > 80) & (other * 3 > F.regexp_count(text, F.lit(_LATIN)))


def is_data_like(text: Column) -> Column:
    """A line of 2,000 bytes, or 200 words with hardly a sentence end."""
    words = F.regexp_count(text, F.lit(r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"))
    return F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) >= 2000) | ((words >= 200) & (F.regexp_count(text, F.lit("[.!?]")) * 100 < words))


def language_of(path: Column) -> Column:
    """The language that a path names: ``name.<lang>.ext``, a folder, or ``content.<lang>``; null without one."""
    langs = F.array(*[F.lit(x) for x in LANGUAGES])
    suffix = F.lower(F.regexp_extract(basename(path), r"\.([^.]+)\.[^.]+$", 1))
    parts = F.transform(F.split(F.lower(path), "/"), lambda c: F.regexp_replace(c, r"^content\.", ""))
    part = F.try_element_at(F.filter(parts, lambda c: F.array_contains(langs, c)), F.lit(1))
    return F.when(F.array_contains(langs, suffix), suffix).otherwise(part)


def is_translation(path: Column) -> Column:
    return F.coalesce(~language_of(path).isin(*SOURCE_LANGUAGES), F.lit(False))


def skip_reason(path: Column, text: Column) -> Column:
    return (
        F.when(is_generated(path), "generated file").when(is_translation(path), "translation").when(is_non_latin(text), "mostly non-Latin text")
        .when(is_data_like(text), "data, not prose").when(~text.rlike("[A-Za-z0-9]"), "no prose content")
    )
