"""Regular expressions of word lists, built on the driver for the JVM's engine (and, where it can say the same, for RE2)."""

from __future__ import annotations

from prosemill.functions.lists import LISTS

#: Unix lines and Unicode classes: what the rules mean by ``\\w``, ``\\s``, ``\\b`` and ``^`` in multi-line mode.
FLAGS, NOCASE = "(?dU)", "(?diU)"
_SPECIAL = set("\\.^$|?*+()[]{}-&~#")


def quoted(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def branches(entries: list[str], depth: int = 3) -> str:
    """Alternatives in their order, gathered by first characters as far as ``depth``: where a text is, an engine tries those alone that begin like it.

    Alternatives that begin with other characters exclude each other, so their order among each other says nothing. For patterns without case.
    """
    groups: dict[str, list[str]] = {}
    for e in entries:
        groups.setdefault(e[:1].casefold(), []).append(e)
    if not depth or len(groups) == len(entries):
        return "|".join(map(quoted, entries))
    return "|".join(quoted(es[0]) if len(es) == 1 else f"{quoted(es[0][:1])}(?:{branches([e[1:] for e in es], depth - 1)})" if first else "" for first, es in groups.items())


def phrases(entries: list[str]) -> str:
    """Longest first, not inside a run of ASCII word characters."""
    body = branches(sorted(dict.fromkeys(entries), key=lambda e: -len(e.encode())))
    return f"{NOCASE}(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"


def anywhere(entries: list[str], *more: str) -> str:
    """Entries wherever they stand, inside words too, and further expressions."""
    return f"{NOCASE}(?:{'|'.join([*map(quoted, entries), *more])})"


def words(entries: list[str]) -> str:
    return rf"{NOCASE}\b(?:{'|'.join(map(quoted, entries))})\b"


def at_line_start(entries: list[str]) -> str:
    return rf"(?diUm)^[ \t>]*(?:{'|'.join(map(quoted, entries))})\b"


def entries_of(list_id: str, overrides: dict | None = None) -> tuple:
    """Entries of a list: an override replaces the default; a malformed one is ignored, an empty one switches the list off."""
    default = LISTS[list_id]
    new = (overrides or {}).get(list_id)
    if not isinstance(new, (list, tuple)):
        return default.entries
    shape = {"words": lambda e: isinstance(e, str), "phrases": lambda e: isinstance(e, str), "map": lambda e: _texts(e, 2), "groups": lambda e: isinstance(e, (list, tuple)) and all(isinstance(x, str) for x in e), "weighted": lambda e: isinstance(e, (list, tuple)) and len(e) == 3 and _texts(e[:2], 2) and isinstance(e[2], (int, float))}[default.kind]
    good = tuple(e if isinstance(e, str) else tuple(e) for e in new if shape(e))
    return good if good or not new else default.entries


def _texts(e, n: int) -> bool:
    return isinstance(e, (list, tuple)) and len(e) == n and all(isinstance(x, str) for x in e)


def keys_of(list_id: str, overrides: dict | None = None) -> list[str]:
    kind = LISTS[list_id].kind
    return [e if kind in ("words", "phrases") else e[0] for e in entries_of(list_id, overrides)]
