"""Configuration: layers of JSON, dotted keys, coercion by the default's type. Driver-side, small."""

from __future__ import annotations

import copy
import json
import os
import tempfile
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "detector": {"styleGuide": "microsoft", "ignoreRules": [], "ignoreFiles": [], "ignoreValues": {}, "ignoreReasons": {}, "ignoreSpans": {}, "zeroTolerance": [], "grammar": False, "lists": {}},
    "hook": {"maxFindings": 20, "grammar": False, "quiet": False}, "rules": [], "nudges": [], "glossary": {"file": "STYLE.md"},
}


def read(path: str | Path) -> dict:
    """A missing or invalid file is an empty object."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def merged(base: Any, over: Any) -> Any:
    """Objects merge, null deletes a key, anything else replaces."""
    if not isinstance(base, dict) or not isinstance(over, dict):
        return copy.deepcopy(over)
    out = {k: v for k, v in base.items() if k not in over or over[k] is not None}
    return {**out, **{k: merged(out.get(k), v) for k, v in over.items() if v is not None}}


def layers(*overlays: dict) -> dict:
    out: Any = DEFAULTS
    for o in overlays:
        out = merged(out, o)
    return out


def get(config: dict, path: str) -> Any:
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return None
        config = config[key]
    return config


def put(config: dict, path: str, value: Any) -> dict:
    head, _, rest = path.partition(".")
    inner = config.get(head)
    return {**config, head: put(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def known(config: dict, prefix: str = "") -> list[str]:
    out: list[str] = []
    for k, v in config.items():
        out += known(v, f"{prefix}{k}.") if isinstance(v, dict) and v else [f"{prefix}{k}"]
    return out


def coerced(text: str, default: Any) -> Any:
    """A command-line value in the type of the default."""
    if isinstance(default, bool):
        return text.strip().lower() in ("1", "true", "yes", "on", "y")
    if isinstance(default, int):
        return int(text)
    if isinstance(default, (list, dict)):
        try:
            found = json.loads(text)
        except ValueError:
            found = [x.strip() for x in text.split(",") if x.strip()]
        return found
    return text


def write(path: str | Path, config: dict) -> None:
    """Writes a layer as JSON: beside the file first, then in its place."""
    folder = Path(path).parent
    folder.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, suffix=".json", delete=False, encoding="utf-8") as f:
        json.dump(config, f, indent=2, ensure_ascii=False)
        f.write("\n")
    os.replace(f.name, path)


def with_item(config: dict, path: str, item: Any) -> dict:
    """A list at a dotted key with one more item; one that is there already stays once."""
    now = get(config, path) or []
    return config if item in now else put(config, path, [*now, item])


def without_item(config: dict, path: str, item: Any) -> dict:
    """A list at a dotted key without an item; items that are objects go by their name."""
    return put(config, path, [x for x in get(config, path) or [] if x != item and not (isinstance(x, dict) and x.get("name") == item)])


def settings(config: dict) -> dict[str, Any]:
    """What ``detect`` takes."""
    d = config["detector"]
    return {"style": d["styleGuide"], "ignore": tuple(d["ignoreRules"]), "zero": tuple(d["zeroTolerance"]), "overrides": dict(d["lists"])}
