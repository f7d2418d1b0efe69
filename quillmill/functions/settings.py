"""Nested settings of a run: dotted paths, merges, distributions, export targets. Small driver-side dictionaries."""

from __future__ import annotations

import copy
from typing import Any

DEFAULT_TARGETS = ("native", "segformer", "coco")


def get_path(settings: dict, path: str, default: Any = None) -> Any:
    at: Any = settings
    for key in path.split("."):
        if not isinstance(at, dict) or key not in at:
            return default
        at = at[key]
    return at


def set_path(settings: dict, path: str, value: Any) -> dict:
    """Sets a value in place; whatever is no dictionary on the way is replaced by one."""
    *way, last = path.split(".")
    at = settings
    for key in way:
        if not isinstance(at.get(key), dict):
            at[key] = {}
        at = at[key]
    at[last] = value
    return settings


def merged(base: dict, over: dict) -> dict:
    """A new dictionary: nested ones are merged, all other values (lists too) are taken from ``over``."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def nested(flat: dict[str, Any]) -> dict:
    """Dotted keys as a nested dictionary."""
    out: dict = {}
    for path, value in flat.items():
        set_path(out, path, value)
    return out


def shares(weights: dict[str, Any], keys: list[str] | None = None) -> dict[str, float]:
    """Positive numbers as shares of their sum, names trimmed and in lower case; then only ``keys``, missing ones 0."""
    good: dict[str, float] = {}
    for name, value in weights.items():
        try:
            number = float(value)
        except (TypeError, ValueError):
            continue
        if str(name).strip() and number > 0:
            good[str(name).strip().lower()] = number
    total = sum(good.values())
    out = {k: v / total for k, v in good.items()}
    return out if keys is None else {k: out.get(k, 0.0) for k in keys}


def export_targets(settings: dict, given: str = "") -> list[str]:
    """What the command line names, else what the settings name (a list, or a string with commas), else all three."""
    found = given if (given or "").strip() else settings.get("export_targets", list(DEFAULT_TARGETS))
    if isinstance(found, str):
        found = found.split(",")
    elif not isinstance(found, list):
        found = list(DEFAULT_TARGETS)
    return [str(x).strip().lower() for x in found if str(x).strip()] or ["native"]
