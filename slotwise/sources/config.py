"""Settings as one flat mapping from dotted names to values."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

Settings = dict[str, Any]


def flat(tree: Mapping[str, Any], above: str = "") -> Settings:
    """The leaves of nested mappings by their dotted names; an empty mapping is a leaf."""
    out: Settings = {}
    for name, value in tree.items():
        out |= flat(value, f"{above}{name}.") if isinstance(value, Mapping) and value else {f"{above}{name}": value}
    return out


def overlaid(settings: Settings, changes: Settings) -> Settings:
    """settings with each change in place of the entry of that name, of all entries below it, and of entries it stands below."""
    out = dict(settings)
    for name, value in changes.items():
        above = {name.rsplit(".", i)[0] for i in range(1, name.count(".") + 1)}
        out = {k: v for k, v in out.items() if k not in above and not k.startswith(f"{name}.")}
        out[name] = value
    return out


def section(settings: Settings, name: str) -> Settings:
    """The entries below a name, without it."""
    return {k[len(name) + 1 :]: v for k, v in settings.items() if k.startswith(f"{name}.")}


def assignments(arguments: Iterable[str]) -> Settings:
    """`name=value` arguments; a value that is JSON is read as JSON, any other is a string."""
    out: Settings = {}
    for argument in arguments:
        if "=" not in argument or argument.startswith("="):
            raise ValueError(f"not of the form name=value: {argument!r}")
        name, value = argument.split("=", 1)
        try:
            out[name] = json.loads(value)
        except ValueError:
            out[name] = value
    return out


def read_settings(path: str, *arguments: str) -> Settings:
    """A JSON file (or a YAML one, where a YAML library is installed) with `name=value` arguments laid over it."""
    with open(path, encoding="utf-8") as source:
        if path.endswith((".yaml", ".yml")):
            import yaml

            tree = yaml.safe_load(source) or {}
        else:
            tree = json.load(source)
    return overlaid(flat(tree), assignments(arguments))
