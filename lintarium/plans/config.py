"""Configuration from TOML: unknown keys and severities are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from lintarium.functions.severity import SEVERITIES
from lintarium.functions.text import glob_regex

# The sections of a configuration file and their keys.
SECTIONS = {"general": {"exclude", "languages"}, "rules": None, "overrides": None, "dimensions": None, "output": {"format", "color"}}
RULE_KEYS = {"enabled", "threshold", "severity"}


@dataclass
class Config:
    exclude: tuple[str, ...] = ()
    thresholds: dict[str, int] = field(default_factory=dict)
    severities: dict[str, str] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()
    overrides: list[tuple[str, str, str]] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Config:
        doc = tomllib.loads(text)
        for name, table in doc.items():
            if name not in SECTIONS:
                raise ValueError(f"unknown section {name!r}")
            known = SECTIONS[name]
            if known is not None and (extra := set(table) - known):
                raise ValueError(f"unknown key {sorted(extra)[0]!r} in [{name}]")
        c = Config(exclude=tuple(doc.get("general", {}).get("exclude", ())))
        off = set()
        for rule, table in doc.get("rules", {}).items():
            if extra := set(table) - RULE_KEYS:
                raise ValueError(f"unknown key {sorted(extra)[0]!r} for rule {rule!r}")
            if "threshold" in table:
                c.thresholds[rule] = int(table["threshold"])
            if "severity" in table:
                c.severities[rule] = _severity(table["severity"])
            if table.get("enabled") is False:
                off.add(rule)
        c.disabled = frozenset(off)
        for glob, rules in sorted(doc.get("overrides", {}).items()):
            glob_regex(glob)
            c.overrides += [(rule, glob, _severity(s)) for rule, s in rules.items()]
        return c

    @staticmethod
    def load(start: str, name: str = "lintarium.toml") -> Config:
        """The configuration of the nearest folder upwards that has one, or the defaults."""
        at = Path(start).resolve()
        for folder in (at, *at.parents):
            if (folder / name).is_file():
                return Config.parse((folder / name).read_text())
        return Config()


def _severity(text: str) -> str:
    if text.lower() not in (*SEVERITIES, "ignore"):
        raise ValueError(f"unknown severity {text!r}")
    return text.lower()
