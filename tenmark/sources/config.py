"""Layered settings: file, then environment, then flags, each over the one before.

The standard library reads both forms: a file is one for ``configparser``, with keys before the first section
allowed, and flags are options of ``argparse``. A key in ``[section]`` is the setting ``section_key`` where
there is one, else ``key``. An empty value is no value. An unknown key is an error wherever it stands.
"""

from __future__ import annotations

import argparse
import configparser
import textwrap
from collections.abc import Iterable, Mapping

_TOP = "settings before any section"


class BadSetting(ValueError):
    """An unknown key, or a value of the wrong form."""


class _Flags(argparse.ArgumentParser):
    def error(self, message):
        raise BadSetting(message)


class Settings:
    """Settings by name, of a fixed list of names."""

    def __init__(self, names: Iterable[str], prefix: str = "TENMARK_"):
        self.names, self.prefix, self.values = frozenset(names), prefix, {}

    def _layer(self, found: Mapping[str, str | None]) -> Settings:
        if unknown := sorted(set(found) - self.names):
            raise BadSetting(f"unknown settings: {', '.join(unknown)}")
        self.values.update({k: v for k, v in found.items() if v})
        return self

    def file(self, text: str) -> Settings:
        parser = configparser.ConfigParser(delimiters=("=",), comment_prefixes=("#",), default_section="", interpolation=None, strict=False)
        parser.optionxform = str
        flat = "\n".join(map(str.strip, textwrap.dedent(text).splitlines()))  # indented lines are settings too
        try:
            parser.read_string(f"[{_TOP}]\n{flat}")
        except configparser.Error as e:
            raise BadSetting(str(e)) from e
        qualified = {(section, key): f"{section}_{key}" for section in parser.sections() for key in parser[section]}
        return self._layer({name if name in self.names else key: unquoted(parser[section][key]) for (section, key), name in qualified.items()})

    def environment(self, env: Mapping[str, str]) -> Settings:
        return self._layer({name: env.get(self.prefix + name.upper()) for name in self.names})

    def flags(self, args: Iterable[str]) -> Settings:
        options = _Flags(add_help=False, allow_abbrev=False, argument_default=argparse.SUPPRESS)
        for name in sorted(self.names):
            options.add_argument(*dict.fromkeys((f"--{name}", f"--{name.replace('_', '-')}")), dest=name)
        return self._layer(vars(options.parse_args(list(args))))

    def flag(self, name: str, default: bool = False) -> bool:
        value = self.values.get(name)
        if value is None:
            return default
        low = value.strip().lower()
        if low not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise BadSetting(f"{name} is true or false")
        return low in ("1", "true", "yes", "on")

    def number(self, name: str, default: int) -> int:
        value = self.values.get(name)
        if value is None:
            return default
        if not value.strip().isdigit():
            raise BadSetting(f"{name} is a whole number")
        return int(value)

    def parts(self, name: str) -> list[str]:
        return [p for p in (x.strip() for x in self.values.get(name, "").split(",")) if p]

    def together(self, *names: str) -> bool:
        """Whether all are set; some without the others are an error."""
        there = [n for n in names if n in self.values]
        if there and len(there) < len(names):
            raise BadSetting(f"set all of {', '.join(names)}, or none")
        return bool(there)


def unquoted(value: str) -> str:
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value
