"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import chat, classifier, decontam, licenses, lines, mixing, neardup, rules, secrets, tokenbin

_MODULES = (chat, classifier, decontam, licenses, lines, mixing, neardup, rules, secrets, tokenbin)


def _named() -> dict[str, tuple]:
    return {name: (getattr(m, name), getattr(m, "SQL", None)) for m in _MODULES for name in vars(m) if name.startswith("op") and name[2].isdigit()}


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in sorted(_named().items(), key=lambda x: int(x[0][2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _named().items() if sql}
