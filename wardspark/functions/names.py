"""Name patterns of policies, and what a column's name alone says about it."""

from __future__ import annotations

import re

from wardspark.functions import patterns as P


def glob(pattern: str, value: str) -> bool:
    """``*`` and ``*.*`` match all; else a trailing ``.*``, a leading ``*.``, a trailing ``*``, or equality; no case."""
    pattern, value = pattern.strip().lower(), value.strip().lower()
    if pattern in ("*", "*.*"):
        return True
    if pattern.endswith(".*") or not pattern.startswith("*.") and pattern.endswith("*"):
        return value.startswith(pattern[:-1])
    return value.endswith(pattern[1:]) if pattern.startswith("*.") else pattern == value


def leaf(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower()


def column_matches(globs: list[str] | tuple[str, ...], column: str) -> bool:
    """A rule names a column by its full name, its last part, or by the last part of the rule."""
    names = (column.lower(), leaf(column))
    return any(glob(g, n) or leaf(g.strip()) == n for g in globs for n in names)


def label_by_name(column: str) -> str | None:
    """The label for all values of a column whose name says that it is private or secret, else None."""
    name = leaf(column)
    if re.search(P.SPLIT_ID_NAMES, name):
        return None
    if any(part in name for part in P.PII_NAMES):
        return P.PII
    return P.SECRET if re.search(P.SECRET_NAMES, name) else None
