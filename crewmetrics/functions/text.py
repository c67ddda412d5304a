"""LIKE rules and code tables given as data, rendered as SQL conditions.

One parsed expression replaces dozens of column calls, and the plan is the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

FOLDS = {"upper": "upper({0})", "lower": "lower({0})", "asis": "{0}"}


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def like(column: str, pattern: str, fold: str = "asis") -> str:
    return f"{FOLDS[fold].format(column)} like {quoted(pattern)}"


def like_any(column: str, patterns: Iterable[tuple[str, str]]) -> str:
    """True if any (folding, pattern) matches; ``_`` and ``%`` are wildcards, NULL stays NULL."""
    return "(" + " or ".join(like(column, pattern, fold) for fold, pattern in patterns) + ")"


def like_none(column: str, patterns: Iterable[str], fold: str = "asis") -> str:
    """True if no pattern matches; a filter on it drops NULL names."""
    return " and ".join(f"not {like(column, pattern, fold)}" for pattern in patterns)


def in_list(column: str, values: Iterable[int]) -> str:
    return f"{column} in ({', '.join(str(int(v)) for v in values)})"


def lookup(column: str, table: Mapping[int, str | int]) -> str:
    """Value of a code in a small fixed table, NULL for other codes."""

    def literal(v) -> str:
        return quoted(v) if isinstance(v, str) else str(v)

    pairs = ", ".join(f"{key}, {literal(value)}" for key, value in table.items())
    return f"try_element_at(map({pairs}), {column})"
