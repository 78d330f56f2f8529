"""Table and column names derived from free-text names.

Each rule exists twice: for a Python string (names in a schema) and for a string
column (names stored as data).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TO_UNDERSCORE = " -/"
_DROPPED = "()"
_NAME_TABLE = str.maketrans(_TO_UNDERSCORE, "_" * len(_TO_UNDERSCORE), _DROPPED)


def table_name(source: str, known: Mapping[str, str] | None = None) -> str:
    """Table name of a source: its known name, else its lower-case name with separators as ``_``."""
    source = source.strip()
    if known and source in known:
        return known[source]
    return source.lower().translate(_NAME_TABLE)


def clean_name(name: str) -> str:
    """Column name: like :func:`table_name`, and only ``[A-Za-z0-9_]`` survives."""
    return re.sub(r"[^A-Za-z0-9_]", "", table_name(name))


def table_name_expr(col: Column) -> Column:
    stripped = F.regexp_replace(col, r"^\s+|\s+$", "")
    return F.translate(F.lower(stripped), _TO_UNDERSCORE + _DROPPED, "_" * len(_TO_UNDERSCORE))


def clean_name_expr(col: Column) -> Column:
    return F.regexp_replace(table_name_expr(col), "[^A-Za-z0-9_]", "")


class NameCollision(ValueError):
    """Two source columns would get the same name."""


def target_names(columns: Iterable[str], mapping: Mapping[str, str] | None = None) -> list[str]:
    """New names for ``columns``: the mapped name (matched without case and outer space), else the
    cleaned one. Raises :class:`NameCollision` when two columns would end up alike."""
    wanted = {source.strip().lower(): target for source, target in (mapping or {}).items()}
    columns = list(columns)
    names = [wanted.get(c.strip().lower(), clean_name(c)) for c in columns]
    by_name: dict[str, list[str]] = {}
    for column, name in zip(columns, names):
        by_name.setdefault(name.lower(), []).append(column)
    clashes = {name: cols for name, cols in by_name.items() if len(cols) > 1}
    if clashes:
        raise NameCollision(f"columns share a target name: {clashes}")
    return names
