"""Casts that turn unreadable values into NULL, whatever the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_date(col: Column) -> Column:
    return col.try_cast("date")


def to_double(col: Column) -> Column:
    return col.try_cast("double")


def to_int(col: Column) -> Column:
    """Whole part of a number: ``'145.7'`` -> 145. Out of the int range -> NULL."""
    return col.try_cast("double").try_cast("int")


LENIENT_CASTS = {"date": to_date, "double": to_double, "int": to_int}


def lenient_cast(col: Column, type_name: str) -> Column:
    return LENIENT_CASTS[type_name](col)


def normalized(col: Column) -> Column:
    """Status values compare upper-case and without outer spaces."""
    return F.upper(F.trim(col))
