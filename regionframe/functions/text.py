"""Numbers as metadata text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """At most eight decimals, rounded down, without trailing zeros; ``null`` for null."""
    exact = x.cast("string").try_cast("decimal(38,12)")
    cut = F.floor(exact, F.lit(8)).cast("string")
    # eight decimals always stand there, so zeros at the end are behind the point
    short = F.rtrim(F.rtrim(cut, F.lit("0")), F.lit("."))
    return F.coalesce(F.when(F.isnan(x), F.lit("NaN")).otherwise(F.coalesce(short, x.cast("string"))), F.lit("null"))


def as_text(x: Column, kind: str) -> Column:
    return number_text(x) if kind == "double" else F.coalesce(x.cast("string"), F.lit("null"))


def as_number(x: Column) -> Column:
    """Text read as a number; null where it is none."""
    return F.trim(x).try_cast("double")
