"""Aggregates by name and by where they may stand.

``hit`` marks the rows that count: the range operators keep rows without a
match in the same grouping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionframe.functions.text import as_text

REGION = ("COUNT", "SUM", "MIN", "MAX", "AVG", "MEDIAN", "BAG", "BAGD")
EXTEND = (*REGION, "Q1", "Q2", "Q3", "STD")
META = ("COUNTSAMP", "SUM", "MIN", "MAX", "AVG", "MEDIAN", "STD", "BAG", "BAGD")
_TEXT = ("BAG", "BAGD")
_ANY_TYPE = ("COUNT", "COUNTSAMP", "BAG", "BAGD", "MIN", "MAX")


@dataclass(frozen=True)
class Custom:
    """An aggregate that a user adds: from a Column (null on rows that don't count) to an aggregate Column."""

    make: Callable[[Column], Column]
    surfaces: tuple[str, ...]
    #: 'double' or 'string': what its field must hold (None: either), and what it gives
    takes: str | None
    gives: str


_CUSTOM: dict[str, Custom] = {}
_SURFACES = {"region": REGION, "extend": EXTEND, "meta": META}


def register(name: str, make: Callable[[Column], Column], surfaces=("region", "extend", "meta"), takes: str | None = "double", gives: str = "double") -> None:
    """Makes ``name`` an aggregate of MAP, COVER and GROUP ('region'), EXTEND ('extend') or GROUP's metadata ('meta'), in the API and in scripts.

    ``make`` gets the field as a Column of which nulls don't count; so any aggregate that ignores nulls will do.
    """
    if name.upper() in {*REGION, *EXTEND, *META}:
        raise ValueError(f"{name} is built in")
    if not set(surfaces) <= set(_SURFACES) or takes not in (None, "double", "string") or gives not in ("double", "string"):
        raise ValueError("surfaces are region, extend and meta; kinds are double and string")
    _CUSTOM[name.upper()] = Custom(make, tuple(surfaces), takes, gives)


@dataclass(frozen=True)
class Agg:
    """``fn`` over ``field`` (None for COUNT and COUNTSAMP), named ``name``."""

    fn: str
    field: str | None = None
    name: str | None = None

    @property
    def output(self) -> str:
        return self.name or self.fn.lower()


def check(agg: Agg, surface: tuple[str, ...], kind: str | None) -> None:
    fn = agg.fn.upper()
    if fn in _CUSTOM:
        own = _CUSTOM[fn]
        if not any(_SURFACES[s] is surface for s in own.surfaces):
            raise ValueError(f"{agg.fn} is no aggregate here, but of {', '.join(own.surfaces)}")
        if agg.field is None:
            raise ValueError(f"{agg.fn} needs a field")
        if own.takes and kind and kind != own.takes:
            raise ValueError(f"{agg.fn} needs {own.takes} values, and {agg.field} holds {kind}")
        return
    if fn not in surface:
        raise ValueError(f"no aggregate {agg.fn} here; there are {', '.join(surface)}")
    if agg.field is None and fn not in ("COUNT", "COUNTSAMP"):
        raise ValueError(f"{agg.fn} needs a field")
    if kind == "string" and fn not in _ANY_TYPE:
        raise ValueError(f"{agg.fn} needs numbers, and {agg.field} holds text")


def is_text(agg: Agg, kind: str | None) -> bool:
    if agg.fn.upper() in _CUSTOM:
        return _CUSTOM[agg.fn.upper()].gives == "string"
    return agg.fn.upper() in _TEXT or (agg.fn.upper() in ("MIN", "MAX") and kind == "string")


def takes_text(agg: Agg) -> bool:
    own = _CUSTOM.get(agg.fn.upper())
    return own is not None and own.takes == "string"


def column(agg: Agg, kind: str | None, value: Column | None, hit: Column | None = None) -> Column:
    """The aggregate's Column; ``value`` is null on rows that are no hit."""
    fn = agg.fn.upper()
    if fn in _CUSTOM:
        return _CUSTOM[fn].make(value).cast(_CUSTOM[fn].gives)
    if fn == "COUNT":
        return F.count(F.lit(1) if hit is None else F.when(hit, 1)).cast("double")
    if fn in ("SUM", "MIN", "MAX", "AVG"):
        return {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}[fn](value)
    if fn == "STD":
        return F.coalesce(F.stddev_samp(value), F.when(F.count(value) > 0, F.lit(float("nan"))))
    if fn in ("MEDIAN", "Q1", "Q2", "Q3"):
        values = F.sort_array(F.collect_list(value))
        n = F.size(values)
        half = F.floor(n / 2)
        at = lambda i: F.get(values, i.cast("int"))
        if fn in ("MEDIAN", "Q2"):
            return at(F.floor((n - 1) / 2))
        i = F.floor(half / 2) if fn == "Q1" else half + F.floor(half / 2)
        return F.when((n % 2 == 0) & (i > 0), (at(i) + at(i - 1)) / 2).otherwise(at(i))
    text = F.coalesce(as_text_or_null(value, kind), F.lit("."))
    kept = text if hit is None else F.when(hit, text)
    bag = F.collect_list(kept) if fn == "BAG" else F.collect_set(kept)
    joined = F.array_join(F.sort_array(bag), ",")
    return F.when(F.size(bag) == 0, F.lit(".")).otherwise(joined)


def as_text_or_null(value: Column, kind: str | None) -> Column:
    return F.when(value.isNotNull(), as_text(value, kind or "string"))
