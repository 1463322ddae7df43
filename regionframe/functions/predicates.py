"""Predicates over metadata and over regions.

Metadata: ('cmp', attribute, op, value), ('has', a), ('lacks', a), ('and', p, q),
('or', p, q), ('not', p); a sample satisfies a comparison if any of its pairs does.
Regions: the same shapes; a region comparison's left side is ('coord', name) or
('field', name), its value a number, a string or ('meta', attribute).
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionframe.functions.expressions import coordinate, meta_name
from regionframe.functions.text import as_number
from regionframe.model import Dataset, c

_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def names(attribute: Column, wanted: str) -> Column:
    """Whether an attribute is the wanted one, under any prefix."""
    return (attribute == wanted) | attribute.endswith("." + wanted)


def meta_holds(p) -> Column:
    """An aggregate over a sample's pairs."""
    head = p[0]
    if head == "and":
        return meta_holds(p[1]) & meta_holds(p[2])
    if head == "or":
        return meta_holds(p[1]) | meta_holds(p[2])
    if head == "not":
        return ~meta_holds(p[1])
    match = names(F.col("attribute"), p[1])
    if head == "has":
        return F.coalesce(F.bool_or(match), F.lit(False))
    if head == "lacks":
        return ~F.coalesce(F.bool_or(match), F.lit(False))
    _, _, op, value = p
    v = F.col("value")
    if isinstance(value, (int, float)):
        leaf = F.coalesce(_OPS[op](as_number(v), F.lit(float(value))), F.lit(op == "!="))
    elif op == "==":
        leaf = F.lit(True) if value == "*" else F.lower(v) == value.lower()
    elif op == "!=":
        leaf = F.lower(v) != value.lower()
    else:
        raise ValueError(f"{op} compares numbers; {p[1]} is compared with text")
    return F.coalesce(F.bool_or(match & leaf), F.lit(False))


def region_metas(p) -> set[str]:
    if p[0] in ("and", "or"):
        return region_metas(p[1]) | region_metas(p[2])
    if p[0] == "not":
        return region_metas(p[1])
    return {p[3][1]} if isinstance(p[3], tuple) else set()


def region_holds(p, ds: Dataset) -> Column:
    """A two-valued condition: comparisons with null are false."""
    head = p[0]
    if head == "and":
        return region_holds(p[1], ds) & region_holds(p[2], ds)
    if head == "or":
        return region_holds(p[1], ds) | region_holds(p[2], ds)
    if head == "not":
        return ~region_holds(p[1], ds)
    _, (side, name), op, value = p
    if side == "coord":
        x, kind = coordinate(name), "string" if name in ("chr", "chrom", "strand") else "double"
    else:
        x, kind = c(ds.field(name)), ds.kind(ds.field(name))
    if kind == "string" and op not in ("==", "!="):
        raise ValueError(f"{op} compares numbers; {name} holds text")
    if isinstance(value, tuple):
        y = c(meta_name(value[1]))
        y = as_number(y) if kind == "double" else y
    elif (kind == "string") != isinstance(value, str):
        raise ValueError(f"{name} holds {'text' if kind == 'string' else 'numbers'}; it is compared with {value!r}")
    else:
        y = F.lit(value)
    return F.coalesce(_OPS[op](x, y), F.lit(False))
