"""Expressions over regions and over metadata.

A node is a tuple: ('num', x), ('str', s), ('null', type), ('field', name),
('coord', name), ('meta', attribute, type), ('neg', e), ('sqrt', e),
('call', name, e, ...) of a registered function, or (op, a, b) with op one of
+ - * /.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionframe.functions.text import as_number
from regionframe.model import COORDINATES, Dataset, c

#: Functions that users add: name -> (function of Columns, kinds of its arguments, kind of its result).
_FUNCTIONS: dict[str, tuple[Callable[..., Column], tuple[str, ...], str]] = {}


def register(name: str, make: Callable[..., Column], takes: tuple[str, ...] = ("double",), gives: str = "double") -> None:
    """Makes ``name`` a function of region expressions, in the API as ('call', name, e, ...) and in scripts as name(e, ...)."""
    if name.upper() in ("SQRT", "NULL", "META"):
        raise ValueError(f"{name} is built in")
    if not set(takes) | {gives} <= {"double", "string"}:
        raise ValueError("kinds are double and string")
    _FUNCTIONS[name.upper()] = (make, tuple(takes), gives)


def registered(name: str) -> bool:
    return name.upper() in _FUNCTIONS


def _function(e, kinds: list[str]):
    if not registered(e[1]):
        raise ValueError(f"no function {e[1]}; there are {', '.join(_FUNCTIONS) or 'none'}")
    make, takes, gives = _FUNCTIONS[e[1].upper()]
    if list(takes) != kinds:
        raise ValueError(f"{e[1]} takes ({', '.join(takes)}), not ({', '.join(kinds)})")
    return make, gives


#: What a metadata expression gives where an operand is no number.
NOT_A_NUMBER = "could not parse"


def coordinate(name: str) -> Column:
    """Coordinates by name; start and stop follow the strand."""
    return {
        "chr": c("chrom"), "chrom": c("chrom"), "strand": c("strand"), "left": c("left"), "right": c("right"),
        "start": F.when(c("strand") == "-", c("right")).otherwise(c("left")),
        "stop": F.when(c("strand") == "-", c("left")).otherwise(c("right")),
    }[name]


def walk(e):
    yield e
    for x in e[1:]:
        if isinstance(x, tuple):
            yield from walk(x)


def metas(e) -> set[str]:
    return {x[1] for x in walk(e) if x[0] == "meta"}


def meta_name(attribute: str) -> str:
    return f"__meta:{attribute}"


def region_kind(e, ds: Dataset) -> str:
    head = e[0]
    if head == "field":
        return ds.kind(ds.field(e[1]))
    if head == "coord":
        return "string" if e[1] in ("chr", "chrom", "strand") else "double"
    if head == "str":
        return "string"
    if head == "call":
        return _function(e, [region_kind(x, ds) for x in e[2:]])[1]
    if head in ("meta", "null"):
        return "string" if e[-1].upper() in ("STRING", "CHAR") else "double"
    return "double"


def region_column(e, ds: Dataset) -> Column:
    """Column over a region row; null where an operand is null, or a divisor is 0.

    Where start, stop or strand take part, + and - change places on the - strand.
    """
    flips = any(x[0] == "coord" and x[1] in ("start", "stop", "strand") for x in walk(e))
    return _region(e, ds, flips)


def _region(e, ds: Dataset, flips: bool) -> Column:
    head = e[0]
    if head == "num":
        return F.lit(float(e[1]))
    if head == "str":
        return F.lit(e[1])
    if head == "null":
        return F.lit(None).cast("double" if e[1].upper() in ("INTEGER", "DOUBLE", "LONG") else "string")
    if head == "field":
        return c(ds.field(e[1]))
    if head == "coord":
        x = coordinate(e[1])
        return x if e[1] in ("chr", "chrom", "strand") else x.cast("double")
    if head == "meta":
        x = c(meta_name(e[1]))
        return x if e[2].upper() in ("STRING", "CHAR") else as_number(x)
    if head == "call":
        make, gives = _function(e, [region_kind(x, ds) for x in e[2:]])
        return make(*(_region(x, ds, flips) for x in e[2:])).cast(gives)
    if region_kind(e[1], ds) == "string" or len(e) > 2 and region_kind(e[2], ds) == "string":
        raise ValueError("arithmetic needs numbers")
    a = _region(e[1], ds, flips)
    if head == "neg":
        return -a
    if head == "sqrt":
        return F.when(a >= 0, F.sqrt(a))
    b = _region(e[2], ds, flips)
    if head == "*":
        return a * b
    if head == "/":
        return F.try_divide(a, b)
    plain, other = (a + b, a - b) if head == "+" else (a - b, a + b)
    return F.when(c("strand") == "-", other).otherwise(plain) if flips else plain


def with_metas(ds: Dataset, names: set[str]):
    """Regions with a column for each metadata attribute: its sample's value, of several the smallest."""
    regions = ds.regions
    for name in sorted(names):
        one = ds.meta.filter(F.col("attribute") == name).groupBy("sample_id").agg(F.min("value").alias(meta_name(name)))
        # one value for each sample goes to every executor; a join by sample would put a sample's regions into one task
        regions = regions.join(F.broadcast(one), "sample_id", "left")
    return regions


def named_inputs(e) -> list[str]:
    return [x[1] for x in walk(e) if x[0] == "field"]


def meta_column(e, value: dict[str, Column]) -> Column:
    """Text of a metadata expression; ``value`` gives each input's text."""
    if e[0] == "str":
        return F.lit(e[1])
    if e[0] == "field":
        return value[e[1]]
    from regionframe.functions.text import number_text

    x = _meta_number(e, value)
    return F.when(x.isNull(), F.lit(NOT_A_NUMBER)).otherwise(number_text(x))


def _meta_number(e, value: dict[str, Column]) -> Column:
    head = e[0]
    if head == "num":
        return F.lit(float(e[1]))
    if head == "str":
        return F.lit(e[1]).try_cast("double")
    if head == "field":
        return as_number(value[e[1]])
    a = _meta_number(e[1], value)
    if head == "neg":
        return -a
    if head == "sqrt":
        return F.when(a >= 0, F.sqrt(a))
    b = _meta_number(e[2], value)
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[head]


def is_coordinate(name: str) -> bool:
    return name.lower() in COORDINATES
