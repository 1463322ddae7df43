"""Pairs of regions by distance, direction and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.model import FIXED, Dataset, c
from regionframe.plans import ranges
from regionframe.plans.metajoin import combined_meta, of_samples, pair_id, pairs, partnered

BUILDERS = ("LEFT", "RIGHT", "LEFT_DISTINCT", "RIGHT_DISTINCT", "INT", "CONTIG", "CAT", "BOTH")
#: How far nearest neighbours are looked for where no distance bounds them.
MAX_DISTANCE = 100_000


def _holds(atom):
    kind = atom[0]
    d = F.col("__dist")
    if kind in ("DL", "DLE", "DG", "DGE"):
        n = atom[1]
        return {"DL": d < n, "DLE": d <= n, "DG": d > n, "DGE": d >= n}[kind]
    minus = c("strand", "l") == "-"
    before, after = c("right", "r") <= c("left", "l"), c("left", "r") >= c("right", "l")
    if kind == "UP":
        return F.when(minus, after).otherwise(before)
    if kind == "DOWN":
        return F.when(minus, before).otherwise(after)
    raise ValueError(f"no such condition: {kind}")


def _radius(first, second, max_distance: int) -> int:
    """The greatest distance a pair may have: bounds in front of MD count, else bounds behind it, else the default."""
    most = lambda atoms: [a[1] - (a[0] == "DL") for a in atoms if a[0] in ("DL", "DLE")]
    least = [a[1] for a in first if a[0] in ("DG", "DGE")]
    if most(first):
        return min(most(first))
    if most(second):
        return max(min(most(second)), max_distance)
    return max(least) + max_distance if least else max_distance


def join_distance(left: Dataset, right: Dataset, condition=(), joinby=None, on_attributes=(), output: str = "CONTIG", left_name: str | None = None, right_name: str | None = None, max_distance: int = MAX_DISTANCE, bin_size: int = ranges.BIN) -> Dataset:
    """``condition`` is a list of up to four of ('DL'|'DLE'|'DG'|'DGE', n), ('UP',), ('DOWN',), ('MD', k).

    Conditions in front of MD choose its candidates, those behind it filter the
    k nearest (ties at the k-th included).  Without a condition regions pair by
    equal ``on_attributes`` alone.
    """
    condition = [tuple(a) for a in condition]
    output = {"INTERSECT": "INT", "INTERSECTION": "INT"}.get(output.upper(), output.upper())
    if output not in BUILDERS:
        raise ValueError(f"no such output: {output}; there are {', '.join(BUILDERS)}")
    if len(condition) > 4:
        raise ValueError("a JOIN takes at most four distance conditions")
    if not condition and not on_attributes:
        raise ValueError("a JOIN needs a distance condition or attributes")
    if condition and not any(a[0] in ("DL", "DLE", "MD") for a in condition):
        raise ValueError("a JOIN needs an upper distance or MD")
    if not condition and output not in ("LEFT", "RIGHT", "LEFT_DISTINCT", "RIGHT_DISTINCT", "BOTH"):
        raise ValueError(f"a JOIN by attributes alone can't build {output}")
    if sum(a[0] == "MD" for a in condition) > 1:
        raise ValueError("a JOIN takes one MD")
    for a in on_attributes:
        if a.upper() not in ("CHR", "CHROM") and (left.field(a) != a or right.field(a) != a):
            raise ValueError(f"{a} is not an attribute of both")
    equal = [a for a in on_attributes if a.upper() not in ("CHR", "CHROM")]
    left_name, right_name = left_name or left.name or "left", right_name or right.name or "right"
    found = pairs(left, right, joinby)
    near = next((k for k, a in enumerate(condition) if a[0] == "MD"), len(condition))
    first, second = condition[:near], condition[near + 1 :]
    # with joinby only regions of paired samples meet, else those of all samples that have metadata
    x, y = partnered(left.regions, right.regions, found) if joinby else (of_samples(left.regions, left.meta), of_samples(right.regions, right.meta))
    keys = ("__exp",) if joinby else ()
    holds = [_holds(a) for a in first]
    if near < len(condition):
        met = ranges.nearest_join(x, y, _radius(first, second, max_distance), condition[near][1], holds, bin_size, equal, keys)
    else:
        met = ranges.near_join(x, y, _radius(first, second, max_distance), bin_size, equal, keys) if condition else ranges.equal_join(x, y, equal, keys)
        for h in holds:
            met = met.filter(h)
    met = met.withColumn("out_id", pair_id(c("sample_id", "l"), c("sample_id", "r")))
    for a in second:
        met = met.filter(_holds(a))
    regions = _built(met, left, right, output, left_name, right_name)
    if output in ("LEFT_DISTINCT", "RIGHT_DISTINCT"):
        side, key = (left, "ref_id") if output == "LEFT_DISTINCT" else (right, "exp_id")
        meta = found.join(side.meta.withColumnRenamed("sample_id", key), key).select(F.col("out_id").alias("sample_id"), "attribute", "value")
        return Dataset(regions.distinct(), meta, None)
    return Dataset(regions, combined_meta(found, left, right, left_name, right_name), None)


def _built(met, left: Dataset, right: Dataset, output: str, left_name: str, right_name: str):
    of = lambda f: [c(x, f).alias(x) for x in FIXED[1:]]
    xs = [c(a, "l").alias(f"{left_name}.{a}") for a in left.attributes]
    ys = [c(a, "r").alias(f"{right_name}.{a}") for a in right.attributes]
    new = F.col("out_id").alias("sample_id")
    if output == "LEFT_DISTINCT":
        return met.select(new, *of("l"), *[c(a, "l").alias(a) for a in left.attributes])
    if output == "RIGHT_DISTINCT":
        return met.select(new, *of("r"), *[c(a, "r").alias(a) for a in right.attributes])
    if output in ("LEFT", "RIGHT"):
        return met.select(new, *of("l" if output == "LEFT" else "r"), *xs, *ys)
    if output == "BOTH":
        there = [c("chrom", "r").alias(f"{right_name}.chr"), c("left", "r").cast("double").alias(f"{right_name}.start"), c("right", "r").cast("double").alias(f"{right_name}.stop"), c("strand", "r").alias(f"{right_name}.strand")]
        return met.select(new, *of("l"), *xs, *there, *ys)
    if output == "INT":
        met = met.filter((c("left", "l") < c("right", "r")) & (c("left", "r") < c("right", "l")))
        lo, hi = F.greatest(c("left", "l"), c("left", "r")), F.least(c("right", "l"), c("right", "r"))
        strand = F.when(c("strand", "l") == c("strand", "r"), c("strand", "l")).otherwise("*")
    else:
        lo, hi = F.least(c("left", "l"), c("left", "r")), F.greatest(c("right", "l"), c("right", "r"))
        strand = c("strand", "l")
    return met.select(new, c("chrom", "l").alias("chrom"), lo.alias("left"), hi.alias("right"), strand.alias("strand"), *xs, *ys)
