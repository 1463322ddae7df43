"""Counting and aggregating what overlaps each region."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.functions import aggregates as A
from regionframe.model import FIXED, Dataset, c
from regionframe.plans import ranges
from regionframe.plans.metajoin import combined_meta, pairs, partnered, with_each


def map_overlaps(left: Dataset, right: Dataset, aggs: list[A.Agg] | None = None, joinby=None, count_name: str | None = None, left_name: str | None = None, right_name: str | None = None, bin_size: int = ranges.BIN) -> Dataset:
    """For each pair of samples and each left region: the number of right regions that overlap it, and aggregates of them.

    Regions without a match stay, with a count of 0.  Equal left regions become
    one whose counts add up.  Matches and the regions themselves meet in one
    grouping, so nothing is joined back.  Without ``joinby`` no region is copied
    before it matches; with it, left regions carry their partner samples into the
    join's key, so that those of other samples never meet.
    """
    aggs = aggs or []
    left_name, right_name = left_name or left.name or "left", right_name or right.name or "right"
    count = count_name or f"count_{left_name}_{right_name}"
    outputs = [*left.attributes, count, *(a.output for a in aggs)]
    if len(set(outputs)) < len(outputs):
        raise ValueError(f"two output attributes have one name: {', '.join(sorted({x for x in outputs if outputs.count(x) > 1}))}")
    kinds = {}
    for a in aggs:
        kinds[a.field] = right.kind(right.field(a.field)) if a.field else None
        A.check(a, A.REGION, kinds[a.field])
    fields = sorted({right.field(a.field) for a in aggs if a.field})
    found = pairs(left, right, joinby)
    mine = [c(x) for x in left.regions.columns]
    other = right.regions.select(*[c(x) for x in FIXED], *[c(f) for f in fields])

    paired, apart = partnered(left.regions, other, found) if joinby else (with_each(left.regions, left.meta, right.meta), other)
    met = ranges.overlap_join(paired, apart, bin_size, ("__exp",)) if joinby else ranges.overlap_join(left.regions, other, bin_size)
    met = met.select(*[c(x, "l").alias(x) for x in left.regions.columns], c("sample_id", "r").alias("__exp"), F.lit(True).alias("__hit"), *[c(f, "r").alias(f"__v:{f}") for f in fields])
    base = paired.select(*mine, "__exp", F.lit(False).alias("__hit"), *[F.lit(None).cast(right.regions.schema[f].dataType).alias(f"__v:{f}") for f in fields])
    rows = base.unionByName(met)
    value = lambda a: c(f"__v:{right.field(a.field)}") if a.field else None
    hit = c("__hit")
    columns = [F.count(F.when(hit, 1)).cast("double").alias(count)]
    columns += [A.column(a, kinds[a.field], value(a), hit).alias(a.output) for a in aggs]
    out = rows.groupBy(*mine, "__exp").agg(F.max(F.when(~hit, 1)).alias("__base"), *columns).filter("__base = 1")
    new = F.xxhash64(c("sample_id"), c("__exp")).alias("sample_id")
    regions = out.select(new, *[c(x) for x in FIXED[1:]], *[c(x) for x in outputs])
    return Dataset(regions, combined_meta(found, left, right, left_name, right_name), None)
