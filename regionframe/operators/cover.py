"""Where regions of a group of samples pile up: cover, flat, summit, histogram."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.functions import aggregates as A
from regionframe.model import Dataset, c
from regionframe.plans import ranges
from regionframe.plans.metajoin import groups

VARIANTS = ("cover", "flat", "summit", "histogram")
#: Bases per part of the two-level running sums.
PART = 1_000_000
KEYS = ("__group", "chrom", "strand")


def bound(b, n: str, low: bool) -> str:
    """SQL of a bound: a number, 'ANY', 'ALL', ('ALL/', k) or ('ALL+', k, m); ``n`` is the number of samples."""
    if isinstance(b, (int, float)):
        return f"{int(b)}L"
    if b == "ANY":
        return "1L" if low else "9223372036854775807L"
    if b == "ALL":
        return n
    if b[0] == "ALL/":
        return f"({n} DIV {int(b[1])})"
    if b[0] == "ALL+":
        return f"(({n} + {int(b[1])}) DIV {int(b[2])})"
    raise ValueError(f"no such bound: {b}")


def cover(ds: Dataset, low, high, groupby=None, aggs: list[A.Agg] | None = None, variant: str = "cover", bin_size: int = ranges.BIN, part: int = PART) -> Dataset:
    """Regions covered by between ``low`` and ``high`` regions of a group of samples.

    If any region has no strand, none counts; else each strand is covered alone.
    cover: maximal runs; flat: these, widened to what contributes; summit: the
    local maxima; histogram: runs of one depth.  Attributes: AccIndex (depth, or
    greatest depth), JaccardIntersect, JaccardResult, then aggregates of the
    contributing regions.
    """
    if variant not in VARIANTS:
        raise ValueError(f"no such variant: {variant}")
    aggs = aggs or []
    names = ["AccIndex", "JaccardIntersect", "JaccardResult", *(a.output for a in aggs)]
    if len(set(names)) < len(names):
        raise ValueError("two output attributes have one name")
    kinds = {}
    for a in aggs:
        kinds[a.field] = ds.kind(ds.field(a.field)) if a.field else None
        A.check(a, A.REGION, kinds[a.field])
    fields = sorted({ds.field(a.field) for a in aggs if a.field})

    if groupby:
        of = groups(ds.meta, groupby)
        regions = ds.regions.join(F.broadcast(of), "sample_id").withColumn("__group", c("group_id"))
        size = of.groupBy(F.col("group_id").alias("__group")).agg(F.count(F.lit(1)).alias("__n"))
        meta = ds.meta.join(of, "sample_id").select(c("group_id").alias("sample_id"), "attribute", "value").distinct()
    else:
        regions = ds.regions.withColumn("__group", F.lit(0).cast("long"))
        size = regions.groupBy("__group").agg(F.count_distinct("sample_id").alias("__n"))
        meta = ds.meta.select(F.lit(0).cast("long").alias("sample_id"), "attribute", "value").distinct()
    # one row: whether any region lacks a strand
    mixed = ds.regions.agg(F.coalesce(F.bool_or(c("strand") == "*"), F.lit(False)).alias("__mixed"))
    regions = regions.crossJoin(F.broadcast(mixed)).withColumn("strand", F.when(c("__mixed"), "*").otherwise(c("strand")))
    regions = regions.select(*KEYS, "left", "right", *[c(f) for f in fields])

    lo, hi = bound(low, "__n", True), bound(high, "__n", False)
    within = lambda d: f"({d} > 0 AND {d} BETWEEN {lo} AND {hi})"
    segs = ranges.segments(regions, KEYS, part).join(F.broadcast(size), "__group")
    if variant in ("cover", "flat"):
        found = ranges.islands(segs, KEYS, within("depth"), within("before"))
    else:
        on = within("depth")
        if variant == "summit":
            on += f" AND ((depth > before AND (after < depth OR NOT {within('after')})) OR (NOT {within('before')} AND after < depth))"
        found = segs.filter(on).select(*KEYS, c("pos").alias("left"), c("next").alias("right"), c("depth").alias("__top"))

    met = ranges.overlap_join(found, regions, bin_size, ("__group", "strand"), stranded=False)
    mine = [*KEYS, "left", "right", "__top"]
    met = met.select(*[c(x, "l").alias(x) for x in mine], c("left", "r").alias("__l"), c("right", "r").alias("__r"), *[c(f, "r").alias(f"__v:{f}") for f in fields])
    span = (F.max("__r") - F.min("__l")).cast("double")
    common = F.greatest(F.min("__r") - F.max("__l"), F.lit(0)).cast("double")
    columns = [F.min("__l").alias("__min"), F.max("__r").alias("__max"), span.alias("__span"), common.alias("__common")]
    columns += [A.column(a, kinds[a.field], c(f"__v:{ds.field(a.field)}") if a.field else None).alias(a.output) for a in aggs]
    out = met.groupBy(*mine).agg(*columns)
    flat = variant == "flat"
    left, right = (c("__min"), c("__max")) if flat else (c("left"), c("right"))
    regions = out.select(
        c("__group").alias("sample_id"), "chrom", left.alias("left"), right.alias("right"), "strand",
        c("__top").cast("double").alias("AccIndex"),
        F.try_divide((c("right") - c("left")).cast("double"), c("__span")).alias("JaccardIntersect"),
        F.try_divide(c("__common"), c("__span")).alias("JaccardResult"),
        *[c(a.output) for a in aggs],
    )
    return Dataset(regions, meta, None)
