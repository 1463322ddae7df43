"""Range joins as equi-joins on genome bins, and coverage as a two-level sweep.

A region is put in every bin that it touches; two regions meet in each bin
they share and are kept in the first one only, so results do not depend on the
bin size.  The equi key lets Spark plan a hash or sort-merge join with the
inequalities as a residual, and split skewed bins at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionframe.model import FIXED, c

#: Bases per bin where a caller names none.
BIN = 10_000


def compatible(x: str, y: str) -> Column:
    """Strands match, or one of them is unknown."""
    a, b = c("strand", x), c("strand", y)
    return (a == "*") | (b == "*") | (a == b)


def _floor(x: Column, size: int) -> Column:
    return F.floor(x / F.lit(size))


def binned(df: DataFrame, size: int, margin: int = 0) -> DataFrame:
    """``df`` with __first (first bin) and one row for each __bin its range touches, widened by ``margin``."""
    first = _floor(c("left") - margin, size)
    last = _floor(F.greatest(c("left"), c("right") - 1) + margin, size)
    return df.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlap_join(left: DataFrame, right: DataFrame, size: int = BIN, keys: tuple[str, ...] = (), stranded: bool = True) -> DataFrame:
    """All pairs of overlapping rows, as frames ``l`` and ``r``; ``keys`` are further columns that must agree."""
    x, y = binned(left, size).alias("l"), binned(right, size).alias("r")
    on = (c("chrom", "l") == c("chrom", "r")) & (c("__bin", "l") == c("__bin", "r"))
    for k in keys:
        on &= c(k, "l") == c(k, "r")
    on &= (c("left", "l") < c("right", "r")) & (c("left", "r") < c("right", "l"))
    on &= c("__bin", "l") == F.greatest(c("__first", "l"), c("__first", "r"))
    return x.join(y, on & compatible("l", "r") if stranded else on)


def distance() -> Column:
    """Gap between frames ``l`` and ``r``: 0 if they touch, negative if they overlap."""
    gap = F.least(F.abs(c("left", "l") - c("right", "r")), F.abs(c("left", "r") - c("right", "l")))
    apart = (c("right", "l") < c("left", "r")) | (c("right", "r") < c("left", "l"))
    return F.when(apart, gap).otherwise(-gap)


def near_join(left: DataFrame, right: DataFrame, radius: int, size: int = BIN, on_attributes=(), keys: tuple[str, ...] = ()) -> DataFrame:
    """All strand-compatible pairs at a distance of at most ``radius``, with __dist; frames ``l`` and ``r``; ``keys`` must agree.

    Bins are at least as wide as the radius, so the widened left side touches few of them.
    """
    size = max(size, radius, 1)
    x, y = binned(left, size, max(radius, 0) + 1).alias("l"), binned(right, size).alias("r")
    on = (c("chrom", "l") == c("chrom", "r")) & (c("__bin", "l") == c("__bin", "r"))
    for k in keys:
        on &= c(k, "l") == c(k, "r")
    on &= c("__bin", "l") == F.greatest(c("__first", "l"), c("__first", "r"))
    on &= compatible("l", "r")
    for a in on_attributes:
        on &= c(a, "l").eqNullSafe(c(a, "r"))
    return x.join(y, on & (distance() <= radius)).withColumn("__dist", distance())


#: Up to this MD, candidates are cut by an aggregate before they are ranked.
_SLOTTED = 16


def nearest_join(left: DataFrame, right: DataFrame, radius: int, nearest: int, holds=(), size: int = BIN, on_attributes=(), keys: tuple[str, ...] = ()) -> DataFrame:
    """Of the pairs that near_join finds and ``holds`` (Columns over them and __dist) keeps, those of each left region's ``nearest`` right ones of each sample.

    Ties at the last place are kept; equal left regions are ranked as one.  A left
    region stays whole in the bin of its start, one of bins that are as much larger as
    it is longer, and right regions go to all bins from which they are in reach.  So
    all candidates of a region meet in one task and are never shuffled or sorted: they
    are first aggregated to a bound of the distance, then pairs within it are built.
    """
    size = max(size, radius, 1)
    margin, unit = max(radius, 0) + 1, max(size // 8, 1)
    steps = F.floor((c("right") - c("left") - 1) / F.lit(unit))
    x = left.withColumn("__level", F.when(steps > 0, F.length(F.bin(steps))).otherwise(0))
    # one row: the levels that occur
    levels = x.agg(F.collect_set("__level").alias("__levels"))
    y = right.crossJoin(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).drop("__levels")
    span, reach = F.expr(f"shiftleft({size}L, __level)"), F.expr(f"shiftleft({unit}L, __level)")
    x = x.withColumn("__home", F.floor(c("left") / span))
    y = y.withColumn("__home", F.explode(F.sequence(F.floor((c("left") - margin - reach) / span), F.floor((F.greatest(c("left"), c("right") - 1) + margin) / span))))
    place = ["chrom", "__level", "__home", *keys]
    mine = [c(n) for n in x.columns]
    x = x.repartition(*place).groupBy(*mine).agg(F.count(F.lit(1)).alias("__same"))
    y = y.repartition(*place)

    def met(a: DataFrame, *more: Column) -> DataFrame:
        on = compatible("l", "r") & (distance() <= radius)
        for k in place:
            on &= c(k, "l") == c(k, "r")
        for k in on_attributes:
            on &= c(k, "l").eqNullSafe(c(k, "r"))
        for h in more:
            on &= h
        out = a.alias("l").join(y.alias("r"), on).withColumn("__dist", distance())
        for h in holds:
            out = out.filter(h)
        return out

    found = met(x).select(*[c(n, "l").alias(n) for n in x.columns], c("sample_id", "r").alias("__with"), "__dist", F.pmod(F.hash(c("left", "r"), c("right", "r")), F.lit(2 * nearest)).alias("__slot"))
    if nearest == 1:
        bound = F.min("__dist")
    elif nearest <= _SLOTTED:
        # the k-th smallest of the least distances of disjoint sets is no less than the k-th smallest distance
        least = F.array_sort(F.array_compact(F.array(*[F.min(F.when(F.col("__slot") == k, F.col("__dist"))) for k in range(2 * nearest)])))
        bound = F.coalesce(F.get(least, F.ceil(F.lit(nearest) / F.first("__same")).cast("int") - 1), F.max("__dist"))
    else:
        bound = F.max("__dist")
    bounds = found.groupBy(*mine, "__same", "__with").agg(bound.alias("__bound"))
    out = met(bounds, c("__with", "l") == c("sample_id", "r"), distance() <= c("__bound", "l"))
    if nearest > 1:
        region = [*[c(k, "l") for k in place], *[c(n, "l") for n in left.columns], c("__with", "l")]
        # the hash in front lets rows be sorted by one number; the columns behind it decide what is one region
        w = Window.partitionBy(F.xxhash64(*region), *region).orderBy("__dist")
        out = out.withColumn("__rank", F.rank().over(w)).filter((F.col("__rank") - 1) * c("__same", "l") < nearest)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), c("__same", "l"))))


def equal_join(left: DataFrame, right: DataFrame, on_attributes, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs on one chromosome with equal attributes, whatever their distance; ``keys`` must agree."""
    x, y = left.alias("l"), right.alias("r")
    on = (c("chrom", "l") == c("chrom", "r")) & compatible("l", "r")
    for k in keys:
        on &= c(k, "l") == c(k, "r")
    for a in on_attributes:
        on &= c(a, "l").eqNullSafe(c(a, "r"))
    return x.join(y, on).withColumn("__dist", distance())


def segments(regions: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """Depth of ``regions`` along each key: keys, pos, next, depth, before, after, __part.

    Starts and stops are summed by position; positions where they cancel are
    dropped.  Running sums have two levels, so that one large chromosome is
    spread over parts of ``size`` bases: each part's total first, then the
    positions within the part.
    """
    # both ends of a region come from one scan
    ends = F.array(F.struct(c("left").alias("pos"), F.lit(1).alias("d")), F.struct(c("right").alias("pos"), F.lit(-1).alias("d")))
    rows = regions.select(*[c(x) for x in keys], F.explode(ends).alias("__end")).select(*keys, "__end.pos", "__end.d")
    events = rows.groupBy(*keys, "pos").agg(F.sum("d").alias("d")).filter("d != 0").withColumn("__part", _floor(c("pos"), size))
    by = ", ".join(f"`{x}`" for x in keys)
    parts = events.groupBy(*keys, "__part").agg(F.sum("d").alias("total"), F.min("pos").alias("first"), F.min_by("d", "pos").alias("first_d"))
    whole = f"OVER (PARTITION BY {by} ORDER BY __part"
    parts = parts.select(*keys, "__part", F.expr(f"coalesce(sum(total) {whole} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("base"), F.expr(f"lead(first) {whole})").alias("next_first"), F.expr(f"lead(first_d) {whole})").alias("next_d"))
    inner = f"OVER (PARTITION BY {by}, __part ORDER BY pos"
    out = events.join(parts, [*keys, "__part"]).select(
        *keys, "__part", "pos", "d",
        F.expr(f"base + sum(d) {inner} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").alias("depth"),
        F.expr(f"coalesce(lead(pos) {inner}), next_first)").alias("next"),
        F.expr(f"coalesce(lead(d) {inner}), next_d, 0)").alias("next_d"),
    )
    return out.select(*keys, "__part", "pos", "next", "depth", (F.col("depth") - F.col("d")).alias("before"), (F.col("depth") + F.col("next_d")).alias("after")).filter("next IS NOT NULL")


def islands(segs: DataFrame, keys: tuple[str, ...], valid: str, valid_before: str) -> DataFrame:
    """Runs of adjoining segments for which ``valid`` (SQL) holds: keys, left, right, __top (greatest depth).

    ``valid_before`` is the same test of the segment before.  Runs are numbered
    in two levels, as depths are.
    """
    by = ", ".join(f"`{x}`" for x in keys)
    on = segs.filter(valid).withColumn("__new", F.expr(f"CASE WHEN {valid_before} THEN 0 ELSE 1 END"))
    parts = on.groupBy(*keys, "__part").agg(F.sum("__new").alias("n"))
    parts = parts.select(*keys, "__part", F.expr(f"coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("base"))
    numbered = on.join(parts, [*keys, "__part"]).withColumn("__run", F.expr(f"base + sum(__new) OVER (PARTITION BY {by}, __part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    return numbered.groupBy(*keys, "__run").agg(F.min("pos").alias("left"), F.max("next").alias("right"), F.max("depth").alias("__top")).drop("__run")


def fixed(frame: str) -> list[Column]:
    return [c(x, frame) for x in FIXED]
