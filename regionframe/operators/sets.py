"""Union, merge and difference."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.model import FIXED, Dataset, c
from regionframe.plans import ranges
from regionframe.plans.metajoin import groups, of_samples, pairs, partnered


def union(left: Dataset, right: Dataset, left_name: str | None = None, right_name: str | None = None) -> Dataset:
    """All regions of both under the left schema, and all metadata with the ``_provenance`` of each sample.

    Right attributes are taken by name; absent ones are null, others dropped.
    """
    new = lambda tag: F.xxhash64(F.lit(tag), c("sample_id")).alias("sample_id")
    rest = [c(x) for x in FIXED[1:]]
    has = set(right.attributes)
    there = [(c(a).cast(left.regions.schema[a].dataType) if a in has else F.lit(None).cast(left.regions.schema[a].dataType)).alias(a) for a in left.attributes]
    regions = left.regions.select(new(0), *rest, *[c(a) for a in left.attributes]).unionByName(right.regions.select(new(1), *rest, *there))
    metas = []
    for tag, ds, name in ((0, left, left_name or left.name or "left"), (1, right, right_name or right.name or "right")):
        own = ds.meta.select(new(tag), "attribute", "value")
        metas += [own, own.select("sample_id", F.lit("_provenance").alias("attribute"), F.lit(name).alias("value")).distinct()]
    meta = metas[0].unionByName(metas[2]).distinct().unionByName(metas[1]).unionByName(metas[3])
    return left.with_regions(regions).with_meta(meta)


def merge(ds: Dataset, groupby=None) -> Dataset:
    """One sample out of all (id 1), or out of each group; samples without the group's attributes go."""
    if groupby:
        of = groups(ds.meta, groupby)
        regions = ds.regions.join(F.broadcast(of), "sample_id").withColumn("sample_id", c("group_id"))
        meta = ds.meta.join(of, "sample_id").withColumn("sample_id", c("group_id"))
    else:
        regions = ds.regions.withColumn("sample_id", F.lit(1).cast("long"))
        meta = ds.meta.withColumn("sample_id", F.lit(1).cast("long"))
    return ds.with_regions(regions.select(*[c(x) for x in ds.regions.columns])).with_meta(meta.select("sample_id", "attribute", "value").distinct())


def difference(left: Dataset, right: Dataset, joinby=None, exact: bool = False, bin_size: int = ranges.BIN) -> Dataset:
    """Left regions that overlap no region of any paired right sample; with ``exact`` that equal none.

    Equal left regions become one.  Left samples without a partner have no regions left.
    """
    found = pairs(left, right, joinby).select("ref_id", "exp_id")
    having = found.select(c("ref_id").alias("sample_id")).distinct()
    other = right.regions.select(*[c(x) for x in FIXED])
    mine = of_samples(left.regions, having)
    columns = [c(x) for x in left.regions.columns]
    # without a condition every right sample that has metadata is a partner
    x, y = partnered(left.regions, other, found) if joinby else (mine, of_samples(other, right.meta))
    keys = ("__exp",) if joinby else ()
    if exact:
        on = (c("chrom", "l") == c("chrom", "r")) & (c("left", "l") == c("left", "r")) & (c("right", "l") == c("right", "r")) & ranges.compatible("l", "r")
        for k in keys:
            on &= c(k, "l") == c(k, "r")
        met = x.alias("l").join(y.alias("r"), on)
    else:
        met = ranges.overlap_join(x, y, bin_size, keys)
    met = met.select(*[c(x, "l").alias(x) for x in left.regions.columns])
    # one grouping both drops what was met and makes equal regions one
    marked = mine.select(*columns, F.lit(0).alias("__met")).unionByName(met.select(*columns, F.lit(1).alias("__met")))
    kept = marked.groupBy(*columns).agg(F.max("__met").alias("__met")).filter("__met = 0").drop("__met")
    new = F.xxhash64(c("sample_id"))
    meta = left.meta.join(having, "sample_id", "left_semi") if joinby else left.meta
    return left.with_regions(kept.withColumn("sample_id", new).select(*columns)).with_meta(meta.withColumn("sample_id", new).select("sample_id", "attribute", "value"))
