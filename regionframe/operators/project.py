"""Keeping, computing and replacing attributes, coordinates and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.functions.expressions import is_coordinate, meta_column, metas, named_inputs, region_column, with_metas
from regionframe.model import FIXED, Dataset, c


def project(ds: Dataset, keep=None, all_but: bool = False, update=None, meta_keep=None, meta_all_but: bool = False, meta_update=None) -> Dataset:
    """``keep``: attributes to keep, or with ``all_but`` to drop; None keeps all and () none.

    ``update`` is a list of (target, expression): attributes, new or not, and the
    coordinates left, right, start, stop, chr, strand.  All right-hand sides see
    the row as it was.  Rows with left >= right go; a negative left becomes 0.
    ``meta_keep`` keeps metadata by name, suffix or prefix; ``meta_update`` is a
    list of (attribute, expression), computed for each sample.
    """
    attrs = ds.attributes
    if keep is not None:
        named = ds.fields(keep)
        attrs = [a for a in attrs if (a in named) != all_but]
    regions = ds.regions
    if update:
        regions = _updated(ds, attrs, update)
    elif keep is not None:
        regions = regions.select(*[c(x) for x in (*FIXED, *attrs)])
    return ds.with_regions(regions).with_meta(_meta(ds, meta_keep, meta_all_but, meta_update))


def _updated(ds: Dataset, attrs: list[str], update):
    targets = [t for t, _ in update]
    if len(set(targets)) < len(targets):
        raise ValueError("a target is assigned twice")
    full = with_metas(ds, set().union(*(metas(e) for _, e in update)))
    value = {t: region_column(e, ds) for t, e in update}
    minus = c("strand") == "-"
    left, right = c("left"), c("right")
    if "start" in value and "left" in value or "stop" in value and "right" in value:
        raise ValueError("a coordinate is assigned twice")
    whole = lambda x: F.floor(x).cast("long")
    if "left" in value:
        left = whole(value["left"])
    if "right" in value:
        right = whole(value["right"])
    if "start" in value:
        left, right = F.when(minus, left).otherwise(whole(value["start"])), F.when(minus, whole(value["start"])).otherwise(right)
    if "stop" in value:
        left, right = F.when(minus, whole(value["stop"])).otherwise(left), F.when(minus, right).otherwise(whole(value["stop"]))
    chrom = value.get("chr", value.get("chrom", c("chrom")))
    strand = value.get("strand", c("strand"))
    strand = F.when(strand.isin("+", "-"), strand).otherwise("*")
    columns = [c("sample_id"), chrom.alias("chrom"), left.alias("left"), right.alias("right"), strand.alias("strand")]
    columns += [value[a].alias(a) if a in value else c(a) for a in attrs]
    columns += [value[t].alias(t) for t in targets if t not in attrs and not is_coordinate(t)]
    out = full.select(*columns).filter(c("left") < c("right"))
    return out.withColumn("left", F.greatest(c("left"), F.lit(0)))


def _meta(ds: Dataset, keep, all_but: bool, update):
    meta = ds.meta
    a = F.col("attribute")
    if keep is not None:
        hit = F.lit(False)
        for k in keep:
            hit = hit | (a == k) | a.endswith("." + k) | a.startswith(k + ".")
        meta = meta.filter(~hit if all_but else hit)
    if not update:
        return meta
    inputs = sorted({n for _, e in update for n in named_inputs(e)})
    # of several values of an input the smallest counts
    picked = [F.min(F.when(F.lower(a).endswith(n.lower()), F.col("value"))).alias(f"__in:{n}") for n in inputs]
    by = meta.groupBy("sample_id").agg(*picked, F.lit(1).alias("__one"))
    made = []
    for target, e in update:
        value = {n: c(f"__in:{n}") for n in inputs}
        has = F.lit(True)
        if named_inputs(e):
            has = F.coalesce(*[value[n] for n in named_inputs(e)]).isNotNull()
        made.append(F.when(has, F.struct(F.lit(target).alias("attribute"), meta_column(e, value).alias("value"))))
    new = by.select("sample_id", F.explode(F.array_compact(F.array(*made))).alias("x")).select("sample_id", "x.attribute", "x.value")
    replaced = F.lit(False)
    for target, _ in update:
        replaced = replaced | a.endswith(target)
    return meta.filter(~replaced).unionByName(new)
