"""Ranking samples by metadata and regions by attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.functions.predicates import names
from regionframe.functions.text import as_number
from regionframe.model import FIXED, Dataset, c


def _limit(top, name):
    if top is None:
        return None, 0
    how, n = top
    if how not in ("top", "topg", "topp"):
        raise ValueError(f"no such {name}: {how}")
    return how, n


def order(ds: Dataset, meta_keys=None, meta_top=None, region_keys=None, region_top=None) -> Dataset:
    """Keys are (name, ascending) pairs; a top is ('top' | 'topg' | 'topp', n).

    Samples get ``_order`` from 1 (and ``_order_groupId`` with topg); those with
    none of the keys go.  Of an attribute's values the smallest text counts when
    ascending, the largest when descending; numbers come after other text.
    Regions get an attribute ``order``, their rank within the sample, or with
    topg and topp within equal values of all keys but the last.
    Ties follow the id, or all of a region's columns.
    """
    if not meta_keys and not region_keys:
        raise ValueError("ORDER needs a key")
    if region_keys:
        ds = ds.with_regions(_regions(ds, region_keys, region_top))
        if region_top is not None:
            ds = ds.with_meta(ds.meta.join(ds.regions.select("sample_id").distinct(), "sample_id", "left_semi"))
    if meta_keys:
        meta = _samples(ds.meta, meta_keys, meta_top)
        regions = ds.regions.join(meta.select("sample_id").distinct(), "sample_id", "left_semi")
        ds = ds.with_meta(meta).with_regions(regions)
    return ds


def _samples(meta, keys, top):
    how, n = _limit(top, "meta_top")
    picked, terms = [], []
    for k, (name, up) in enumerate(keys):
        v = F.when(names(F.col("attribute"), name), F.col("value"))
        picked.append((F.min(v) if up else F.max(v)).alias(f"__v{k}"))
    by = meta.groupBy("sample_id").agg(*picked)
    by = by.filter(F.coalesce(*[F.col(f"__v{k}") for k in range(len(keys))]).isNotNull())
    for k, (_, up) in enumerate(keys):
        number = as_number(F.col(f"__v{k}"))
        by = by.withColumn(f"__c{k}", F.when(F.col(f"__v{k}").isNull(), 0).when(number.isNull(), 1).otherwise(2)).withColumn(f"__n{k}", number)
        way = "ASC" if up else "DESC"
        terms.append((f"__c{k} {way}", f"__n{k} {way}", f"__v{k} {way}"))
    flat = lambda ts: ", ".join(x for t in ts for x in t)
    groups = flat(terms[:-1])
    if how == "topg" and len(keys) > 1:
        part = ", ".join(f"__v{k}" for k in range(len(keys) - 1))
        ranked = by.withColumn("__o", F.expr(f"row_number() OVER (PARTITION BY {part} ORDER BY {flat(terms[-1:])}, sample_id)"))
        ranked = ranked.withColumn("__g", F.expr(f"dense_rank() OVER (ORDER BY {groups})")).filter(F.col("__o") <= n)
    else:
        ranked = by.withColumn("__o", F.expr(f"row_number() OVER (ORDER BY {flat(terms)}, sample_id)")).withColumn("__g", F.lit(1))
        if how in ("top", "topg"):
            ranked = ranked.filter(F.col("__o") <= n)
        elif how == "topp":
            ranked = ranked.withColumn("__all", F.expr("count(*) OVER ()")).filter(F.col("__o") <= F.floor(F.col("__all") * n / 100))
    new = [F.struct(F.lit("_order").alias("attribute"), F.col("__o").cast("string").alias("value"))]
    if how == "topg":
        new.append(F.struct(F.lit("_order_groupId").alias("attribute"), F.col("__g").cast("string").alias("value")))
    added = ranked.select("sample_id", F.explode(F.array(*new)).alias("x")).select("sample_id", "x.attribute", "x.value")
    return meta.join(ranked.select("sample_id"), "sample_id", "left_semi").unionByName(added)


def _regions(ds: Dataset, keys, top):
    how, n = _limit(top, "region_top")
    fields = [(ds.field(f), up) for f, up in keys]
    terms = [c(f).asc_nulls_last() if up else c(f).desc_nulls_last() for f, up in fields[:1]]
    terms += [c(f).asc() if up else c(f).desc() for f, up in fields[1:]]
    from pyspark.sql import Window

    rest = [c(x) for x in (*FIXED[1:], *ds.attributes)]
    part = [c("sample_id")] + ([c(f) for f, _ in fields[:-1]] if how in ("topg", "topp") else [])
    w = Window.partitionBy(*part).orderBy(*(terms[-1:] if how in ("topg", "topp") else terms), *rest)
    out = ds.regions.withColumn("__o", F.row_number().over(w))
    if how in ("top", "topg"):
        out = out.filter(F.col("__o") <= n)
    elif how == "topp":
        out = out.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(*part))).filter(F.col("__o") <= F.floor(F.col("__all") * n / 100)).drop("__all")
    return out.withColumn("order", F.col("__o").cast("double")).drop("__o")
