"""Aggregates of regions into metadata, and grouping of samples and of regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.functions import aggregates as A
from regionframe.functions.text import as_number, as_text
from regionframe.model import FIXED, Dataset, c
from regionframe.plans.metajoin import keyed


def extend(ds: Dataset, aggs: list[A.Agg]) -> Dataset:
    """Adds each aggregate of a sample's regions to its metadata, as text."""
    if not aggs:
        raise ValueError("EXTEND needs an aggregate")
    columns, made = [], []
    for k, a in enumerate(aggs):
        field = ds.field(a.field) if a.field else None
        kind = ds.kind(field) if field else None
        A.check(a, A.EXTEND, kind)
        columns.append(A.column(a, kind, c(field) if field else None).alias(f"__{k}"))
        made.append(F.struct(F.lit(a.output).alias("attribute"), as_text(F.col(f"__{k}"), "string" if A.is_text(a, kind) else "double").alias("value")))
    new = ds.regions.groupBy("sample_id").agg(*columns).select("sample_id", F.explode(F.array(*made)).alias("x")).select("sample_id", "x.attribute", "x.value")
    return ds.with_meta(ds.meta.unionByName(new).distinct())


def group(ds: Dataset, meta_key=None, meta_aggregates: list[A.Agg] | None = None, meta_group_name: str = "_group", region_keys=None, region_aggregates: list[A.Agg] | None = None) -> Dataset:
    """Numbers samples by a metadata attribute, and merges regions with equal coordinates and keys.

    Groups are numbered from 1 in the order of their values; samples without
    the attribute are group 0.  Without a metadata key regions are always
    grouped, by coordinates alone if no key is named.
    """
    if meta_aggregates and meta_key is None:
        raise ValueError("metadata aggregates need a metadata key")
    meta = ds.meta if meta_key is None else _numbered(ds, meta_key, meta_aggregates or [], meta_group_name)
    if meta_key is not None and region_keys is None and not region_aggregates:
        return ds.with_meta(meta)
    keys = ds.fields(region_keys or [])
    outputs = [*keys, *(a.output for a in region_aggregates or [])]
    if len(set(outputs)) < len(outputs):
        raise ValueError("two output attributes have one name")
    columns = []
    for a in region_aggregates or []:
        field = ds.field(a.field) if a.field else None
        kind = ds.kind(field) if field else None
        A.check(a, A.REGION, kind)
        columns.append(A.column(a, kind, c(field) if field else None).alias(a.output))
    by = ds.regions.groupBy(*[c(x) for x in (*FIXED, *keys)])
    regions = by.agg(*columns) if columns else by.agg(F.lit(1).alias("__one")).drop("__one")
    return ds.with_meta(meta).with_regions(regions)


def _numbered(ds: Dataset, key, aggs: list[A.Agg], name: str):
    meta = ds.meta.filter(F.col("attribute") != name)
    values = keyed(meta, [key]).groupBy("sample_id").agg(F.array_sort(F.collect_set("value")).alias("__k"))
    numbers = values.select("__k").distinct().select("__k", F.expr("CAST(row_number() OVER (ORDER BY __k) AS BIGINT)").alias("__g"))
    ids = meta.select("sample_id").distinct()
    of = ids.join(values.join(numbers, "__k").select("sample_id", "__g"), "sample_id", "left").select("sample_id", F.coalesce("__g", F.lit(0)).alias("__g"))
    out = meta.unionByName(of.select("sample_id", F.lit(name).alias("attribute"), F.col("__g").cast("string").alias("value")))
    if not aggs:
        return out
    rows = meta.join(of, "sample_id")
    columns, made = [], []
    for k, a in enumerate(aggs):
        A.check(a, A.META, None)
        fn = a.fn.upper()
        if fn == "COUNTSAMP":
            columns.append(F.count_distinct("sample_id").cast("double").alias(f"__{k}"))
        else:
            mine = F.col("attribute") == a.field
            text = fn in ("BAG", "BAGD") or A.takes_text(a)
            columns.append(A.column(a, "string" if text else "double", F.when(mine, F.col("value") if text else as_number(F.col("value"))), mine).alias(f"__{k}"))
        made.append(F.struct(F.lit(a.output).alias("attribute"), as_text(F.col(f"__{k}"), "string" if A.is_text(a, "double") else "double").alias("value")))
    per = rows.groupBy("__g").agg(*columns)
    new = of.join(per, "__g").select("sample_id", F.explode(F.array(*made)).alias("x")).select("sample_id", "x.attribute", "x.value")
    return out.unionByName(new)
