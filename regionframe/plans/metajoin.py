"""Samples that belong together by their metadata: pairs, groups and semijoins.

A condition on an attribute is a (kind, name) pair: 'default' takes the name
under any prefix, 'exact' the name alone, 'full' any prefix that both sides share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions.predicates import names
from regionframe.model import Dataset, c


def condition(a) -> tuple[str, str]:
    """A name alone is a default condition."""
    if isinstance(a, str):
        return "default", a
    kind, name = a
    if kind not in ("default", "exact", "full"):
        raise ValueError(f"no such condition: {kind}")
    return kind, name


def keyed(meta: DataFrame, by) -> DataFrame:
    """sample_id, cond (number of the condition), key, value; distinct."""
    parts = []
    for k, a in enumerate(by):
        kind, name = condition(a)
        hit = F.col("attribute") == name if kind == "exact" else names(F.col("attribute"), name)
        key = F.col("attribute") if kind == "full" else F.lit(name)
        parts.append(F.when(hit, F.struct(F.lit(k).alias("cond"), key.alias("key"))))
    found = meta.select("sample_id", "value", F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return found.select("sample_id", "x.cond", "x.key", "value").distinct()


def _shared(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """(ref_id, exp_id) of samples that share a value of every attribute."""
    by = list(by)
    x = keyed(left, by).withColumnRenamed("sample_id", "ref_id")
    y = keyed(right, by).withColumnRenamed("sample_id", "exp_id")
    met = x.join(y, ["cond", "key", "value"]).groupBy("ref_id", "exp_id").agg(F.count_distinct("cond").alias("n"))
    return met.filter(F.col("n") == len(by)).select("ref_id", "exp_id")


def pair_id(ref, exp):
    """The id of the sample that a pair becomes."""
    return F.xxhash64(ref, exp)


def pairs(left: Dataset, right: Dataset, joinby=None) -> DataFrame:
    """ref_id, exp_id, out_id: the pairs of samples to combine; without a condition all pairs of samples."""
    if joinby:
        found = _shared(left.meta, right.meta, joinby)
    else:
        found = left.meta.select(F.col("sample_id").alias("ref_id")).distinct().crossJoin(right.meta.select(F.col("sample_id").alias("exp_id")).distinct())
    return found.withColumn("out_id", pair_id(F.col("ref_id"), F.col("exp_id")))


#: Parts that a sample's regions are spread over where they meet its partners.
SPREAD = 64


def of_samples(regions: DataFrame, meta: DataFrame) -> DataFrame:
    """The regions of samples that have metadata; a number for each sample goes to every executor, so regions are not moved."""
    return regions.join(F.broadcast(meta.select("sample_id").distinct()), "sample_id", "left_semi")


def partnered(left: DataFrame, right: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left regions once for each partner sample, and right regions, both with that sample as __exp.

    A range join with __exp in its key meets the regions of paired samples only.
    There may be few samples, and as many pairs as their square: so pairs are not
    broadcast unasked, and a sample's regions don't go to one task.
    """
    on = found.select(F.col("ref_id").alias("sample_id"), F.col("exp_id").alias("__exp")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    spread = left.withColumn("__part", F.pmod(F.hash("chrom", "left", "right"), F.lit(SPREAD)))
    return spread.join(on, ["sample_id", "__part"]).select(*[c(x) for x in left.columns], "__exp"), right.withColumn("__exp", F.col("sample_id"))


def with_each(left: DataFrame, left_meta: DataFrame, right_meta: DataFrame) -> DataFrame:
    """Left regions of samples with metadata, once for each right sample with metadata, as __exp."""
    return of_samples(left, left_meta).crossJoin(F.broadcast(right_meta.select(F.col("sample_id").alias("__exp")).distinct()))


def groups(meta: DataFrame, groupby) -> DataFrame:
    """sample_id, group_id: samples with equal values of the attributes; those with none of them are left out."""
    found = keyed(meta, groupby).groupBy("sample_id").agg(F.array_sort(F.collect_set(F.struct("cond", "key", "value"))).alias("k"))
    return found.select("sample_id", F.xxhash64("k").alias("group_id"))


def semijoin(meta: DataFrame, other: DataFrame, by, negated: bool = False) -> DataFrame:
    """Ids of the samples of ``meta`` that share, or for each attribute have, a value unlike all of ``other``'s."""
    by = list(by)
    if not negated:
        return _shared(meta, other, by).select(F.col("ref_id").alias("sample_id")).distinct()
    apart = keyed(meta, by).join(keyed(other, by).select("cond", "key", "value").distinct(), ["cond", "key", "value"], "left_anti")
    return apart.groupBy("sample_id").agg(F.count_distinct("cond").alias("n")).filter(F.col("n") == len(by)).select("sample_id")


def combined_meta(found: DataFrame, left: Dataset, right: Dataset, left_name: str, right_name: str) -> DataFrame:
    """Metadata of paired samples, prefixed by the datasets' names."""
    x = found.join(left.meta.withColumnRenamed("sample_id", "ref_id"), "ref_id").select(F.col("out_id").alias("sample_id"), F.concat(F.lit(left_name + "."), "attribute").alias("attribute"), "value")
    y = found.join(right.meta.withColumnRenamed("sample_id", "exp_id"), "exp_id").select(F.col("out_id").alias("sample_id"), F.concat(F.lit(right_name + "."), "attribute").alias("attribute"), "value")
    return x.unionByName(y)
