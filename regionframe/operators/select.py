"""Choosing samples by metadata and regions by conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.functions.expressions import with_metas
from regionframe.functions.predicates import meta_holds, region_holds, region_metas
from regionframe.model import Dataset
from regionframe.plans.metajoin import of_samples
from regionframe.plans.metajoin import semijoin as shared


def select(ds: Dataset, meta=None, region=None, semijoin=None) -> Dataset:
    """``meta`` and ``region`` are predicates; ``semijoin`` is (attributes, dataset, negated).

    With a region condition, samples that keep no region lose their metadata.
    Where the dataset is a folder of region files, a condition on metadata is
    looked up at once, so that the other samples' files are never opened.
    """
    pairs, regions = ds.meta, ds.regions
    if meta is not None:
        ids = pairs.groupBy("sample_id").agg(meta_holds(meta).alias("__on")).filter("__on").select("sample_id")
        pairs = pairs.join(ids, "sample_id", "left_semi")
    if semijoin is not None:
        by, other, negated = semijoin
        pairs = pairs.join(shared(pairs, other.meta, by, negated), "sample_id", "left_semi")
    if meta is not None or semijoin is not None:
        ids = pairs.select("sample_id").distinct()
        # of a folder of files only those of the chosen samples are opened
        some = ds.opened(ids) if ds.opened else None
        regions = of_samples(regions, ids) if some is None else some
    if region is not None:
        full = with_metas(ds.with_regions(regions), region_metas(region))
        kept = [F.col("`" + x.replace("`", "``") + "`") for x in ds.regions.columns]
        regions = full.filter(region_holds(region, ds)).select(*kept)
        pairs = pairs.join(regions.select("sample_id").distinct(), "sample_id", "left_semi")
    return ds.with_regions(regions).with_meta(pairs)
