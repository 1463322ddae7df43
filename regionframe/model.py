"""A dataset: typed regions and open-ended metadata, both lazy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

FIXED = ("sample_id", "chrom", "left", "right", "strand")
META = ("sample_id", "attribute", "value")
#: Names that mean a coordinate in expressions and are therefore no attributes.
COORDINATES = ("chr", "chrom", "left", "right", "start", "stop", "strand")


def c(name: str, frame: str | None = None) -> Column:
    """A column by its literal name; attribute names may hold dots."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{frame}.{quoted}" if frame else quoted)


@dataclass(frozen=True)
class Dataset:
    """regions: FIXED columns, then attributes (DOUBLE or STRING); meta: sample_id, attribute, value.

    Coordinates are 0-based and half-open.  ``name`` prefixes attributes and
    metadata where two datasets meet.  ``opened``, where regions are files by sample,
    gives the regions of some samples (a frame of their ids) without reading other files.
    """

    regions: DataFrame
    meta: DataFrame
    name: str | None = None
    opened: Callable[[DataFrame], DataFrame | None] | None = None

    @staticmethod
    def of(regions: DataFrame, meta: DataFrame, name: str | None = None) -> Dataset:
        """Check and normalise column types: numbers become DOUBLE, all else STRING."""
        missing = [x for x in FIXED if x not in regions.columns] + [x for x in META if x not in meta.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
        kinds = dict(regions.dtypes)
        attrs = [x for x in regions.columns if x not in FIXED]
        typed = [c(x).cast("double" if kinds[x] in numeric or kinds[x].startswith("decimal") else "string").alias(x) for x in attrs]
        fixed = [c("sample_id").cast("long"), c("chrom").cast("string"), c("left").cast("long"), c("right").cast("long"), F.when(c("strand").isin("+", "-"), c("strand")).otherwise("*").alias("strand")]
        fixed = [x.alias(n) for x, n in zip(fixed, FIXED, strict=True)]
        return Dataset(regions.select(*fixed, *typed), meta.select(c("sample_id").cast("long").alias("sample_id"), c("attribute").cast("string").alias("attribute"), c("value").cast("string").alias("value")), name)

    @property
    def attributes(self) -> list[str]:
        return [x for x in self.regions.columns if x not in FIXED]

    def kind(self, attribute: str) -> str:
        """'double' or 'string'."""
        t = self.regions.schema[attribute].dataType
        return "double" if isinstance(t, DoubleType) else "string" if isinstance(t, StringType) else t.simpleString()

    def field(self, ref: str) -> str:
        """An attribute by name or by position ``$n``; raises where there is none."""
        attrs = self.attributes
        if ref.startswith("$"):
            k = int(ref[1:])
            if k >= len(attrs):
                raise ValueError(f"no attribute at position {ref}")
            return attrs[k]
        if ref not in attrs:
            raise ValueError(f"no attribute {ref!r}; there are {', '.join(attrs) or 'none'}")
        return ref

    def fields(self, refs) -> list[str]:
        """Attributes named by names, ``$n`` or ``?`` wildcards, in schema order."""
        import re

        found = set()
        for ref in refs:
            if "?" in ref:
                pattern = re.compile(".*".join(map(re.escape, ref.split("?"))))
                hits = [x for x in self.attributes if pattern.fullmatch(x)]
                if not hits:
                    raise ValueError(f"nothing matches {ref!r}")
                found.update(hits)
            else:
                found.add(self.field(ref))
        return [x for x in self.attributes if x in found]

    def named(self, name: str) -> Dataset:
        return replace(self, name=name)

    def with_regions(self, regions: DataFrame) -> Dataset:
        return replace(self, regions=regions, opened=None)

    def with_meta(self, meta: DataFrame) -> Dataset:
        return replace(self, meta=meta)

    # results
    def take(self, n: int) -> Dataset:
        """At most ``n`` regions of each sample, in coordinate order; all metadata."""
        order = "chrom, left, right, strand"
        ranked = self.regions.withColumn("__n", F.expr(f"row_number() OVER (PARTITION BY sample_id ORDER BY {order})"))
        return self.with_regions(ranked.filter(F.col("__n") <= n).drop("__n"))

    def take_first(self, n: int) -> Dataset:
        """At most ``n`` regions in all."""
        return self.with_regions(self.regions.limit(n))

    def collect(self) -> tuple[list, list]:
        return self.regions.collect(), self.meta.collect()

    def collect_iterator(self):
        """Regions and metadata as iterators that hold one partition at a time."""
        return self.regions.toLocalIterator(), self.meta.toLocalIterator()

    # operators
    def select(self, *args, **kw) -> Dataset:
        from regionframe.operators.select import select

        return select(self, *args, **kw)

    def project(self, *args, **kw) -> Dataset:
        from regionframe.operators.project import project

        return project(self, *args, **kw)

    def extend(self, *args, **kw) -> Dataset:
        from regionframe.operators.group import extend

        return extend(self, *args, **kw)

    def group(self, *args, **kw) -> Dataset:
        from regionframe.operators.group import group

        return group(self, *args, **kw)

    def merge(self, *args, **kw) -> Dataset:
        from regionframe.operators.sets import merge

        return merge(self, *args, **kw)

    def union(self, other: Dataset, **kw) -> Dataset:
        from regionframe.operators.sets import union

        return union(self, other, **kw)

    def difference(self, other: Dataset, **kw) -> Dataset:
        from regionframe.operators.sets import difference

        return difference(self, other, **kw)

    def order(self, *args, **kw) -> Dataset:
        from regionframe.operators.order import order

        return order(self, *args, **kw)

    def map(self, other: Dataset, *args, **kw) -> Dataset:
        from regionframe.operators.mapping import map_overlaps

        return map_overlaps(self, other, *args, **kw)

    def join(self, other: Dataset, *args, **kw) -> Dataset:
        from regionframe.operators.joining import join_distance

        return join_distance(self, other, *args, **kw)

    def cover(self, *args, **kw) -> Dataset:
        from regionframe.operators.cover import cover

        return cover(self, *args, **kw)

    def histogram(self, *args, **kw) -> Dataset:
        return self.cover(*args, variant="histogram", **kw)

    def summit(self, *args, **kw) -> Dataset:
        return self.cover(*args, variant="summit", **kw)

    def flat(self, *args, **kw) -> Dataset:
        return self.cover(*args, variant="flat", **kw)
