"""Stored datasets: tab-separated or GTF text by sample, Parquet, schema and profile files.

Text is written by Spark's own writer, partitioned by sample, so an interrupted
job leaves no half-written file: ``<path>/files/sample=<id>/part-*`` and, in the
same layout, ``<path>/meta``.  Samples are not gathered on the driver.
"""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionframe.functions.text import number_text
from regionframe.model import Dataset, c
from regionframe.sources.schema import Schema, render

#: Element names of the schema file; a deployment that shares files with other tools passes theirs.
ELEMENTS = ("schemaCollection", "schema")


def schema_of(ds: Dataset, name: str, kind: str = "tab", coordinates: str = "default") -> Schema:
    fixed = (("chr", "STRING"), ("left", "LONG"), ("right", "LONG"), ("strand", "CHAR"))
    if kind == "gtf":
        fixed = (("seqname", "STRING"), ("source", "STRING"), ("feature", "STRING"), ("start", "LONG"), ("end", "LONG"), ("score", "DOUBLE"), ("strand", "CHAR"), ("frame", "STRING"))
    own = tuple((a, ds.kind(a).upper()) for a in ds.attributes if kind != "gtf" or a not in ("source", "feature", "score", "frame"))
    return Schema(name, (*fixed, *own), kind, coordinates)


def _text(ds: Dataset, a: str):
    return number_text(c(a)) if ds.kind(a) == "double" else F.coalesce(c(a), F.lit("null"))


def tab_lines(ds: Dataset, one_based: bool = False) -> DataFrame:
    """sample_id and value: chromosome, start, stop, strand and attributes."""
    start = (c("left") + (1 if one_based else 0)).cast("string")
    return ds.regions.select("sample_id", F.concat_ws("\t", c("chrom"), start, c("right").cast("string"), c("strand"), *[_text(ds, a) for a in ds.attributes]).alias("value"), "chrom", "left", "right")


def gtf_lines(ds: Dataset, one_based: bool = True, source: str = "regionframe", feature: str = "Region") -> DataFrame:
    """sample_id and value: the nine GTF columns; attributes of these names fill them, others go to the last."""
    has = set(ds.attributes)
    of = lambda a, default: F.coalesce(_text(ds, a), F.lit(default)) if a in has else F.lit(default)
    rest = [F.concat(F.lit(f'{a} "'), _text(ds, a), F.lit('";')) for a in ds.attributes if a not in ("source", "feature", "score", "frame")]
    start = (c("left") + (1 if one_based else 0)).cast("string")
    strand = F.when(c("strand") == "*", ".").otherwise(c("strand"))
    return ds.regions.select("sample_id", F.concat_ws("\t", c("chrom"), of("source", source), of("feature", feature), start, c("right").cast("string"), of("score", "0.0"), strand, of("frame", "."), F.concat_ws(" ", *rest)).alias("value"), "chrom", "left", "right")


def _put(spark: SparkSession, text: str, path: str) -> None:
    """A small text file in any of Spark's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_text(ds: Dataset, path: str, kind: str = "tab", coordinates: str = "default", name: str = "dataset", elements: tuple[str, str] = ELEMENTS) -> None:
    """One folder for each sample that has metadata; within it regions in coordinate order."""
    spark = ds.regions.sparkSession
    one_based = Schema(name, (), kind, coordinates).one_based
    kept = ds.with_regions(ds.regions.join(ds.meta.select("sample_id").distinct(), "sample_id", "left_semi").select(*[c(x) for x in ds.regions.columns]))
    rows = gtf_lines(kept, one_based) if kind == "gtf" else tab_lines(kept, one_based)
    # ranges keep a sample's files in coordinate order and split large samples
    rows.repartitionByRange("sample_id", "chrom", "left").sortWithinPartitions("sample_id", "chrom", "left", "right", "value").select("value", c("sample_id").alias("sample")).write.mode("overwrite").partitionBy("sample").text(f"{path}/files")
    ds.meta.select(F.concat_ws("\t", "attribute", "value").alias("value"), c("sample_id").alias("sample")).repartition("sample").sortWithinPartitions("sample", "value").write.mode("overwrite").partitionBy("sample").text(f"{path}/meta")
    _put(spark, render(schema_of(ds, name, kind, coordinates), *elements), f"{path}/schema.xml")


def read_text(spark: SparkSession, path: str, name: str | None = None) -> Dataset:
    """A dataset stored by write_text."""
    from regionframe.sources.readers import file_text, lines, pairs, parser_of
    from regionframe.sources.schema import parse

    parser = parser_of(parse(file_text(spark, f"{path}/schema.xml")))
    raw = spark.read.text(f"{path}/files").withColumn("sample_id", c("sample").cast("long")).drop("sample")
    meta = spark.read.text(f"{path}/meta").withColumn("sample_id", c("sample").cast("long")).drop("sample")
    return Dataset.of(lines(raw, parser), pairs(meta), name)


def write_parquet(ds: Dataset, path: str) -> None:
    """The native format: regions clustered by sample and chromosome, metadata beside them."""
    ds.regions.repartitionByRange("sample_id", "chrom", "left").sortWithinPartitions("sample_id", "chrom", "left").write.mode("overwrite").parquet(f"{path}/regions")
    ds.meta.write.mode("overwrite").parquet(f"{path}/meta")


def profile(ds: Dataset) -> DataFrame:
    """Statistics of each sample's regions, and in the row with a null sample_id those of all."""
    length = c("right") - c("left")
    aggs = [
        F.count(F.lit(1)).alias("regions"), F.avg(length).alias("avg_length"), F.min("left").alias("min_left"), F.max("right").alias("max_right"),
        F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.var_pop(length).alias("var_length"),
    ]
    return ds.regions.rollup("sample_id").agg(*aggs)


def write_profile(ds: Dataset, path: str) -> None:
    """profile.xml: one element for each sample, streamed to the driver."""
    spark = ds.regions.sparkSession
    parts, total = [], ""
    for r in profile(ds).orderBy(F.col("sample_id").asc_nulls_first()).toLocalIterator():
        values = "".join(f"<feature name={quoteattr(k)}>{r[k]}</feature>" for k in r.asDict() if k != "sample_id")
        if r["sample_id"] is None:
            total = values
        else:
            parts.append(f"<sample id=\"{r['sample_id']}\">{values}</sample>")
    _put(spark, f'<?xml version="1.0" encoding="UTF-8"?>\n<dataset>{total}<samples>{"".join(parts)}</samples></dataset>\n', f"{path}/profile.xml")
