"""Region files and their metadata files.

A data file counts if a file of the same name with ``.meta`` stands beside it.
A sample's id is a hash of its file's name.  Lines are split and typed by Spark
expressions, so column pruning and filters reach the parsed columns; paths may
be in any file system that Spark reads.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionframe.model import Dataset, c
from regionframe.sources.schema import Schema, loaded_type, parse


@dataclass(frozen=True)
class Parser:
    """Positions of the coordinates in a line, and (position, name, type) of the attributes."""

    chrom: int = 0
    start: int = 1
    stop: int = 2
    strand: int | None = None
    others: tuple[tuple[int, str, str], ...] = ()
    one_based: bool = False
    kind: str = "tab"


def _p(strand, *others) -> Parser:
    return Parser(strand=strand, others=tuple(others))


#: Column layouts of common formats (fixed values).
PARSERS = {
    "bed": _p(5, (3, "3", "STRING"), (4, "4", "DOUBLE"), (6, "6", "DOUBLE"), (7, "7", "DOUBLE"), (8, "8", "DOUBLE"), (9, "9", "DOUBLE")),
    "ann": _p(5, (3, "name", "STRING"), (4, "score", "DOUBLE")),
    "broadproj": _p(None, (3, "name", "STRING")),
    "basic": _p(None),
    "broadpeaks": _p(5, (3, "name", "STRING"), (4, "score", "DOUBLE"), (6, "signal", "DOUBLE"), (7, "pvalue", "DOUBLE"), (8, "qvalue", "DOUBLE")),
    "narrowpeak": _p(5, (3, "name", "STRING"), (4, "score", "DOUBLE"), (6, "signalValue", "DOUBLE"), (7, "pValue", "DOUBLE"), (8, "qValue", "DOUBLE"), (9, "peak", "DOUBLE")),
    "rnaseq": _p(3, (4, "name", "STRING"), (5, "score", "DOUBLE")),
    "bedscore": _p(None, (3, "score", "DOUBLE")),
}
#: Files that are opened by name; where more samples are chosen the folder is scanned.
MOST_OPENED = 10_000
#: Other names that scripts use for these layouts.
_ALIASES = {"bedtabseparatedparser": "bed", "bedparser": "bed", "annparser": "ann", "broadprojparser": "broadproj", "basicparser": "basic", "broadpeaksparser": "broadpeaks", "narrowpeakparser": "narrowpeak", "rnaseqparser": "rnaseq", "bedscoreparser": "bedscore"}
_CHROM, _START, _STOP, _STRAND = ("CHROM", "CHROMOSOME", "CHR"), ("START", "LEFT"), ("STOP", "RIGHT", "END"), ("STR", "STRAND")


def parser_named(name: str) -> Parser | None:
    """A built-in layout; None stands for the layout of the dataset's schema file."""
    key = name.lower()
    if key in ("default", "custom", "customparser"):
        return None
    key = _ALIASES.get(key, key)
    if key not in PARSERS:
        raise ValueError(f"no parser {name}; there are {', '.join(PARSERS)} and default")
    return PARSERS[key]


def parser_of(schema: Schema) -> Parser:
    """The layout that a schema file describes."""
    rest = [(n, t) for n, t in schema.fields if n.upper() not in (*_CHROM, *_START, *_STOP, *_STRAND, "SEQNAME")]
    if schema.kind == "gtf":
        known = ("source", "feature", "score", "frame")
        others = [(1, "source", "STRING"), (2, "feature", "STRING"), (5, "score", "DOUBLE"), (7, "frame", "STRING")]
        others += [(8, n, t) for n, t in rest if n.lower() not in known]
        return Parser(0, 3, 4, 6, tuple(others), schema.one_based, "gtf")
    if schema.kind == "vcf":
        return Parser(0, 1, 1, None, tuple((k + 2, n, t) for k, (n, t) in enumerate(rest)), schema.one_based, "vcf")
    where = {}
    for k, (n, _) in enumerate(schema.fields):
        for role, names in (("chrom", _CHROM), ("start", _START), ("stop", _STOP), ("strand", _STRAND)):
            if n.upper() in names:
                where.setdefault(role, k)
    others = []
    # coordinates that the schema leaves out stand in front, in their usual order
    absent = [r for r in ("chrom", "start", "stop") if r not in where]
    shift = len(absent)
    position = {r: k for k, r in enumerate(absent)} | {r: k + shift for r, k in where.items()}
    for k, (n, t) in enumerate(schema.fields):
        if k not in where.values():
            others.append((k + shift, n, t))
    return Parser(position["chrom"], position["start"], position["stop"], position.get("strand"), tuple(others), schema.one_based)


def _typed(x: Column, declared: str) -> Column:
    if loaded_type(declared) == "string":
        return F.trim(x)
    return F.when(F.lower(F.trim(x)).isin("null", "."), None).otherwise(F.trim(x).try_cast("double"))


def lines(raw: DataFrame, parser: Parser, line: str = "value", strict: bool = False) -> DataFrame:
    """Parsed regions of a frame of lines; further columns stay in front.

    Lines that don't parse go, as do comments; with ``strict`` the former fail the job.
    """
    kept = [c(x) for x in raw.columns if x != line]
    # each explode of one value is a bound that filters are not pushed through: a line is made, split and searched once
    once = lambda df, x, n: df.select("*", F.explode(F.array(x)).alias(n))
    at = lambda k: F.trim(F.get(F.col("__f"), F.lit(k)))
    # GTF attributes are  key "value";  and their names match in any case
    inside = lambda name: F.regexp_extract(F.get(F.col("__f"), F.lit(8)), '(?i)(?:^|;)\\s*' + _literal(name) + '\\s+"?([^";]*)"?', 1)
    texts = [at(parser.chrom).alias("c"), at(parser.start).alias("l"), at(parser.stop).alias("r"), (F.lit("*") if parser.strand is None else at(parser.strand)).alias("s")]
    within = [parser.kind == "gtf" and k == 8 for k, _, _ in parser.others]
    texts += [(inside(name) if w else at(k)).alias(f"a{i}") for i, ((k, name, _), w) in enumerate(zip(parser.others, within, strict=True))]
    cells = once(once(raw, F.split(c(line), "\t"), "__f"), F.struct(*texts), "__t")
    text = lambda n: F.col(f"__t.{n}")
    start, stop = text("l").try_cast("long"), text("r").try_cast("long")
    if parser.kind == "vcf":
        stop = start if parser.one_based else start + 1
    if parser.one_based:
        start = start - 1
    strand = F.when(text("s").isin("+", "-"), text("s")).otherwise("*")
    attrs = []
    for i, (_, name, declared) in enumerate(parser.others):
        x = F.when(F.length(text(f"a{i}")) > 0, text(f"a{i}")) if within[i] else text(f"a{i}")
        attrs.append(_typed(x, declared).alias(name))
    out = cells.select(*kept, c(line), text("c").alias("chrom"), start.alias("left"), stop.alias("right"), strand.alias("strand"), *attrs)
    good = c("chrom").isNotNull() & (F.length("chrom") > 0) & c("left").isNotNull() & c("right").isNotNull()
    comment = F.ltrim(c(line)).startswith("#") | (F.length(F.trim(c(line))) == 0)
    if strict:
        out = out.filter(~(comment & ~good)).withColumn("left", F.when(good, c("left")).otherwise(F.raise_error(F.concat(F.lit("not a region: "), c(line))).cast("long")))
    else:
        out = out.filter(good)
    return out.drop(line)


def _literal(name: str) -> str:
    return re.escape(name)


def pairs(raw: DataFrame, line: str = "value") -> DataFrame:
    """attribute and value of lines of exactly two tab-separated fields."""
    kept = [c(x) for x in raw.columns if x != line]
    f = F.split(c(line), "\t")
    return raw.filter(F.size(f) == 2).select(*kept, F.trim(F.get(f, F.lit(0))).alias("attribute"), F.trim(F.get(f, F.lit(1))).alias("value"))


def _path() -> Column:
    """A line's file; Spark gives it as a URI, in which a plus sign is not encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path).select("value", _path().alias("__path"))


def file_text(spark: SparkSession, path: str) -> str:
    """A small text file, read through Spark's file systems."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"]


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _file_system(spark, path)
    return fs.exists(jpath)


def _has_meta(spark: SparkSession, path: str) -> bool:
    """Whether a folder or one below it has a metadata file; it stops at the first."""
    jpath, fs = _file_system(spark, path)
    found = fs.listFiles(jpath, True)
    while found.hasNext():
        if found.next().getPath().getName().endswith(".meta"):
            return True
    return False


def dataset_schema(spark: SparkSession, path: str) -> Schema:
    for name in ("schema.xml", "test.schema"):
        try:
            return parse(file_text(spark, f"{path}/{name}"))
        except Exception as e:  # noqa: BLE001  the reader's error classes differ by file system
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise ValueError(f"no schema.xml in {path}")


def read(spark: SparkSession, path: str, parser: Parser | str | None = None, strict: bool = False, name: str | None = None) -> Dataset:
    """The dataset in a folder: files with a ``.meta`` sibling are its samples.

    ``parser`` is a layout or its name; without one the folder's schema file decides.
    A folder stored by writers.write_text is read as that; one without any ``.meta`` file is an error.
    """
    from regionframe.sources.writers import read_text

    if isinstance(parser, str):
        parser = parser_named(parser)
    if _exists(spark, f"{path}/meta") and _exists(spark, f"{path}/files") and parser is None:
        return read_text(spark, path, name)
    if not _has_meta(spark, path):
        raise ValueError(f"{path} has no .meta file, so no sample; read_file reads region files without metadata")
    parser = parser or parser_of(dataset_schema(spark, path))
    raw = _files(spark, path)
    key = F.regexp_extract(F.col("__path"), r"([^/]+?)(?:\.meta)?$", 1)
    is_meta = F.col("__path").endswith(".meta")
    meta = pairs(raw.filter(is_meta).withColumn("sample_id", F.xxhash64(key)).drop("__path"))
    # every sibling is listed once; its own lines need not be read to know that it is there
    siblings = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta").load(path).select(F.xxhash64(F.regexp_extract("path", r"([^/]+?)\.meta$", 1)).alias("sample_id"))
    data = lines(raw.filter(~is_meta).withColumn("sample_id", F.xxhash64(key)).drop("__path"), parser, strict=strict)
    whole = Dataset.of(data.join(siblings, "sample_id", "left_semi"), meta, name)

    def opened(ids: DataFrame) -> DataFrame | None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta").load(path).select("path")
        listed = listed.withColumn("sample_id", F.xxhash64(F.regexp_extract("path", r"([^/]+?)\.meta$", 1)))
        chosen = [r["path"][: -len(".meta")] for r in listed.join(ids, "sample_id", "left_semi").select("path").limit(MOST_OPENED + 1).collect()]
        if not chosen or len(chosen) > MOST_OPENED:
            return None
        # a glob takes names with signs of its own by the letter
        some = spark.read.text([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in chosen]).select("value", F.xxhash64(F.regexp_extract(_path(), "([^/]+)$", 1)).alias("sample_id"))
        return Dataset.of(lines(some, parser, strict=strict), meta, name).regions

    return replace(whole, opened=opened)


def read_file(spark: SparkSession, path: str, parser: Parser | str = "bed", name: str | None = None) -> Dataset:
    """One region file without metadata: each sample gets a pair ``sampleID``."""
    parser = parser_named(parser) if isinstance(parser, str) else parser
    raw = _files(spark, path)
    data = lines(raw.withColumn("sample_id", F.xxhash64(F.regexp_extract("__path", "([^/]+)$", 1))).drop("__path"), parser)
    meta = data.select("sample_id", F.lit("sampleID").alias("attribute"), F.col("sample_id").cast("string").alias("value")).distinct()
    return Dataset.of(data, meta, name)


def read_parquet(spark: SparkSession, path: str, name: str | None = None) -> Dataset:
    """A dataset stored by writers.write_parquet."""
    return Dataset.of(spark.read.parquet(f"{path}/regions"), spark.read.parquet(f"{path}/meta"), name)
