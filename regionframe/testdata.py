"""Star-schema tables read as interval datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionframe.model import Dataset


#: Metadata of each folder, held in Spark's storage: every branch of a query reads it, and it is small.
_HELD: dict[tuple[str, str], DataFrame] = {}


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        _HELD[key] = _built(spark, sf_dir).coalesce(1).persist()
    return _HELD[key]


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    ids = spark.range(10).withColumnRenamed("id", "sample_id")
    plain = ids.selectExpr(
        "sample_id",
        "explode(filter(array(named_struct('attribute', 'group', 'value', concat('g', sample_id % 3)), named_struct('attribute', 'batch', 'value', concat('b', sample_id % 2)),"
        " named_struct('attribute', 'batch', 'value', concat('b', sample_id % 5)), named_struct('attribute', 'weight', 'value', CAST(CAST(sample_id * 1.5 AS DOUBLE) AS STRING)),"
        " IF(sample_id % 2 = 1, named_struct('attribute', 'odd', 'value', 'yes'), NULL)), x -> x IS NOT NULL)) AS x",
    ).selectExpr("sample_id", "x.attribute", "x.value")
    nations = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).selectExpr("CAST(s_suppkey % 10 AS BIGINT) AS sample_id", "'nation' AS attribute", "n_name AS value")
    return plain.unionByName(nations).distinct()


def items(spark: SparkSession, sf_dir: str, parity: int | None = None) -> Dataset:
    """Order lines: ten samples by supplier; even or odd ones with ``parity``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "CAST(l_suppkey % 10 AS BIGINT) AS sample_id", "concat('chr', l_linenumber) AS chrom", "CAST(l_partkey * 20 AS BIGINT) AS left", "CAST(l_partkey * 20 + CAST(l_quantity AS BIGINT) AS BIGINT) AS right",
        "CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '*' END AS strand", "l_extendedprice AS score", "l_discount AS discount", "l_tax AS tax", "l_linestatus AS linestatus",
    )
    meta = _meta(spark, sf_dir)
    if parity is not None:
        lines, meta = lines.filter(f"sample_id % 2 = {parity}"), meta.filter(f"sample_id % 2 = {parity}")
    return Dataset.of(lines, meta, None if parity is None else ("E", "O")[parity])


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    """Events: ten samples by user, event types as chromosomes, seconds as positions."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "CAST(user_id % 10 AS BIGINT) AS sample_id", "event_type AS chrom", "unix_seconds(CAST(ts AS TIMESTAMP)) AS left", "unix_seconds(CAST(ts AS TIMESTAMP)) + 1 + CAST(floor(value * 50) AS BIGINT) AS right", "'*' AS strand", "value"
    )
    return Dataset.of(rows, _meta(spark, sf_dir))
