"""Region lines as a stream: parsed like files at rest, filtered or mapped against fixed datasets batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regionframe.model import Dataset
from regionframe.sources.readers import Parser, lines, parser_named


def read_stream(spark: SparkSession, path: str, parser: Parser | str = "bed") -> DataFrame:
    """Regions of the text files that appear under ``path``; a file is a sample."""
    layout = parser_named(parser) if isinstance(parser, str) else parser
    raw = spark.readStream.text(path).withColumn("sample_id", F.xxhash64(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)))
    return lines(raw, layout)


def map_stream(regions: DataFrame, fixed: Dataset, sink, checkpoint: str, **options) -> StreamingQuery:
    """Maps ``fixed`` onto each micro-batch of ``regions``; ``sink(dataset, batch id)`` stores the result.

    A batch that is run again after a failure has the same id, so a sink that
    overwrites by id holds every batch once.
    """

    def each(batch: DataFrame, number: int) -> None:
        meta = batch.select("sample_id", F.lit("batch").alias("attribute"), F.lit(str(number)).alias("value")).distinct()
        sink(Dataset.of(batch, meta, "batch").map(fixed, **options), number)

    return regions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
