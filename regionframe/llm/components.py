"""Connected components of a link table, in rounds of neighbour minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.llm.store import written


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (a partial
    aggregate, so a star of any size is cheap) and then the label of the label.
    Labels are written to the shared folder each round; the driver sees one count.
    ``rows`` is a bound of the edges' number, if known: small tables then go to few files.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", rows and 2 * rows)
    n = both.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels", n)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        now = written(low.join(up, "comp").select("node", F.least("comp", "top").alias("comp"), (F.least("comp", "top") != F.col("old")).alias("moved")), "labels", n)
        labels = now.select("node", "comp")
        if not now.filter("moved").limit(1).count():
            return labels
