"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """v, label: the least vertex that each vertex of links (a, b) reaches. Vertices without a link don't appear.

    Each round takes the least label among neighbours and then the label of that label, so long chains shrink fast;
    labels are written after each round. Hub vertices are no trouble: minima are taken before rows move.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = table = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("further"))
        new = written(step.join(jump, "to", "left").select("v", "old", F.least("to", "further").alias("label")))
        dropped(table)
        table, labels = new, new.select("v", "label")
        if new.filter("old <> label").isEmpty():
            dropped(both)
            return labels
