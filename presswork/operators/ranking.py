"""Ranks and draws over whole tables without bringing a table to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import written


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows and their number (from 1) in the given order, which should have no ties.

    Rows are cut into ranges and written; a range's rows are numbered by themselves, after the counts of the ranges before
    it. Only the counts, a row for each range, pass through one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def first_by(rows: DataFrame, key: Column, n: Column, bits: int = 16) -> DataFrame:
    """The n rows (a Column over `total`, the number of rows) with the least keys, as the column chosen; key: hexadecimal text.

    Keys are counted by their first digits; only the rows of the digits at the edge are put in order.
    """
    keyed = rows.withColumn("_key", key).withColumn("_bin", F.substring("_key", 1, bits // 4))
    bins = keyed.groupBy("_bin").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_bin"))
    marked = bins.withColumn("_upto", upto).withColumn("total", F.sum("_n").over(Window.partitionBy())).withColumn("_wanted", n)
    at = F.broadcast(marked.select("_bin", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_left"), F.col("_n").alias("_in")))  # 2 ** bits rows at most
    joined = keyed.join(at, "_bin")
    edge = joined.filter("_left > 0 and _left < _in").withColumn("chosen", F.row_number().over(Window.partitionBy("_bin").orderBy("_key")) <= F.col("_left"))
    rest = joined.filter("not (_left > 0 and _left < _in)").withColumn("chosen", F.col("_left") > 0)
    return edge.unionByName(rest).drop("_key", "_bin", "_left", "_in")


def split(rows: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with is_test: ceil(test_size * rows) of them by a hash of id and seed; of fewer than five rows one, of one none."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    n = F.when(F.col("total") >= 5, F.ceil(F.col("total") * test_size)).when(F.col("total") > 1, 1).otherwise(0)
    return first_by(rows, key, n).withColumnRenamed("chosen", "is_test")
