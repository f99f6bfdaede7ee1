"""Connected components and density clusters over vector pairs (M8, M9)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot
from ..streaming.run import work_folder
from .vector_index import pairs_within


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that rounds don't pile up lineage."""
    path = f"{work_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """df as written(), dealt out by hash of the column while it is written: what is joined by it then moves to these rows, they don't move."""
    spark, name = df.sparkSession, f"spark_catalog.default.rows_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, column).option("path", f"{work_folder(spark)}/rows").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog; it has a path, so its files stay
    return out


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    # Within a lambda the norm would be computed for each coordinate.
    return F.when(norm > 0, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x.cast("double") / n))


#: Ids that a task remembers while it thins edges; then it begins anew.
MOST_IDS = 500_000


def thinned(edges: DataFrame) -> DataFrame:
    """a, b: of each task's edges those that join what its edges before don't, so that all hangs together as before. Nothing is shuffled."""
    kinds = dict(edges.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict = {}

        def find(x: object) -> object:
            while (up := top.setdefault(x, x)) != x:
                top[x] = x = top[up]
            return x

        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if a is not None and b is not None and (x := find(a)) != (y := find(b)):
                    top[x] = y
                    kept.append(i)
            if len(top) > MOST_IDS:
                top.clear()
            yield batch.take(pa.array(kept, pa.int64()))

    return edges.select("a", "b").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label (the least id that edges reach). nodes: id; edges: a, b, in one direction or both.

    Edges are thinned first, twice, since what is written is read again in fewer tasks. Each round takes the least label around
    and then the label of the label, so paths shrink by more than half.
    """
    edges = thinned(written(thinned(edges)))
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(nodes.select("id", F.col("id").alias("label")).distinct())
    while True:
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(around, labels["id"] == around["a"], "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        least = written(least)
        up = least.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = written(least.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = new.select("id", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def dbscan(vectors: DataFrame, id_col: str, vec_col: str, least: float, min_samples: int) -> DataFrame:
    """id, cluster: the least id of the core points that hang together, for border points the least of their core
    neighbours' clusters, -1 for noise. A point counts itself."""
    pairs = written(pairs_within(vectors, id_col, vec_col, least).select("a", "b"))
    ids = vectors.select(F.col(id_col).alias("id"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    core = written(ids.join(degree, "id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id"))
    known = core.distinct().withColumn("core", F.lit(True))
    for side in "ab":  # each pair moves once for each of its ends
        pairs = pairs.join(known.select(F.col("id").alias(side), F.col("core").alias(f"core_{side}")), side, "left")
    pairs = written(pairs.select("a", "b", "core_a", "core_b").filter("core_a or core_b"))
    labels = components(core, pairs.filter("core_a and core_b"))
    outer = pairs.filter("core_a is null").select(F.col("a").alias("id"), F.col("b").alias("core")).union(pairs.filter("core_b is null").select("b", "a"))
    border = outer.join(labels.withColumnRenamed("id", "core"), "core").groupBy("id").agg(F.min("label").alias("near"))
    return ids.join(labels, "id", "left").join(border, "id", "left").select("id", F.coalesce("label", "near", F.lit(-1)).alias("cluster"))
