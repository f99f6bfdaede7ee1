"""BM25 over a candidate set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """doc_id, score for a table of (doc_id, words). Negative IDFs become epsilon times the mean IDF of all terms.

    Statistics are of the candidate set, a row that is joined to each document; the few query terms are counted in place.
    """
    df = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    raw = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(n)).withColumn("raw", raw)  # n is one row
    own = [F.max(F.when(F.col("term") == t, F.col("raw"))).alias(f"raw{i}") for i, t in enumerate(terms)]
    stats = idf.agg(F.max("mean").alias("mean"), (F.avg("raw") * epsilon).alias("eps"), *own)  # one row, too
    times = lambda term: F.size(F.filter("words", lambda w: w == F.lit(term)))
    length, score = F.size("words"), F.lit(0.0)
    for i, t in enumerate(terms):
        tf = times(t)
        weight = F.coalesce(F.when(F.col(f"raw{i}") < 0, F.col("eps")).otherwise(F.col(f"raw{i}")), F.lit(0.0))
        score = score + F.when(tf > 0, weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("mean")))).otherwise(0.0)
    return docs.crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score"))
