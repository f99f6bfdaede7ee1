"""Boilerplate: lines that stand in several articles of one source, found and removed.

Lines are told apart by a hash first: only source, hash and article are shuffled for all lines, and the lines themselves
only where the hash comes in several articles. What is removed is told by places, so articles move once, as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_line, strip

LEAST_LINE, LEAST_NORM = 10, 5


def article_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, pos, line, norm."""
    lines = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return lines.withColumn("norm", normalise_line(F.col("line")))


def long_lines(lines: DataFrame, least_line: int = LEAST_LINE, least_norm: int = LEAST_NORM) -> DataFrame:
    """The lines that are long enough to count, with h, a hash of norm."""
    return lines.filter((F.length(strip(F.col("line"))) >= least_line) & (F.length("norm") >= least_norm)).withColumn("h", F.xxhash64("norm"))


def repeated_lines(lines: DataFrame, least_line: int = LEAST_LINE, least_norm: int = LEAST_NORM) -> DataFrame:
    """source, norm, n_docs, sample: normalised lines in more than one article of a source.

    Occurrences are first reduced to one row for each (source, line, article), so a line that stands in most articles
    of a large source is counted in partial sums.
    """
    long = long_lines(lines, least_line, least_norm)
    several = long.select("source", "h", "id").distinct().groupBy(F.col("source").alias("s"), F.col("h").alias("g")).agg(F.count("*").alias("n")).filter("n > 1")
    some = long.join(several, F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("g")), "left_semi")
    once = some.groupBy("source", "norm", "id").agg(F.min(F.struct("pos", "line")).alias("at"))
    all_ = once.groupBy("source", "norm").agg(F.count("*").alias("n_docs"), F.min(F.struct("id", F.col("at.pos").alias("pos"), F.col("at.line").alias("line"))).alias("first"))
    return all_.filter("n_docs > 1").select("source", "norm", "n_docs", F.col("first.line").alias("sample"))


def remove_lines(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, n_lines, n_removed, text: articles that have a text, without repeated lines, in order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).filter("text is not null")
    keyed = rows.withColumn("key", F.xxhash64("text"))
    lines = keyed.select("id", "source", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("norm", normalise_line(F.col("line")))
    hit = repeated.select(F.col("source").alias("s"), F.col("norm").alias("n"))
    gone = long_lines(lines).select("id", "source", "key", "pos", "norm").join(hit, F.col("source").eqNullSafe(F.col("s")) & (F.col("norm") == F.col("n")))
    gone = gone.groupBy(F.col("id").alias("of"), F.col("key").alias("of_key"), F.col("source").alias("of_source")).agg(F.collect_set("pos").alias("gone"))
    marked = keyed.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    cut = marked.select("id", "source", F.split("text", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    body = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return cut.select("id", "source", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), body.alias("text"))
