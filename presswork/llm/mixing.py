"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is shared among its documents in proportion to size and preference, but no document is expected more
often than max_copies times; what exceeds that goes to the others. So every document has its own expected number of
copies: the whole part is taken for certain, the fraction is its inclusion probability p. With u uniform from a keyed hash
of the document's id and text, documents are ranked by (u / (1 - u)) / (p / (1 - p)), smallest first, and taken in that
order until the words that the source still needs are reached: the document at the edge is taken if half of it or more fits.
By default longer documents are preferred mildly: 1 + floor(log2(size + 1)) / 8.

Ranks are found without bringing a source's documents together: the odds are cut into about sqrt(documents of the
source) bins, bins are summed first, and only bins, and then the documents of one bin, are put in order. The table of
sources, a row each, is put in order by one task.

Null texts have size 0; a null source is a source of its own, the last; rows that are equal in id and text tie and are
taken alike; very long texts are counted in place; other columns are not read; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Preferences are rounded to so many steps for each doubling, so that a source has a bounded number of them.
STEPS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int) -> Column:
    """A number between 0 and 1 out of seed, doc_id and text_key."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key"), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Column, max_copies: float) -> DataFrame:
    """source, source_size, n_docs, target for a table of (source, size).

    The words of all sources are shared by weight; what exceeds max_copies times a source's size goes to the others
    by weight, until none is above. Sources reach their cap in the order of cap over weight, so one pass over the
    ordered sources finds the common level.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    one = one.withColumn("rank", rank).withColumn("weight", weights.cast("double"))
    cap = F.col("source_size") * F.lit(float(max_copies))
    level = Window.orderBy(F.col("ratio"), F.col("rank"))
    one = (
        one.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.col("before")) / F.col("open_weight"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())["level"])
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return one.select("source", "source_size", "n_docs", target.alias("target"))


def copies_per_preference(sizes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """of, factor: a document of the source is expected least(max_copies, factor * like) times; null: max_copies times.

    A factor that leaves out the classes above a class is right if that class isn't above max_copies: the first such class counts.
    """
    classes = sizes.groupBy("source", "like").agg(F.sum("size").alias("words"))
    classes = classes.join(targets.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of")))
    above = Window.partitionBy("source").orderBy(F.col("like").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy(F.col("like").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("target") - max_copies * F.coalesce(F.sum("words").over(above), F.lit(0))
    classes = classes.withColumn("factor", F.try_divide(rest, F.sum(F.col("words") * F.col("like")).over(below)))
    right = F.col("factor") * F.col("like") <= max_copies
    return classes.groupBy("of").agg(F.max_by(F.when(right, F.col("factor")), F.when(right, F.col("like"))).alias("factor"))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Column | None = None, max_copies: int = 3, seed: int = 20240601, preference: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, text_key: how often and with how many words each document is taken.

    weights: an expression over the column rank (1 for the first source by code point); by default 1, 2, 3, repeating.
    preference: a positive number by document, to which its expected copies are proportional within its source.
    """
    text = F.col(text_col)
    size = word_count(text)
    like = preference.cast("double") if preference is not None else 1 + F.floor(F.log2(size + 1)) / 8
    like = F.pow(F.lit(2.0), F.round(F.log2(F.coalesce(like, F.lit(1.0))) * STEPS) / STEPS)
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("text_key"), like.alias("like")))
    weights = weights if weights is not None else (F.col("rank") - 1) % 3 + 1
    targets = written(source_targets(sizes, weights, max_copies))
    factors = copies_per_preference(sizes, targets, max_copies)
    of = written(targets.join(factors, targets["source"].eqNullSafe(factors["of"]), "left").select(targets["source"].alias("of"), "source_size", "n_docs", "target", "factor"))

    expected = F.when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(max_copies)), F.coalesce(F.col("factor") * F.col("like"), F.lit(float(max_copies)))))
    odds = lambda p: p / (1 - p)
    p = F.col("expected") - F.col("base")
    # The tables of sources are joined as their size asks for, without a hint.
    ranked = (
        sizes.join(of, sizes["source"].eqNullSafe(of["of"]))
        .withColumn("expected", expected)
        .withColumn("base", F.floor("expected"))
        .withColumn("u", uniform(seed))
        .withColumn("odds", F.when(p > 0, odds(F.col("u")) / odds(p)))
        .withColumn("bin", F.when(F.col("odds").isNotNull(), F.floor(F.col("odds") / (1 + F.col("odds")) * F.ceil(F.sqrt("n_docs")))))
    )
    bins = ranked.groupBy("source", "bin").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)).alias("bin_size"), F.sum(F.col("base") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    order = Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_first())
    bins = bins.withColumn("need", F.col("target") - F.sum("sure").over(Window.partitionBy("source"))).withColumn("bin_from", F.sum("bin_size").over(order) - F.col("bin_size"))
    edge = (
        bins.filter(F.col("bin").isNotNull())
        .groupBy("source")
        .agg(F.min(F.when(F.col("bin_from") + F.col("bin_size") > F.col("need"), F.struct("bin", "bin_from"))).alias("edge"), F.max("need").alias("need"))
        .select(F.col("source").alias("edge_of"), F.col("edge.bin").alias("edge_bin"), F.col("edge.bin_from").alias("edge_from"), "need")
    )
    edge = written(edge)
    ranked = ranked.join(edge, F.col("source").eqNullSafe(F.col("edge_of")), "left")
    tie = F.sum("size").over(Window.partitionBy("source", "bin", "odds"))
    upto = F.sum("size").over(Window.partitionBy("source", "bin").orderBy("odds").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at_edge = F.coalesce(F.col("bin") == F.col("edge_bin"), F.lit(False))
    inner = ranked.filter(at_edge).withColumn("tie", tie).withColumn("upto", upto).withColumn("more", (F.col("edge_from") + F.col("upto") - F.col("tie") / 2 <= F.col("need")).cast("long")).drop("tie", "upto")
    outer = ranked.filter(~at_edge).withColumn("more", (F.col("bin").isNotNull() & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")))).cast("long"))
    copies = F.col("base") + F.coalesce(F.col("more"), F.lit(0))
    return inner.unionByName(outer).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (copies * F.col("size")).cast("long").alias("taken"), "source", copies.cast("long").alias("copies"), "text_key")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that are taken, with all their columns and copies, taken and source_target.

    A document is told by its id, source and text, so rows of one id with different texts are told apart. If docs has a
    column of a new column's name, the new column gets an underscore before its name.
    """
    made = pareto_mix(docs, id_col, text_col, source_col, **options).filter("copies > 0").select("doc_id", "source", "text_key", "copies", "taken", "target").distinct()
    new = []
    for own, name in (("copies", "copies"), ("taken", "taken"), ("target", "source_target")):
        while name in docs.columns or name in new:
            name = f"_{name}"
        new.append(name)
        made = made.withColumnRenamed(own, name)
    same = docs[id_col].eqNullSafe(made["doc_id"]) & docs[source_col].cast("string").eqNullSafe(made["source"]) & (F.xxhash64(docs[text_col]) == made["text_key"])
    return docs.join(made, same).select(*(docs[c] for c in docs.columns), *(made[c] for c in new))
