"""Bias labels: dominant keys, confidence, allocation of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dominant(values: dict[str, Column]) -> Column:
    """The key of the largest value; the first of equals."""
    names = list(values)
    out = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        rest = [values[n] for n in names[i + 1 :]]
        most = F.greatest(*rest) if len(rest) > 1 else rest[0]
        out = F.when(values[names[i]] >= most, names[i]).otherwise(out)
    return out


def confidence_mean_of_max(a: list[Column], b: list[Column]) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.greatest(*a) + F.greatest(*b)) / 2))


def confidence_above_mean(a: list[Column], b: list[Column]) -> Column:
    over = lambda x: F.greatest(*x) - sum(x[1:], x[0]) / len(x)
    return F.least(F.lit(1.0), (over(a) + over(b)) / 2)


def normalised(values: list[Column]) -> list[Column]:
    """Each over the sum, only if the sum is positive."""
    total = sum(values[1:], values[0])
    return [F.when(total > 0, F.try_divide(v, total)).otherwise(v) for v in values]


def allocate(bins: DataFrame, key: str, avail: str, least: int, total: int) -> DataFrame:
    """quota by bin: least of each (or what it has), then the remainder to bins in order of key until it is used up."""
    base = F.least(F.col(avail), F.lit(least))
    out = bins.withColumn("base", base).withColumn("room", F.col(avail) - F.col("base"))
    everything = out.agg(F.sum("base").alias("all_base"))
    before = F.coalesce(F.sum("room").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.crossJoin(F.broadcast(everything)).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("room"), F.lit(total) - F.col("all_base") - before)))
    return out.select(key, avail, (F.col("base") + F.col("extra")).cast("long").alias("quota"))


def balanced_sample(rows: DataFrame, bins: DataFrame, key: str, id_col: str, seed: int = 42) -> DataFrame:
    """quota rows of each bin, chosen by a hash of the id."""
    order = Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    return rows.join(bins.select(key, "quota"), key).withColumn("rn", F.row_number().over(order)).filter("rn <= quota").drop("rn", "quota")


def synthetic(spark, per_pair: int, seed: int = 42) -> DataFrame:
    """number, dir, deg, dl, dc, dr, gl, gm, gh: per_pair made-up records for each of nine pairs of leading keys.

    A leading key is 0.50 to 0.85 and the others 0.05 to 0.25, by a hash of the number, then all are shares of their sum.
    """
    get = lambda keys, i: F.get(F.array(*map(F.lit, keys)), i.cast("int"))
    rows = spark.range(9 * per_pair).select(F.col("id").alias("number"))
    rows = rows.select("number", get("LCR", F.col("number") % 3).alias("dir"), get("LMH", F.floor(F.col("number") % 9 / 3)).alias("deg"))
    out = []
    for axis, short, keys in (("dir", "d", "LCR"), ("deg", "g", "LMH")):
        raw = []
        for k in keys:
            digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("number").cast("string"), F.lit(f":{short}{k}")))
            u = F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") / (1 << 24)
            raw.append(F.when(F.col(axis) == k, F.round(0.5 + 0.35 * u, 2)).otherwise(F.round(0.05 + 0.2 * u, 2)))
        out += [F.round(x / (raw[0] + raw[1] + raw[2]) + 1e-9, 2).alias(f"{short}{k.lower()}") for x, k in zip(raw, keys, strict=True)]
    return rows.select("number", "dir", "deg", *out)
