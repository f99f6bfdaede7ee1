"""Saved feeds and saved responses (S3-S5): what a fetch without a network can be replayed from.

A fetcher stores each feed as an XML file and each try as a row (url, agent, status, body); from there everything is
a DataFrame. A live fetcher only has to fill these two stores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Status codes after which the next agent is tried.
REFUSED = (403, 429)


def saved_feed(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """title, link, published of the items of saved feeds; an item without a readable date was published now (S3)."""
    items = spark.read.format("xml").schema("title string, link string, pubDate string").option("rowTag", "item").load(path)
    formats = ("EEE, d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    date = F.regexp_replace(F.col("pubDate"), r"\s*(GMT|UTC|Z|\+0000)$", "")
    return items.select("title", "link", F.coalesce(F.try_to_timestamp(F.regexp_replace(date, r"^[A-Za-z]{3}, ", ""), F.lit(formats[0][5:])), F.try_to_timestamp(date, F.lit(formats[1])), now).alias("published"))


def by_agents(tries: DataFrame, agents: DataFrame) -> DataFrame:
    """url, agent, body, how of the try that a rotation of agents would have ended with (S4). agents: agent, place; tries: url, agent, status, body.

    Agents are tried in order of place as long as they are refused; any other status ends the rotation. If all are
    refused the external fallback is asked, here as how = external without a body.
    """
    ranked = tries.join(F.broadcast(agents), "agent")  # a short list
    first = F.min(F.when(~F.col("status").isin(*REFUSED), F.struct("place", "agent", "status", "body"))).alias("x")
    each = ranked.groupBy("url").agg(first)
    how = F.when(F.col("x").isNull(), "external").when(F.col("x.status") == 200, "fetched").otherwise(F.concat(F.lit("HTTP "), F.col("x.status").cast("string")))
    return each.select("url", F.col("x.agent").alias("agent"), F.when(F.col("x.status") == 200, F.col("x.body")).alias("body"), how.alias("how"))


def fetched(responses: DataFrame, seconds: float = 15.0) -> DataFrame:
    """url, body, error: only an answer of status 200 in time counts (S5). responses: url, status, seconds, body."""
    error = F.when(F.col("seconds") > seconds, "timeout").when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return responses.select("url", F.when(error.isNull(), F.col("body")).alias("body"), error.alias("error"))
