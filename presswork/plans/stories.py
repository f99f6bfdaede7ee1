"""Short made-up news stories out of the keys of orders: texts in which the word lists have something to find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHO = ("President Anna Lee", "Governor John Hill", "Mr. Tom Park", "The committee", "Dr. Eve Stone", "Officials from Peter Wood", "Workers", "A spokesperson")
DID = ("announced", "rejected", "killed", "brokered", "ordered", "attacked", "gave support to", "mediated", "made a statement on")
WHAT = ("climate plans", "taxes", "the border", "unions", "healthcare", "the second amendment", "the free market", "a ceasefire", "immigration", "crime", "the administration", "faith and family")
WHERE = ("Chicago", "New York", "Ankara", "the city", "Germany", "Moscow", "the river state")


def stories(t) -> DataFrame:
    """id, source, who, did, what, place, text."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    o, p, s = F.col("o_orderkey"), F.col("o_custkey"), F.floor(F.col("o_orderkey") / 8) + F.col("o_custkey")
    rows = t.orders.select(o.alias("id"), F.col("o_orderstatus").alias("source"), pick(WHO, o).alias("who"), pick(DID, p).alias("did"), pick(WHAT, s).alias("what"), pick(WHAT, o + p).alias("more"), pick(WHERE, p).alias("place"))
    text = F.concat("who", F.lit(" "), "did", F.lit(" "), "what", F.lit(" in "), "place", F.lit(". People there spoke of "), "more", F.lit("."))
    return rows.select("id", "source", "who", "did", "what", "place", text.alias("text"))


def _pick(words: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][CAST(({n}) % {len(words)} + 1 AS INT)]"


STORIES = f"""stories AS (SELECT id, source, who, did, what, place, who || ' ' || did || ' ' || what || ' in ' || place || '. People there spoke of ' || more || '.' AS text FROM (
 SELECT o_orderkey AS id, o_orderstatus AS source, {_pick(WHO, 'o_orderkey')} AS who, {_pick(DID, 'o_custkey')} AS did, {_pick(WHAT, 'o_orderkey // 8 + o_custkey')} AS what, {_pick(WHAT, 'o_orderkey + o_custkey')} AS more, {_pick(WHERE, 'o_custkey')} AS place FROM orders))"""
