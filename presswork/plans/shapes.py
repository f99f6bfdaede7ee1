"""Sorts, limits, pages and top-k (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .articles import ENT, entities
from ..operators.ranking import global_rank
from .registry import query


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def T1_newest_first(t):
    return t.orders.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT doc_id, (SELECT count(*) FROM documents) AS total, CAST(ceil((SELECT count(*) FROM documents) / 20.0) AS BIGINT) AS pages FROM (SELECT doc_id FROM documents ORDER BY source, doc_id LIMIT 20 OFFSET 40)")
def T2_page(t):
    total = t.documents.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("pages"))
    return t.documents.orderBy("source", "doc_id").offset(40).limit(20).select("doc_id").crossJoin(F.broadcast(total))


@query(f"WITH {ENT} SELECT label, text, n, row_number() OVER (ORDER BY n DESC, label, text) AS rank FROM (SELECT label, text, count(DISTINCT id) AS n FROM ent GROUP BY 1, 2) ORDER BY n DESC, label, text LIMIT 50")
def T6_most_frequent_entities(t):
    n = entities(t).select(F.explode(F.array_distinct("entities")).alias("e")).groupBy("e.label", "e.text").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "label", "text").limit(50)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "label", "text")).cast("long"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(coalesce(nullif(p_brand, ''), 'Uncategorized')), lower(p_type), lower(p_name), p_partkey) AS rank FROM part")
def T7_case_insensitive_sort(t):
    brand = F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("Uncategorized"))
    keyed = t.part.select("p_partkey", F.lower(brand).alias("a"), F.lower("p_type").alias("b"), F.lower("p_name").alias("c"))
    return global_rank(keyed, [F.col(c) for c in ("a", "b", "c", "p_partkey")]).select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS rank FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def T8_clusters_by_size(t):
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "label")).cast("long"))


@query("SELECT event_type AS agent, round(coalesce(ok / nullif(ok + bad, 0), 0), 6) AS rate FROM (SELECT event_type, count(*) FILTER (WHERE value > 50) AS ok, count(*) FILTER (WHERE value <= 50) AS bad FROM events GROUP BY 1)")
def T12_agents_by_success(t):
    a = t.events.groupBy(F.col("event_type").alias("agent")).agg(F.count_if(F.col("value") > 50).alias("ok"), F.count_if(F.col("value") <= 50).alias("bad"))
    rate = F.coalesce(F.try_divide("ok", F.col("ok") + F.col("bad")), F.lit(0.0))
    return a.select("agent", F.round(rate, 6).alias("rate")).orderBy(F.desc("rate"), "agent")


@query("SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'token') THEN 8 ELSE 0 END + CASE WHEN contains(lower(text), 'the ') THEN 4 ELSE 0 END AS score FROM documents) WHERE score > 3")
def T13_scored_relations(t):
    has = lambda w, n: F.when(F.contains(F.lower("text"), F.lit(w)), n).otherwise(0)
    return t.documents.select("doc_id", (has("license", 10) + has("token", 8) + has("the ", 4)).alias("score")).filter("score > 3")


@query("SELECT user_id, string_agg(event_type, ', ' ORDER BY value DESC, event_id) AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3 GROUP BY 1")
def T14_three_best(t):
    w = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = t.events.withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    names = F.array_sort(F.collect_list(F.struct("rn", "event_type")))
    return top.groupBy("user_id").agg(names.alias("n")).select("user_id", F.array_join(F.transform("n", lambda x: x["event_type"]), ", ").alias("best"))


@query("SELECT event_id, round(value, 4) AS value FROM events WHERE value >= 90 ORDER BY value DESC, event_id LIMIT 20")
def T15_threshold_sort_limit(t):
    return t.events.filter("value >= 90").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", F.round("value", 4).alias("value"))


@query("SELECT DISTINCT source FROM documents ORDER BY source LIMIT 4")
def T16_first_sources(t):
    return t.documents.select("source").distinct().orderBy("source").limit(4)


@query("SELECT substr(CAST(doc_id AS VARCHAR), 1, 12) AS id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS title FROM documents ORDER BY doc_id LIMIT 10")
def T20_head_sample(t):
    from ..functions.text import truncate

    return t.documents.orderBy("doc_id").limit(10).select(F.substring(F.col("doc_id").cast("string"), 1, 12).alias("id"), truncate(F.col("text"), 60).alias("title"))
