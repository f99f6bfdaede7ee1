"""Scans of stores (S6, S7, S20, S23, S25), backfills and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 1000")
def S6_sorted_cursor(t):
    """The limit is part of the request; each task keeps its first thousand before rows move."""
    return t.documents.filter("lang = 'en'").select("doc_id", "source").orderBy(F.desc("doc_id")).limit(1000)


@query("SELECT doc_id, text FROM documents WHERE source = 'src3'")
def S7_one_source(t):
    return t.documents.filter("source = 'src3'").select("doc_id", "text")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100000")
def S20_vector_records(t):
    return t.embeddings.select("vec_id", "label").orderBy("vec_id").limit(100_000)


@query("SELECT user_id AS run_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY 1")
def S23_runs(t):
    e = t.events.withColumn("at", F.struct("ts", "event_id"))
    return e.groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("events"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.max_by("event_type", "at").alias("last_event"))


@query("SELECT doc_id, substr(text, 1, 60) AS title, substr(text, 1, 10000) AS text FROM documents")
def S25_graph_texts(t):
    return t.documents.select("doc_id", F.substring("text", 1, 60).alias("title"), F.substring("text", 1, 10_000).alias("text"))


@query("SELECT d.doc_id, CASE WHEN length(text) >= 128 THEN text END AS article, CASE WHEN length(text) < 128 THEN 'too short: ' || length(text) END AS fetch_error FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def K2_backfilled(t):
    """New values of the rows that a store lacks; the caller overwrites by key."""
    n = F.length("text")
    lacking = t.documents.select("doc_id", "text").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return lacking.select("doc_id", F.when(n >= 128, F.col("text")).alias("article"), F.when(n < 128, F.concat(F.lit("too short: "), n.cast("string"))).alias("fetch_error"))


@query("SELECT 'Documents: ' || count(*) || chr(10) || 'Characters: ' || sum(length(text)) || chr(10) || 'Newline runs: ' || sum(len(regexp_extract_all(text, '\\n\\n+'))) AS report FROM documents")
def K18_report(t):
    d = t.documents.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"\n\n+"))).alias("runs"))
    return d.select(F.format_string("Documents: %d\nCharacters: %d\nNewline runs: %d", "n", "chars", "runs").alias("report"))
