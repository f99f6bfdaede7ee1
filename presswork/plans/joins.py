"""Joins (J*), graphs (S14, U2, J12) and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import cosine, tokens
from ..operators.ranking import global_rank
from .registry import query


@query("SELECT e.vec_id, e.label FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def J1_hits_in_ids(t):
    ids = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return t.embeddings.select("vec_id", "label").join(ids, "vec_id", "left_semi")


@query("SELECT l.doc_id, row_number() OVER (ORDER BY l.doc_id DESC) AS rank, d.source FROM labels l JOIN documents d USING (doc_id) ORDER BY rank LIMIT 50")
def J2_hydrated_hits(t):
    top = t.labels.select("doc_id").orderBy(F.desc("doc_id")).limit(50).withColumn("rank", F.row_number().over(W.orderBy(F.desc("doc_id"))).cast("long"))
    return t.documents.select("doc_id", "source").join(F.broadcast(top), "doc_id").select("doc_id", "rank", "source").orderBy("rank")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def J3_anti_join(t):
    return t.documents.select("doc_id").join(t.labels.filter("toxic = 1"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS skipped FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def J4_left_join_misses(t):
    l = t.labels.select("doc_id", F.lit(1).alias("hit"))  # noqa: E741
    return t.documents.join(l, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("skipped"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS zipped FROM conversations GROUP BY 1")
def J9_positional_zip(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    return t.conversations.groupBy("conv_id").agg(rows.alias("r")).select("conv_id", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["role"], x["n"].cast("string"))), ",").alias("zipped"))


@query("SELECT d.doc_id, l.quality, l.toxic, abs(l.quality - l.toxic) AS diff FROM documents d JOIN labels l USING (doc_id)")
def J10_compared(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id").select("doc_id", "quality", "toxic", F.abs(F.col("quality") - F.col("toxic")).alias("diff"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def J11_labels_joined(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


EDGES = "edges AS (SELECT DISTINCT source AS a, lang AS b FROM documents), nodes AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT a AS name FROM edges UNION SELECT b FROM edges))"


@query(f"WITH {EDGES} SELECT n.i AS source, m.i AS target FROM edges JOIN nodes n ON a = n.name JOIN nodes m ON b = m.name")
def J12_edge_indexes(t):
    e = t.documents.select(F.col("source").alias("a"), F.col("lang").alias("b")).distinct()
    nodes = e.select(F.col("a").alias("name")).union(e.select("b")).distinct()
    nodes = global_rank(nodes, [F.col("name")], "i").withColumn("i", (F.col("i") - 1).cast("long"))
    n, m = nodes.select(F.col("name").alias("a"), F.col("i").alias("source")), nodes.select(F.col("name").alias("b"), F.col("i").alias("target"))
    return e.join(n, "a").join(m, "b").select("source", "target")


@query("SELECT n_name, count(*) AS suppliers FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def J13_inner_summary(t):
    return t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"))


@query("SELECT DISTINCT lang AS name FROM documents UNION SELECT DISTINCT source FROM documents")
def U2_graph_nodes(t):
    return t.documents.select(F.col("lang").alias("name")).union(t.documents.select("source")).distinct()


@query("SELECT item_id, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark)")
def R5_unnested_words(t):
    each = t.benchmark.select("item_id", F.posexplode(tokens(F.col("text"))).alias("p", "word"))
    return each.select("item_id", (F.col("p") + 1).cast("long").alias("place"), "word")


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))) * sqrt(list_sum(list_transform(q, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))))), 5) AS cos FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)")
def J8_query_similarity(t):
    q = F.broadcast(t.embeddings.filter("vec_id = 7").select(F.col("embedding").alias("q")))
    return t.embeddings.crossJoin(q).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 5).alias("cos"))
