"""Search: exact vector top-k (T4, J8) and BM25 re-ranking (T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cosine, tokens
from ..operators.search import bm25
from ..operators.vector_index import VectorIndex, search_within
from .registry import query

NORM = "sqrt(list_sum(list_transform({0}, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))))"


@query(f"SELECT vec_id, round(cos, 5) AS cos FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) / ({NORM.format('embedding')} * {NORM.format('q')}) AS cos FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 3)) ORDER BY cos DESC, vec_id LIMIT 20")
def T4_nearest_vectors(t):
    q = F.broadcast(t.embeddings.filter("vec_id = 3").select(F.col("embedding").alias("q")))
    hits = t.embeddings.crossJoin(q).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("cos"))
    return hits.orderBy(F.desc("cos"), "vec_id").limit(20).select("vec_id", F.round("cos", 5).alias("cos"))


@query("""WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents WHERE source = 'src5'),
tok AS (SELECT doc_id, unnest(w) AS term FROM c), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM c),
idf AS (SELECT term, ln((n.n - df + 0.5) / (df + 0.5)) AS raw FROM df, n), floor_ AS (SELECT 0.25 * avg(raw) AS eps FROM idf)
SELECT c.doc_id, round(coalesce(sum(CASE WHEN raw < 0 THEN eps ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(c.w) / n.mean))), 0), 6) AS score
FROM c CROSS JOIN n CROSS JOIN floor_ LEFT JOIN tf ON tf.doc_id = c.doc_id AND tf.term IN ('the', 'license', 'stupid') LEFT JOIN idf USING (term) GROUP BY c.doc_id""")
def T5_bm25(t):
    docs = t.documents.filter("source = 'src5'").select("doc_id", tokens(F.col("text")).alias("words"))
    return bm25(docs, ["the", "license", "stupid"]).select("doc_id", F.round("score", 6).alias("score"))


ALL_PAIRS = f"p AS (SELECT a.vec_id AS query, b.vec_id AS vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) / ({NORM.format('a.embedding')} * {NORM.format('b.embedding')}) AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cos, 12) DESC, vec_id) AS rank FROM p)"


@query(f"WITH {ALL_PAIRS} SELECT query, CAST(rank AS INTEGER) AS rank, vec_id, round(cos, 5) AS cos FROM r WHERE rank <= 10")
def T4_index_search(t):
    """The ten nearest of every hundredth vector, by the stored index in its exact mode."""
    index = VectorIndex.build(t.embeddings, "vec_id", "embedding")
    hits = index.search(t.embeddings.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, exact=True)
    return hits.select("query", "rank", F.col("id").alias("vec_id"), F.round("cos", 5).alias("cos"))


@query(f"WITH {ALL_PAIRS}, d AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM r WHERE rank <= 100 AND vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 2000 < 400)) SELECT query, CAST(place AS INTEGER) AS rank, vec_id, round(cos, 5) AS cos FROM d WHERE place <= 5")
def T4_dated_search(t):
    """The five best published up to a date, out of 20 times as many hits."""
    from .articles import articles

    index = VectorIndex.build(t.embeddings, "vec_id", "embedding")
    dated = articles(t).filter(F.col("published") < F.expr("timestamp_ntz'2024-01-17 16:00:00'")).select("id")
    hits = search_within(index, t.embeddings.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5, dated, over=20, exact=True)
    return hits.select("query", "rank", F.col("id").alias("vec_id"), F.round("cos", 5).alias("cos"))
