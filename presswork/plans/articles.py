"""The test tables seen as news articles; the same views as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = "[A-Z][a-z]{3,}"


def articles(t) -> DataFrame:
    """id, source, title, article, fetch_error, published, lang, bias (JSON text, empty or null), tags."""
    i = F.col("doc_id")
    return t.documents.select(
        i.alias("id"),
        "source",
        F.substring("text", 1, 60).alias("title"),
        F.when(i % 23 == 0, None).otherwise(F.col("text")).alias("article"),
        F.when(i % 17 == 0, "timeout").when(i % 5 == 0, "").alias("fetch_error"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 2000 as int))").alias("published"),
        "lang",
        F.when(i % 3 == 0, "").when(i % 3 == 1, F.lit('{"dir":1}')).alias("bias"),
        F.array_distinct(F.array("lang", F.concat(F.lit("t"), (i % 4).cast("string")))).alias("tags"),
    )


ART = """articles AS (SELECT doc_id AS id, source, substr(text, 1, 60) AS title,
 CASE WHEN doc_id % 23 = 0 THEN NULL ELSE text END AS article,
 CASE WHEN doc_id % 17 = 0 THEN 'timeout' WHEN doc_id % 5 = 0 THEN '' END AS fetch_error,
 TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 2000) AS published, lang,
 CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '{"dir":1}' END AS bias,
 [lang, 't' || CAST(doc_id % 4 AS VARCHAR)] AS tags FROM documents)"""


def entities(t) -> DataFrame:
    """id, entities: array of (text, label) from capitalised words."""
    names = F.regexp_extract_all("text", F.lit(NAME), F.lit(0))
    one = lambda x: F.struct(x.alias("text"), F.when(F.length(x) % 3 == 0, "PERSON").when(F.length(x) % 3 == 1, "GPE").otherwise("ORG").alias("label"))
    return t.documents.select(F.col("doc_id").alias("id"), "source", "lang", F.transform(names, one).alias("entities"))


ENT = f"""ents AS (SELECT doc_id AS id, source, lang, regexp_extract_all(text, '{NAME}') AS names FROM documents),
 ent AS (SELECT id, source, lang, e.pos AS pos, e.t AS text, CASE WHEN length(e.t) % 3 = 0 THEN 'PERSON' WHEN length(e.t) % 3 = 1 THEN 'GPE' ELSE 'ORG' END AS label
  FROM (SELECT id, source, lang, unnest(list_transform(range(1, len(names) + 1), lambda i: struct_pack(pos := i, t := names[i]))) AS e FROM ents))"""


def scores(t) -> DataFrame:
    """id, source, day, dl dc dr (direction), gl gm gh (degree): each axis sums to 1."""
    q, d, x = F.col("l_quantity"), F.col("l_discount") * 100 + 1, F.col("l_tax") * 100 + 1
    s, g = q + d + x, q + 2 * d + 1
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("published"), (q / s).alias("dl"), (d / s).alias("dc"), (x / s).alias("dr"), (d / g).alias("gl"), (F.lit(1.0) / g).alias("gm"), ((q + d) / g).alias("gh"))


SCO = """scores AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS source, l_shipdate AS published,
 q / (q + d + x) AS dl, d / (q + d + x) AS dc, x / (q + d + x) AS dr, d / (q + 2 * d + 1) AS gl, 1.0 / (q + 2 * d + 1) AS gm, (q + d) / (q + 2 * d + 1) AS gh
 FROM (SELECT *, l_quantity AS q, l_discount * 100 + 1 AS d, l_tax * 100 + 1 AS x FROM lineitem))"""
