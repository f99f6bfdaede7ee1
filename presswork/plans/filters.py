"""Filters and projections (P*), the filter-document compiler."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import filters as f
from .articles import ART, ENT, SCO, articles, entities, scores
from .registry import query

D = dt.datetime


@query(f"WITH {ART} SELECT id, source FROM articles WHERE article IS NOT NULL AND coalesce(fetch_error, '') = ''")
def P1_valid_articles(t):
    return articles(t).filter(f.valid_article()).select("id", "source")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 12:00:00'")
def P2_date_range(t):
    return t.events.filter(f.date_range("ts", D(2024, 1, 5), D(2024, 1, 12, 12))).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-23 00:00:00'")
def P3_relative_date(t):
    return t.events.filter(f.date_range("ts", f.parse_date_arg("-7", D(2024, 1, 30)))).select("event_id")


@query(f"WITH {ENT} SELECT DISTINCT a.id AS id FROM ent a WHERE a.label = 'PERSON' AND a.text = 'Thshly' OR a.text = 'Then' OR a.label = 'GPE' AND a.text = 'That'")
def P5_entities_any(t):
    return entities(t).filter(f.entity_filter("entities", any_of=f.parse_entities("PERSON/Thshly, Then, GPE/That"))).select("id")


@query(f"WITH {ENT} SELECT id FROM ents WHERE list_contains(names, 'That') AND EXISTS (SELECT 1 FROM ent e WHERE e.id = ents.id AND e.label = 'PERSON')")
def P5_entities_all(t):
    return entities(t).filter(f.entity_filter("entities", all_of=f.parse_entities("That, PERSON/"))).select("id")


@query(f"WITH {ENT} SELECT DISTINCT id FROM ent WHERE contains(text, 'The') OR contains(text, 'ou')")
def P6_entity_names(t):
    e = entities(t).select("id", F.to_json(F.col("entities.text")).alias("names"))
    return e.filter(f.names_match("names", ["The", "ou"], substring=True)).select("id")


@query(f"WITH {ENT} SELECT DISTINCT id FROM ent WHERE regexp_matches(text, '(?i)^th.*n$')")
def P7_entity_regex(t):
    return entities(t).filter(f.entity_regex("entities", "^th.*n$")).select("id")


@query(f"WITH {ART} SELECT id FROM articles WHERE contains(lower(article), 'the') AND contains(lower(article), 'and') AND (contains(lower(article), 'stupid') OR contains(lower(article), 'token'))")
def P8_terms(t):
    return articles(t).filter(f.has_terms("article", ["The", "and"], ["stupid", "token"])).select("id")


@query(f"WITH {ART} SELECT id FROM articles WHERE contains(lower(article), 'licensed under') OR contains(lower(article), 'mit license')")
def P9_phrases(t):
    return articles(t).filter(f.has_terms("article", any_of=["licensed under", "mit license"])).select("id")


@query(f"WITH {ART} SELECT id FROM articles WHERE regexp_matches(article, '(?i)apache license,? version [0-9]')")
def P10_regex_search(t):
    return articles(t).filter(F.col("article").rlike("(?i)apache license,? version [0-9]")).select("id")


@query("SELECT doc_id AS id, source FROM documents WHERE source IN ('src1', 'src2', 'src7')")
def P11_sources(t):
    return t.documents.filter(F.col("source").isin("src1", "src2", "src7")).select(F.col("doc_id").alias("id"), "source")


@query(f"WITH {ART} SELECT id FROM articles WHERE list_contains(tags, 'fr') OR list_contains(tags, 't3')")
def P12_tags(t):
    return articles(t).filter(F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("t3")))).select("id")


@query(f"WITH {ART} SELECT id FROM articles WHERE article IS NOT NULL AND NOT (length(article) < 128)")
def P13_hide_short(t):
    return articles(t).withColumn("too_short", F.length("article") < 128).filter(F.col("article").isNotNull() & ~F.coalesce("too_short", F.lit(False))).select("id")


@query(f"WITH {ART} SELECT id FROM articles WHERE coalesce(bias, '') = '' AND coalesce(article, '') <> '' AND published >= TIMESTAMP '2024-01-10'")
def P14_needs_bias(t):
    return articles(t).filter(f.blank("bias") & ~f.blank("article") & f.date_range("published", D(2024, 1, 10))).select("id")


@query(f"WITH {ART} SELECT id FROM articles WHERE coalesce(bias, '') = '' AND (coalesce(fetch_error, '') = '' OR coalesce(article, '') = '')")
def P15_empty_fields(t):
    return articles(t).filter(f.empty_fields(["bias"], ["fetch_error", "article"])).select("id")


@query("SELECT d.doc_id AS id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def P16_id_list(t):
    ids = t.labels.filter("quality = 1").select("doc_id")
    return t.documents.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"))


@query("SELECT json_type(props) AS kind, count(*) AS n FROM events GROUP BY 1")
def P17_value_kinds(t):
    v = F.schema_of_variant(F.try_parse_json("props"))
    kind = F.when(v.startswith("OBJECT"), "OBJECT").when(v.startswith("ARRAY"), "ARRAY").otherwise("SCALAR")
    return t.events.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate <= TIMESTAMP '1995-03-31 23:59:59') OR (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-03-31 23:59:59')")
def P18_any_date(t):
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.filter(f.any_date_range(["l_shipdate", "o_orderdate"], D(1995, 1, 1), dt.date(1995, 3, 31))).select("l_orderkey", "l_linenumber")


@query(f"WITH {ART} SELECT id, substr(body, 1, 50000) AS body FROM (SELECT id, published, coalesce(nullif(article, ''), title) AS body FROM articles) WHERE length(body) >= 50 AND published >= TIMESTAMP '2024-01-05'")
def P19_eligible_for_ner(t):
    body = F.coalesce(F.nullif("article", F.lit("")), "title")
    return articles(t).filter(f.date_range("published", D(2024, 1, 5))).select("id", body.alias("body")).filter(F.length("body") >= 50).withColumn("body", F.substring("body", 1, 50000))


@query("SELECT doc_id AS id FROM documents WHERE strlen(text) >= 128")
def P20_least_bytes(t):
    return t.documents.filter(F.octet_length("text") >= 128).select(F.col("doc_id").alias("id"))


@query(f"WITH {ENT} SELECT label, text, count(*) AS n FROM ent WHERE label IN ('PERSON', 'GPE') AND NOT contains(source, 'src1') GROUP BY 1, 2")
def P21_kept_entities(t):
    e = entities(t).filter(~F.contains("source", F.lit("src1"))).select(F.explode("entities").alias("e")).select("e.label", "e.text")
    return e.filter(F.col("label").isin("PERSON", "GPE", "LOC", "EVENT")).groupBy("label", "text").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def P22_not_yet_done(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


@query("SELECT event_id, round(value, 4) AS value FROM events WHERE 1 - value / 100 >= 0.6")
def P23_similarity_threshold(t):
    return t.events.filter(1 - F.col("value") / 100 >= 0.6).select("event_id", F.round("value", 4).alias("value"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND o_orderdate >= TIMESTAMP '1996-01-01'")
def P24_plausible_dates(t):
    return t.orders.filter(F.try_to_timestamp(F.col("o_orderdate").cast("string")) >= F.lit(D(1996, 1, 1))).select("o_orderkey")


@query(f"WITH {ART} SELECT id, source, title, strftime(published, '%Y-%m-%d') AS day FROM articles")
def P25_projection(t):
    return articles(t).drop("article").select("id", "source", "title", F.date_format("published", "yyyy-MM-dd").alias("day"))


@query(f"WITH {SCO} SELECT id FROM scores WHERE greatest(dl, dc, dr) >= 0.7 AND greatest(gl, gm, gh) >= 0.8")
def P26_dominant(t):
    return scores(t).filter((F.greatest("dl", "dc", "dr") >= 0.7) & (F.greatest("gl", "gm", "gh") >= 0.8)).select("id")


@query(f"WITH {ART} SELECT id FROM articles WHERE bias IS NULL")
def P28_without_bias(t):
    return articles(t).filter(F.col("bias").isNull()).select("id")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def P29_selected_sources(t):
    return t.events.filter(F.col("event_type").isin("click", "view", "purchase")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id FROM documents WHERE length(text) >= 100")
def P30_least_chars(t):
    return t.documents.filter(F.length("text") >= 100).select(F.col("doc_id").alias("id"))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50")
def P31_nested_score(t):
    return t.events.filter(F.try_variant_get(F.try_parse_json("props"), "$.k", "double") > 50).select("event_id")


@query(f"WITH {ART} SELECT id FROM articles WHERE article IS NOT NULL AND (fetch_error IS NULL OR fetch_error = '') AND source IN ('src1', 'src3') AND published >= TIMESTAMP '2024-01-02' AND regexp_matches(article, '(?i)the') AND (bias IS NULL OR bias <> '')")
def C1_filter_document(t):
    doc = {"$and": [{"article": {"$exists": True}}, {"$or": [{"fetch_error": None}, {"fetch_error": ""}]}], "source": {"$in": ["src1", "src3"]}, "published": {"$gte": D(2024, 1, 2)}, "article": {"$regex": "the", "$options": "i"}, "bias": {"$ne": ""}}
    return articles(t).filter(f.compile_filter(doc)).select("id")
