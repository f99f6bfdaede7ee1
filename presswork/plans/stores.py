"""What writers store (K*), training rows (M15, M16) and repaired records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bias_json as bj
from ..operators.keyed import KeyedTable
from .registry import query


@query("SELECT count(*) FILTER (WHERE length(text) >= 128 AND l.doc_id IS NULL) AS added, count(*) FILTER (WHERE length(text) < 128) AS too_short, count(*) FILTER (WHERE length(text) >= 128 AND l.doc_id IS NOT NULL) AS skipped FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def K1_insert_if_absent(t):
    there = t.labels.select("doc_id", F.lit(True).alias("there")).distinct()
    d = t.documents.select("doc_id", F.length("text").alias("n")).join(there, "doc_id", "left")
    return d.agg(*(F.count_if(F.expr(rule)).alias(name) for name, rule in (("added", "n >= 128 and there is null"), ("too_short", "n < 128"), ("skipped", "n >= 128 and there"))))


@query("SELECT string_agg(source || '=' || n, ',' ORDER BY source) AS stats FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def K3_source_counts(t):
    n = t.documents.groupBy("source").count()
    each = F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "count"))))
    return n.agg(F.array_join(F.transform(each, lambda x: F.concat_ws("=", x["source"], x["count"].cast("string"))), ",").alias("stats"))


@query("SELECT d.doc_id, coalesce(CAST(q AS VARCHAR), lang) AS forced, coalesce(lang, CAST(q AS VARCHAR)) AS kept FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id")
def K6_set_field(t):
    new = t.labels.groupBy("doc_id").agg(F.max("quality").cast("string").alias("q"))
    d = t.documents.select("doc_id", "lang").join(new, "doc_id", "left")
    return d.select("doc_id", F.coalesce("q", "lang").alias("forced"), F.coalesce("lang", "q").alias("kept"))


@query("SELECT doc_id, source || chr(9) || doc_id || chr(9) || translate(text, chr(9) || chr(10) || chr(13), '   ') AS line FROM documents")
def K7_title_lines(t):
    return t.documents.select("doc_id", F.concat(F.col("source"), F.lit("\t"), F.col("doc_id").cast("string"), F.lit("\t"), F.translate("text", "\t\n\r", "   ")).alias("line"))


@query("SELECT category_id, category_name, article_count, doc_id // 1000 AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS articles FROM documents JOIN (SELECT row_number() OVER (ORDER BY source) AS category_id, source AS category_name, count(*) AS article_count FROM documents GROUP BY source) ON category_name = source GROUP BY 1, 2, 3, 4")
def K12_categories(t):
    """Categories numbered from 1; the ids of a large one are lists of 1,000 numbers' ids each, so none is gathered whole."""
    each = t.documents.groupBy(F.col("source").alias("category_name")).agg(F.count("*").alias("article_count"))
    number = F.row_number().over(Window.orderBy("category_name")).cast("long")  # one row for each category
    parts = t.documents.groupBy("source", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("articles"))
    named = each.withColumn("category_id", number)
    return parts.join(named, F.col("source") == F.col("category_name")).select("category_id", "category_name", "article_count", "part", "articles")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'front,new' ELSE concat_ws(',', CASE WHEN lang <> 'en' THEN lang END, 'new') END AS tags_set, CASE WHEN source IN ('src1', 'src2') THEN 'front' ELSE concat_ws(',', CASE WHEN lang <> 'en' THEN lang END) END AS tags_pulled FROM documents")
def K17_tags(t):
    own = F.array_compact(F.array(F.when(F.col("lang") != "en", F.col("lang")), F.lit("new")))
    tags = F.when(F.col("source").isin("src1", "src2"), F.array(F.lit("front"), F.lit("new"))).otherwise(own)
    return t.documents.select("doc_id", F.array_join(tags, ",").alias("tags_set"), F.array_join(F.array_remove(tags, "new"), ",").alias("tags_pulled"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def K21_upserted_ratings(t):
    """The latest rating of a user for an article; aggregated before it is shuffled, so a frequent pair is no burden."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")
    return t.events.groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "x.event_id", "x.value")


@query("SELECT count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS migrated, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS failed FROM events")
def K22_migration_counts(t):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return t.events.agg(F.count_if(k.isNotNull()).alias("migrated"), F.count_if(k.isNull()).alias("failed"))


@query("SELECT doc_id, translate(text, chr(10), chr(32)) AS body, CASE WHEN length(text) < 128 THEN true END AS too_short FROM documents")
def K25_overwritten_bodies(t):
    return t.documents.select("doc_id", F.translate("text", "\n", " ").alias("body"), F.when(F.length("text") < 128, True).alias("too_short"))


@query("SELECT d AS dir, g AS deg, count(*) AS n FROM (SELECT unnest(['L', 'C', 'R']) AS d), (SELECT unnest(['L', 'M', 'H']) AS g), range(50) GROUP BY 1, 2")
def M15_synthetic_counts(t):
    made = synthetic_bias(t.spark, 50)
    return made.groupBy("dir", "deg").agg(F.count("*").alias("n"))


def synthetic_bias(spark, per_pair: int, seed: int = 42):
    """dir, deg, number, dominant: per_pair rows for each of nine pairs; dominant is 0.50 to 0.85, by a hash."""
    dirs, degs = F.array(*map(F.lit, "LCR")), F.array(*map(F.lit, "LMH"))
    rows = spark.range(9 * per_pair).select(F.col("id").alias("number"), F.get(dirs, (F.col("id") % 3).cast("int")).alias("dir"), F.get(degs, F.floor(F.col("id") % 9 / 3).cast("int")).alias("deg"))
    return rows.withColumn("dominant", F.round(0.5 + 0.35 * F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(10_001)) / 10_000, 2))


@query("SELECT d.doc_id, 'user: ' || substr(text, 1, 1000) AS user_turn, 'assistant: ' || CAST(quality AS VARCHAR) AS assistant_turn, length(text) > 1000 AS truncated FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id")
def M16_chat_rows(t):
    known = t.labels.groupBy("doc_id").agg(F.max("quality").cast("string").alias("quality"))
    d = t.documents.select("doc_id", "text").join(known, "doc_id")
    return d.select("doc_id", F.concat(F.lit("user: "), F.substring("text", 1, 1000)).alias("user_turn"), F.concat(F.lit("assistant: "), F.col("quality")).alias("assistant_turn"), (F.length("text") > 1000).alias("truncated"))


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || ' o''neil US-iran', '\\p{L}+|\\P{L}+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS titled FROM part")
def F26_title_case(t):
    runs = F.regexp_extract_all(F.concat(F.col("p_name"), F.lit(" o'neil US-iran")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    titled = F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return t.part.select("p_partkey", F.array_join(titled, "").alias("titled"))


#: The six shares of a part's record, in hundredths; any numbers do.
SHARES = {"l": "p_size % 100", "c": "p_partkey % 100", "r": "(p_size * 3 + 7) % 100", "low": "(p_partkey * 7 + 1) % 100", "mid": "(p_size + p_partkey) % 100", "high": "(p_partkey * 3) % 100"}


def _broken(t):
    """Records of which every fourth each lacks the braces, has commas before closing braces, lacks the outer braces, or breaks off."""
    v = {k: F.format_string("0.%02d", F.expr(f"cast({e} as int)")) for k, e in SHARES.items()}
    line = lambda *parts: F.concat(*(v[p] if p in v else F.lit(p) for p in parts))
    brand = F.col("p_brand")
    bare = F.concat(line('dir":"L":', "l", ',"C":', "c", ',"R":', "r", ',"deg":"L":', "low", ',"M":', "mid", ',"H":', "high", ',"reason":"'), brand)
    commas = F.concat(line('{"dir":{"L":', "l", ',"C":', "c", ',"R":', "r", ',},"deg":{"L":', "low", ',"M":', "mid", ',"H":', "high", ',},"reason":"'), brand, F.lit('",}'))
    inner = F.concat(line('"dir":{"L":', "l", ',"C":', "c", ',"R":', "r", '},"deg":{"L":', "low", ',"M":', "mid", ',"H":', "high", '},"reason":"'), brand, F.lit('"'))
    open_ = F.concat(line('{"dir":{"L":', "l", ',"C":', "c", ',"R":', "r", '},"deg":{"L":', "low", ',"M":', "mid", ',"H":', "high", '},"reason":"'), brand)
    kind = F.col("p_partkey") % 4
    return t.part.select("p_partkey", F.when(kind == 0, bare).when(kind == 1, commas).when(kind == 2, inner).otherwise(open_).alias("raw"))


GOOD = """'{"dir":{"L":' || l || ',"C":' || c || ',"R":' || r || '},"deg":{"L":' || low || ',"M":' || mid || ',"H":' || high || '},"reason":"' || p_brand || '"}'"""
VALUES = f"(SELECT p_partkey, p_brand, {', '.join(f"'0.' || lpad(CAST({e} AS VARCHAR), 2, '0') AS {k}" for k, e in SHARES.items())} FROM part)"


@query(f"SELECT p_partkey, {GOOD} AS repaired FROM {VALUES}")
def F47_repaired_json(t):
    return _broken(t).select("p_partkey", bj.repair_json(F.col("raw")).alias("repaired"))


@query(f"SELECT p_partkey, true AS valid, false AS raw_valid FROM {VALUES}")
def F49_valid_bias(t):
    return _broken(t).select("p_partkey", bj.canonical(bj.repair_json(F.col("raw"))).isNotNull().alias("valid"), bj.canonical(F.col("raw")).isNotNull().alias("raw_valid"))


@query(f"SELECT p_partkey, {', '.join(f'CAST({k} AS DOUBLE) AS {name}' for k, name in zip(SHARES, ('dir_l', 'dir_c', 'dir_r', 'deg_l', 'deg_m', 'deg_h'), strict=True))} FROM {VALUES}")
def F50_lenient_parse(t):
    return _broken(t).select("p_partkey", bj.lenient(F.col("raw")).alias("x")).select("p_partkey", "x.*")


@query("SELECT d.doc_id, coalesce(lang, CAST(q AS VARCHAR)) AS lang, CASE WHEN q IS NOT NULL THEN 'labels' END AS model FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id")
def K6_stored_field(t):
    """A field set in a stored table where it isn't filled, with its origin; ids without a row are no rows."""
    docs = KeyedTable.create(t.documents.select("doc_id", "lang", F.lit(None).cast("string").alias("model")), ["doc_id"])
    found = t.labels.groupBy("doc_id").agg(F.max("quality").cast("string").alias("lang")).filter("lang is not null")
    docs.merge(found, {"lang": F.coalesce("old.lang", "new.lang"), "model": F.lit("labels")}, insert=False, batch="labels")
    return docs.read()


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'front' ELSE concat_ws(',', CASE WHEN lang <> 'en' THEN lang END) END AS tags FROM documents")
def K17_stored_tags(t):
    """Tags of two sources set, then one tag pulled from all rows that have it."""
    own = F.array_compact(F.array(F.when(F.col("lang") != "en", F.col("lang")), F.lit("new")))
    docs = KeyedTable.create(t.documents.select("doc_id", "source", own.alias("tags")), ["doc_id"])
    docs.update(F.col("source").isin("src1", "src2"), {"tags": F.array(F.lit("front"), F.lit("new"))})
    docs.update(F.array_contains("tags", "new"), {"tags": F.array_remove("tags", "new")})
    return docs.read().select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def K21_stored_ratings(t):
    """Ratings of a user for an article come in two batches, the second one twice; of a pair the latest counts, whenever it comes."""
    each = t.events.select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    first = each.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value", "at"), "at").alias("x")).select("user_id", "event_type", "x.*")
    ratings = KeyedTable.create(first, ["user_id", "event_type"])
    newer = F.col("old").isNull() | (F.col("new.at") > F.col("old.at"))
    for _ in range(2):
        ratings.merge(each.filter("event_id % 2 = 1"), {c: F.when(newer, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in ("event_id", "value", "at")}, latest="at")
    return ratings.read().drop("at")


@query("SELECT doc_id, translate(text, chr(10), chr(32)) AS body, CASE WHEN length(text) < 128 THEN true END AS too_short FROM documents")
def K25_stored_bodies(t):
    """Bodies overwritten where they have line ends; what follows from a body is set with it."""
    docs = KeyedTable.create(t.documents.select("doc_id", F.col("text").alias("body"), F.when(F.length("text") < 128, True).alias("too_short")), ["doc_id"])
    flat = F.translate("body", "\n", " ")
    docs.update(F.contains("body", F.lit("\n")), {"body": flat, "too_short": F.when(F.length(flat) < 128, True)})
    return docs.read()
