"""Aggregations, distinct and set operations (A*, U*), windows (W*) and reshaping (R*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .articles import ART, ENT, SCO, articles, entities, scores
from ..operators.ranking import global_rank
from .registry import query



def day(c="published"):
    return F.date_format(c, "yyyy-MM-dd").alias("day")


@query("SELECT coalesce(nullif(source, ''), 'Unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def A1_count_by_source(t):
    return t.documents.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("Unknown")).alias("source")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM documents")
def A2_total(t):
    return t.documents.agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def A3_daily_counts(t):
    return t.events.filter("ts is not null").groupBy(day("ts")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def A4_source_by_day(t):
    return t.events.groupBy(F.col("event_type").alias("source"), day("ts")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source FROM documents")
def A5_distinct_sources(t):
    return t.documents.select("source").distinct()


@query(f"WITH {ART} SELECT DISTINCT unnest(tags) AS tag FROM articles")
def A5_distinct_tags(t):
    return articles(t).select(F.explode("tags").alias("tag")).distinct()


AXES = ("dl", "dc", "dr", "gl", "gm", "gh")


@query(f"WITH {SCO} SELECT source, strftime(published, '%Y-%m-%d') AS day, {', '.join(f'round(coalesce(avg({c}), 0), 6) AS {c}' for c in AXES)}, count(*) AS n FROM scores GROUP BY 1, 2")
def A6_bias_by_source_and_day(t):
    return scores(t).groupBy("source", day()).agg(*(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in AXES), F.count("*").alias("n"))


@query(f"WITH {SCO} SELECT source, dayofweek(published) + 1 AS dow, dayname(published) AS dow_name, {', '.join(f'round(avg({c}), 6) AS {c}' for c in AXES[:3])} FROM scores GROUP BY 1, 2, 3")
def A7_bias_by_weekday(t):
    return scores(t).groupBy("source", F.dayofweek("published").cast("long").alias("dow"), F.date_format("published", "EEEE").alias("dow_name")).agg(*(F.round(F.avg(c), 6).alias(c) for c in AXES[:3]))


@query(f"WITH {SCO} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in AXES)} FROM scores HAVING count(*) > 0")
def A8_overall_bias(t):
    return scores(t).agg(*(F.round(F.avg(c), 6).alias(c) for c in AXES), F.count("*").alias("n")).filter("n > 0").drop("n")


@query("SELECT strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events")
def A9_date_span(t):
    return t.events.agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


STATUS = "CASE WHEN dl >= 0.5 THEN 'LEFT' WHEN dr >= 0.5 THEN 'RIGHT' WHEN dc >= 0.5 THEN 'CENTER' ELSE 'NEUTRAL' END"


@query(f"WITH {SCO}, days AS (SELECT source, strftime(published, '%Y-%m-%d') AS day, avg(dl) AS dl, avg(dc) AS dc, avg(dr) AS dr, count(*) AS n FROM scores GROUP BY 1, 2), s AS (SELECT source, avg(dl) AS dl, avg(dc) AS dc, avg(dr) AS dr, CAST(sum(n) AS BIGINT) AS n FROM days GROUP BY 1) SELECT source, round(dl, 3) AS dl, round(dc, 3) AS dc, round(dr, 3) AS dr, n, {STATUS} AS status FROM s")
def A10_source_summary(t):
    days = scores(t).groupBy("source", day()).agg(*(F.avg(c).alias(c) for c in ("dl", "dc", "dr")), F.count("*").alias("n"))
    one = days.groupBy("source").agg(*(F.avg(c).alias(c) for c in ("dl", "dc", "dr")), F.sum("n").alias("n"))
    status = F.when(F.col("dl") >= 0.5, "LEFT").when(F.col("dr") >= 0.5, "RIGHT").when(F.col("dc") >= 0.5, "CENTER").otherwise("NEUTRAL")
    return one.select("source", *(F.round(c, 3).alias(c) for c in ("dl", "dc", "dr")), "n", status.alias("status"))


@query(f"WITH {ENT} SELECT label, text, count(DISTINCT id) AS n FROM ent GROUP BY 1, 2")
def A11_entity_document_frequency(t):
    return entities(t).select(F.explode(F.array_distinct("entities")).alias("e")).groupBy("e.label", "e.text").agg(F.count("*").alias("n"))


@query(f"WITH {ENT} SELECT id, label, string_agg(DISTINCT text, ', ' ORDER BY text) AS names FROM ent GROUP BY 1, 2")
def A12_entities_by_label(t):
    e = entities(t).select("id", F.explode("entities").alias("e"))
    return e.groupBy("id", F.col("e.label").alias("label")).agg(F.array_join(F.sort_array(F.collect_set("e.text")), ", ").alias("names"))


@query("SELECT user_id, max_by(event_type, event_id) AS label, count(*) FILTER (WHERE value > 60) AS positive, count(*) FILTER (WHERE value < 20) AS negative, count(*) FILTER (WHERE NOT (value > 60 OR value < 20)) AS indifferent, count(*) AS total FROM events GROUP BY 1")
def A13_sentiment_roll_up(t):
    v = F.col("value")
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("label"), F.count_if(v > 60).alias("positive"), F.count_if(v < 20).alias("negative"), F.count_if(~((v > 60) | (v < 20))).alias("indifferent"), F.count("*").alias("total"))


@query(f"WITH {ENT} SELECT id, text, count(*) AS n FROM ent GROUP BY 1, 2")
def A14_entity_counts(t):
    return entities(t).select("id", F.explode("entities.text").alias("text")).groupBy("id", "text").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS matches, round(avg(abs(quality - toxic)), 6) AS mae FROM labels")
def A19_model_comparison(t):
    return t.labels.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("matches"), F.round(F.avg(F.abs(F.col("quality") - F.col("toxic"))), 6).alias("mae"))


@query("SELECT count(*) FILTER (WHERE abs(l_discount - l_tax) <= 0.05) AS matches, count(*) FILTER (WHERE abs(l_discount - l_tax) > 0.05) AS mismatches, round(count(*) FILTER (WHERE abs(l_discount - l_tax) <= 0.05) / nullif(count(*), 0), 6) AS rate FROM lineitem")
def A20_validation(t):
    ok = F.abs(F.col("l_discount") - F.col("l_tax")) <= 0.05
    return t.lineitem.agg(F.count_if(ok).alias("matches"), F.count_if(~ok).alias("mismatches"), F.round(F.try_divide(F.count_if(ok), F.count("*")), 6).alias("rate"))


@query("SELECT round(avg(CASE WHEN quality IS NOT DISTINCT FROM toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM documents LEFT JOIN labels USING (doc_id)")
def A21_accuracy(t):
    same = F.col("quality").eqNullSafe(F.col("toxic"))
    return t.documents.join(t.labels, "doc_id", "left").agg(F.round(F.avg(same.cast("int").cast("double")), 6).alias("accuracy"))


@query("SELECT count(*) AS n, count(text) AS with_text, count(*) FILTER (WHERE n_chars < 500) AS short, round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most FROM documents")
def A24_dataset_statistics(t):
    return t.documents.agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.count_if(F.col("n_chars") < 500).alias("short"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("SELECT user_id AS run, min(ts) AS started, min_by(event_type, event_id) AS first_event, CAST(count(*) FILTER (WHERE event_type <> 'purchase') AS BIGINT) AS metrics, max_by(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_value FROM events GROUP BY 1")
def A25_runs(t):
    done = F.col("event_type") == "purchase"
    return t.events.groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("started"), F.min_by("event_type", "event_id").alias("first_event"), F.count_if(~done).alias("metrics"), F.max_by(F.when(done, F.col("value")), F.when(done, F.col("event_id"))).alias("last_value"))


@query("SELECT source, count(*) FILTER (WHERE n_chars >= 128 AND doc_id % 17 <> 0) AS added, count(*) FILTER (WHERE doc_id % 17 = 0) AS errs, count(*) FILTER (WHERE n_chars < 128 AND doc_id % 17 <> 0) AS skipped FROM documents GROUP BY 1")
def A30_ingest_summary(t):
    err, short = F.col("doc_id") % 17 == 0, F.col("n_chars") < 128
    return t.documents.groupBy("source").agg(F.count_if(~short & ~err).alias("added"), F.count_if(err).alias("errs"), F.count_if(short & ~err).alias("skipped"))


@query("SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE starts_with(line, 'The')")
def A31_count_prefixed_lines(t):
    return t.documents.select(F.explode(F.split("text", "\n")).alias("line")).agg(F.count_if(F.startswith("line", F.lit("The"))).alias("n"))


@query("SELECT event_type AS status, count(*) AS n, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def A32_run_statistics(t):
    return t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("seconds"))


@query("SELECT source, round(n / max(n) OVER (), 6) AS heat FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def A33_heat(t):
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select("source", F.round(F.col("n") / F.col("most"), 6).alias("heat"))


@query("SELECT kind, CAST(sum(greatest(0, least(avail - base, rest - before))) + sum(base) AS BIGINT) AS quota FROM (SELECT *, coalesce(sum(avail - base) OVER (ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 200 - sum(base) OVER () AS rest FROM (SELECT event_type AS kind, count(*) AS avail, least(count(*), 10) AS base FROM events GROUP BY 1)) GROUP BY kind")
def A23_sequential_quota(t):
    from ..operators.bias import allocate

    bins = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("avail"))
    return allocate(bins, "kind", "avail", least=10, total=200).select("kind", "quota")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def W2_first_occurrence(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "event_id", "value")


@query("SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def W3_last_wins(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 60")
def W4_last_sixty(t):
    w = W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("rn", F.row_number().over(w)).filter("rn <= 60").select("event_type", "event_id")


@query("SELECT source, row_number() OVER (ORDER BY source) - 1 AS number FROM (SELECT DISTINCT source FROM documents)")
def W5_index_in_order(t):
    ranked = global_rank(t.documents.select("source").distinct(), [F.col("source")], "number")
    return ranked.select("source", (F.col("number") - 1).cast("long").alias("number"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations")
def W6_carry_forward(t):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(w).alias("question"))


@query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS DISTINCT FROM event_type")
def W8_changes_only(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("prev", F.lag("event_type").over(w)).filter(~F.col("prev").eqNullSafe(F.col("event_type"))).select("user_id", "event_id")


@query("SELECT user_id, CAST(max(k) AS BIGINT) AS longest FROM (SELECT user_id, island, sum(bad) AS k FROM (SELECT user_id, CASE WHEN value < 50 THEN 1 ELSE 0 END AS bad, sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) GROUP BY 1, 2) GROUP BY 1")
def W9_consecutive_failures(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = t.events.withColumn("island", F.sum((F.col("value") >= 50).cast("int")).over(w))
    return e.groupBy("user_id", "island").agg(F.count_if(F.col("value") < 50).alias("k")).groupBy("user_id").agg(F.max("k").alias("longest"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def R1_pivot(t):
    kinds = ["click", "view", "purchase"]
    return t.events.groupBy(day("ts")).pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


@query(f"WITH {SCO} SELECT id, 'Left' AS direction, round(dl, 6) AS score FROM scores UNION ALL SELECT id, 'Center', round(dc, 6) FROM scores UNION ALL SELECT id, 'Right', round(dr, 6) FROM scores")
def R2_melt(t):
    s = scores(t).select("id", F.round("dl", 6).alias("Left"), F.round("dc", 6).alias("Center"), F.round("dr", 6).alias("Right"))
    return s.unpivot("id", ["Left", "Center", "Right"], "direction", "score")


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, weekofyear(ts) AS w, isodow(ts) - 1 AS dow FROM events")
def R3_calendar(t):
    parts = {"y": F.year, "m": F.month, "d": F.day, "w": F.weekofyear, "dow": F.weekday}
    return t.events.select("event_id", *(f("ts").cast("long").alias(k) for k, f in parts.items()))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def R6_flatten_metrics(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "double").alias("k"))


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id FROM labels)")
def U1_union_of_ids(t):
    return t.documents.filter("lang = 'fr'").select("doc_id").union(t.labels.select("doc_id")).distinct()


@query("SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def U3_intersection(t):
    return t.labels.select("doc_id").intersect(t.documents.filter("lang = 'en'").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def U4_except(t):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id").distinct()).distinct()


@query("SELECT DISTINCT role, text FROM conversations")
def U5_unique_texts(t):
    return t.conversations.select("role", "text").distinct()


@query("SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''))) AS tags FROM documents")
def U6_text_tags(t):
    parts = F.transform(F.split("text", ","), lambda x: F.trim(x))
    return t.documents.select("doc_id", F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))).alias("tags"))


