"""Statistics, reports, queues and clusterings in full."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pages, text
from ..functions.formats import SYSTEM
from ..operators import bias as b
from ..operators import clusters, models, ranking, work
from ..operators.bias import confidence_mean_of_max
from .articles import SCO, scores
from .bias import DEGQ, DIRQ, degs, dirs
from .registry import query

C = F.col
KEYS = ("dl", "dc", "dr", "gl", "gm", "gh")
CONFIDENCE = "least(1, greatest(0, (greatest(dl, dc, dr) + greatest(gl, gm, gh)) / 2))"


@query(f"""WITH {SCO}, each AS (SELECT 'mean ' || k AS what, v AS value FROM (SELECT {', '.join(f'avg({k}) AS {k}' for k in KEYS)} FROM scores) UNPIVOT (v FOR k IN ({', '.join(KEYS)}))
 UNION ALL SELECT 'direction ' || {DIRQ}, count(*) FROM scores GROUP BY 1 UNION ALL SELECT 'degree ' || {DEGQ}, count(*) FROM scores GROUP BY 1 UNION ALL SELECT 'confidence', avg({CONFIDENCE}) FROM scores UNION ALL SELECT 'count', count(*) FROM scores)
SELECT what, round(value, 6) AS value FROM each""")
def A18_all_statistics(t):
    """All six means, how often each key leads, the mean confidence, and the count; one pass over the scores."""
    s = scores(t)
    d, g = b.dominant(dirs()), b.dominant(degs())
    leads = [F.count_if(d == k).cast("double").alias(f"direction {k}") for k in "LCR"] + [F.count_if(g == k).cast("double").alias(f"degree {k}") for k in "LMH"]
    sure = F.avg(confidence_mean_of_max(list(dirs().values()), list(degs().values())))
    one = s.agg(*(F.avg(k).alias(f"mean {k}") for k in KEYS), *leads, sure.alias("confidence"), F.count("*").cast("double").alias("count"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), C(f"`{c}`").alias("value")) for c in one.columns)))
    return one.select(each.alias("x")).select("x.what", F.round("x.value", 6).alias("value")).filter("value > 0 or not (what like 'd%')")


OTHER = "SELECT id, source, dl, dc, dr, gl, gm, gh, dc AS ol, dl AS oc, dr AS o_r, gl AS pl, gh AS pm, gm AS ph, source IN ('A', 'N') AS first FROM scores"
ODIR = DIRQ.replace("dl", "ol").replace("dc", "oc").replace("dr", "o_r")
ODEG = DEGQ.replace("gl", "pl").replace("gm", "pm").replace("gh", "ph")


@query(f"""WITH {SCO}, paired AS ({OTHER}), c AS (SELECT CASE WHEN first THEN 'first model' ELSE 'second model' END AS model, {DIRQ} AS d, {ODIR} AS od, {DEGQ} AS g, {ODEG} AS og, (abs(dl - ol) + abs(dc - oc) + abs(dr - o_r)) / 3 AS dm, (abs(gl - pl) + abs(gm - pm) + abs(gh - ph)) / 3 AS gmae FROM paired)
SELECT model, count(*) AS n, round(avg(CASE WHEN d = od THEN 1 ELSE 0 END), 6) AS direction_match, round(avg(CASE WHEN g = og THEN 1 ELSE 0 END), 6) AS degree_match, round(avg(CASE WHEN d = od AND g = og THEN 1 ELSE 0 END), 6) AS match,
 round(avg(dm), 6) AS direction_mae, round(avg(gmae), 6) AS degree_mae, round((avg(dm) + avg(gmae)) / 2, 6) AS combined_mae, count(*) FILTER (WHERE od = 'L') AS other_left, count(*) FILTER (WHERE d = 'L') AS own_left FROM c GROUP BY 1""")
def A19_models_compared(t):
    """Stored scores against another model's (here: with two keys swapped), by the model that answered."""
    s = scores(t)
    own_d, own_g = b.dominant(dirs()), b.dominant(degs())
    other_d, other_g = b.dominant({"L": C("dc"), "C": C("dl"), "R": C("dr")}), b.dominant({"L": C("gl"), "M": C("gh"), "H": C("gm")})
    d_mae, g_mae = (F.abs(C("dl") - C("dc")) * 2) / 3, (F.abs(C("gm") - C("gh")) * 2) / 3
    rate = lambda x: F.round(F.avg(x.cast("int").cast("double")), 6)
    model = F.when(C("source").isin("A", "N"), "first model").otherwise("second model")
    same_d, same_g = own_d == other_d, own_g == other_g
    return s.groupBy(model.alias("model")).agg(F.count("*").alias("n"), rate(same_d).alias("direction_match"), rate(same_g).alias("degree_match"), rate(same_d & same_g).alias("match"), F.round(F.avg(d_mae), 6).alias("direction_mae"), F.round(F.avg(g_mae), 6).alias("degree_mae"), F.round((F.avg(d_mae) + F.avg(g_mae)) / 2, 6).alias("combined_mae"), F.count_if(other_d == "L").alias("other_left"), F.count_if(own_d == "L").alias("own_left"))


@query(f"""WITH {SCO}, c AS (SELECT CASE WHEN id % 5 > 0 THEN {DIRQ} END AS d, CASE WHEN id % 7 > 0 THEN {DEGQ} END AS g, CASE WHEN id % 5 > 1 THEN CASE WHEN dc >= greatest(dl, dr) THEN 'C' WHEN dl >= dr THEN 'L' ELSE 'R' END END AS pd, CASE WHEN id % 7 > 1 THEN {DEGQ} END AS pg FROM scores)
SELECT count(*) AS n, round(avg(CASE WHEN d IS NOT DISTINCT FROM pd THEN 1 ELSE 0 END), 6) AS direction_accuracy, round(avg(CASE WHEN g IS NOT DISTINCT FROM pg THEN 1 ELSE 0 END), 6) AS degree_accuracy FROM c""")
def A21_argmax_accuracy(t):
    """Leading keys, expected and predicted; a missing axis is right where it was expected to be missing."""
    d, g = b.dominant(dirs()), b.dominant(degs())
    p = b.dominant({"C": C("dc"), "L": C("dl"), "R": C("dr")})
    same_d = F.when(C("id") % 5 > 0, d).eqNullSafe(F.when(C("id") % 5 > 1, p))
    same_g = F.when(C("id") % 7 > 0, g).eqNullSafe(F.when(C("id") % 7 > 1, g))
    rate = lambda x: F.round(F.avg(x.cast("int").cast("double")), 6)
    return scores(t).agg(F.count("*").alias("n"), rate(same_d).alias("direction_accuracy"), rate(same_g).alias("degree_accuracy"))


@query("SELECT count(*) AS n FROM documents WHERE doc_id % 3 > 0")
def A31_id_lines(t):
    """Lines that begin with ID: in a result file."""
    lines = t.documents.select(F.concat(F.when(C("doc_id") % 3 > 0, "ID: ").otherwise(" ID: "), C("doc_id").cast("string")).alias("line"))
    return lines.agg(F.count_if(F.startswith("line", F.lit("ID:"))).alias("n"))


@query("SELECT count(*) AS examined, count(*) FILTER (WHERE length(text) >= 100 AND doc_id % 17 > 0) AS processed, count(*) FILTER (WHERE length(text) < 100) AS skipped, count(*) FILTER (WHERE length(text) >= 100 AND doc_id % 17 = 0) AS errors, round(sum(CASE WHEN length(text) >= 100 THEN length(text) / 1000.0 ELSE 0 END), 3) AS seconds FROM documents")
def A32_inference_run(t):
    """What a run of inference counts: short texts are skipped, some calls fail, each call takes its time."""
    short, bad = F.length("text") < 100, C("doc_id") % 17 == 0
    return t.documents.agg(F.count("*").alias("examined"), F.count_if(~short & ~bad).alias("processed"), F.count_if(short).alias("skipped"), F.count_if(~short & bad).alias("errors"), F.round(F.sum(F.when(~short, F.length("text") / 1000.0).otherwise(0.0)), 3).alias("seconds"))


@query("SELECT conv_id, turn, 'System: You are a political bias analysis assistant.' || chr(10) || 'Analyze the political bias of this text. Return JSON with dir, deg and reason.' || chr(10) || chr(10) || 'Text: ' || substr(text, 1, 2000) AS prompt FROM conversations")
def F28_bias_prompts(t):
    head = f"System: {SYSTEM}\nAnalyze the political bias of this text. Return JSON with dir, deg and reason.\n\nText: "
    return t.conversations.select("conv_id", "turn", F.concat(F.lit(head), F.substring("text", 1, 2000)).alias("prompt"))


@query("SELECT n_nationkey AS days, strftime(TIMESTAMP '2024-02-01 06:30:00' - to_days(n_nationkey), '%Y-%m-%dT%H:%M:%SZ') AS since FROM nation")
def F36_days_ago(t):
    """N days before a moment, which a caller takes from the clock."""
    since = F.lit("2024-02-01 06:30:00").cast("timestamp_ntz") - F.make_dt_interval(C("n_nationkey").cast("int"))
    return t.nation.select(C("n_nationkey").alias("days"), F.date_format(since, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("since"))


@query()
def F2_paragraphs(t):
    """The text of all paragraphs, or an error where there is none; needs a tree, so it is a pandas UDF."""
    x = pages.paragraphs(C("html"))
    return t.pages.select("page_id", x.alias("text")).select("page_id", "text", F.when(C("text").isNull(), "no <p> content found").alias("error"))


ROWS = "rows AS (SELECT doc_id AS link, text, doc_id % 17 = 0 AS bad FROM documents)"


@query(f"WITH {ROWS} SELECT link, CASE WHEN NOT bad THEN text END AS article, CASE WHEN bad THEN 'timeout' END AS fetch_error FROM rows WHERE (bad OR length(text) >= 128) AND link % 4 > 0 UNION ALL SELECT link, 'old', NULL FROM rows WHERE link % 4 = 0")
def K1_stored_articles(t):
    """The store after an insert: what was there stays as it was, short articles don't come in, failed fetches do."""
    from ..sources import writers
    from ..streaming.run import work_folder

    path = f"{work_folder(t.spark)}/store"
    shape = lambda rows: rows.select(C("doc_id").alias("link"), "article", "fetch_error")
    old = shape(t.documents.filter("doc_id % 4 = 0").withColumn("article", F.lit("old")).withColumn("fetch_error", F.lit(None).cast("string")))
    writers.replace_collection(old, path)
    bad = C("doc_id") % 17 == 0
    new = t.documents.filter(bad | (F.length("text") >= 128)).withColumn("article", F.when(~bad, C("text"))).withColumn("fetch_error", F.when(bad, "timeout"))
    writers.insert_absent(shape(new), path, "link")
    return t.spark.read.parquet(path)


SINGLE = "(regexp_replace(l, '^\\s+|\\s+$', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '\\s'))"
KEPT = f"array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT {SINGLE}), chr(10))"
CLEAN = f"regexp_replace(regexp_replace({KEPT}, '\\n\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH c AS (SELECT text, len(list_filter(string_split(text, chr(10)), lambda l: {SINGLE})) AS single, len(regexp_extract_all({KEPT}, '\\n\\n+')) AS runs, {CLEAN} AS cleaned FROM documents),
s AS (SELECT count(*) AS total, count(*) FILTER (WHERE text <> '') AS processed, count(*) FILTER (WHERE text <> '' AND cleaned <> text) AS modified, count(*) FILTER (WHERE text <> '' AND cleaned = text) AS unchanged, count(*) FILTER (WHERE text = '') AS empty, sum(single) AS single, sum(runs) AS runs, sum(length(text)) AS before, sum(length(cleaned)) AS after FROM c)
SELECT concat_ws(chr(10), 'ARTICLE CLEANING REPORT', repeat('=', 60), '', format('Total documents in database:     {{:,}}', total), format('Documents processed:             {{:,}}', processed), format('Documents modified:              {{:,}}', modified), format('Documents unchanged:             {{:,}}', unchanged), format('Documents empty:                 {{:,}}', empty), '',
 format('Single-word lines removed:       {{:,}}', CAST(single AS BIGINT)), format('Double newlines replaced:        {{:,}}', CAST(runs AS BIGINT)), '', format('Total characters before:         {{:,}}', CAST(before AS BIGINT)), format('Total characters after:          {{:,}}', CAST(after AS BIGINT)), format('Characters saved:                {{:,}}', CAST(before - after AS BIGINT)), printf('Percentage saved:               %.2f%%', 100.0 * (before - after) / before)) AS report FROM s""")
def K18_cleaning_report(t):
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~text.is_single_word(x)), "\n")
    c = t.documents.select("text", F.size(F.filter(F.split("text", "\n"), text.is_single_word)).alias("single"), F.regexp_count(kept, F.lit("\n\n+")).alias("runs"), text.clean_article(C("text")).alias("cleaned"))
    full = C("text") != ""
    s = c.agg(F.count("*").alias("total"), F.count_if(full).alias("processed"), F.count_if(full & (C("cleaned") != C("text"))).alias("modified"), F.count_if(full & (C("cleaned") == C("text"))).alias("unchanged"), F.count_if(C("text") == "").alias("empty"), F.sum("single").alias("single"), F.sum("runs").alias("runs"), F.sum(F.length("text")).alias("before"), F.sum(F.length("cleaned")).alias("after"))
    number = lambda name, c: F.concat(F.lit(name.ljust(33)), F.format_number(c, 0))
    saved = C("before") - C("after")
    parts = [F.lit("ARTICLE CLEANING REPORT"), F.lit("=" * 60), F.lit(""), number("Total documents in database:", C("total")), number("Documents processed:", C("processed")), number("Documents modified:", C("modified")), number("Documents unchanged:", C("unchanged")), number("Documents empty:", C("empty")), F.lit(""), number("Single-word lines removed:", C("single")), number("Double newlines replaced:", C("runs")), F.lit(""), number("Total characters before:", C("before")), number("Total characters after:", C("after")), number("Characters saved:", saved), F.format_string("Percentage saved:               %.2f%%", 100.0 * saved / C("before"))]
    return s.select(F.concat_ws("\n", *parts).alias("report"))


@query("SELECT o_orderkey, o_orderkey % 5 = 0 OR o_orderkey % 5 = 4 AS migrated FROM orders WHERE o_orderkey % 5 <> 3")
def K22_migrated_records(t):
    """Text records that become objects: valid JSON with both dir and deg; others fail. Empty ones are not looked at."""
    from .formats import records

    v = F.try_parse_json("raw")
    ok = F.startswith(F.ltrim("raw"), F.lit("{")) & F.is_variant_null(F.try_variant_get(v, "$.dir", "variant")).eqNullSafe(F.lit(False)) & F.is_variant_null(F.try_variant_get(v, "$.deg", "variant")).eqNullSafe(F.lit(False))
    has = ok & F.try_variant_get(v, "$.dir", "variant").isNotNull() & F.try_variant_get(v, "$.deg", "variant").isNotNull()
    return records(t).filter("raw <> ''").select("o_orderkey", F.coalesce(has, F.lit(False)).alias("migrated"))


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS level1, split_part(p_name, ' ', 1) AS level2, split_part(p_name, ' ', 2) AS level3, (row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS batch FROM part")
def M7_title_categories(t):
    """Three levels for each title, asked for in batches of 100; the provider here takes them from the words of the title."""
    levels = lambda c: F.array(F.get(F.split(C("p_type"), " "), F.lit(0)), F.get(F.split(c, " "), F.lit(0)), F.get(F.split(c, " "), F.lit(1)))
    rows = ranking.global_rank(t.part.select("p_partkey", "p_name", "p_type"), [C("p_partkey")], "place")
    x = models.categorise(rows, "p_name", "place", levels)
    return x.select("p_partkey", "level1", "level2", "level3", C("batch").cast("long").alias("batch"))


@query()
def M10_density_tree_clusters(t):
    """HDBSCAN within each label; no SQL, compared with known groups in tests."""
    return clusters.by_group(t.embeddings, "label", "vec_id", "embedding", method="density")


@query()
def M11_average_linkage(t):
    return clusters.by_group(t.embeddings, "label", "vec_id", "embedding", method="average", threshold=0.5)


@query()
def M12_topics(t):
    docs = t.documents.select("doc_id", models.terms(F.col("text")).alias("terms"))
    placed, words = clusters.topics(docs, "doc_id", "terms")
    top = words.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "term"))).filter("r <= 10")
    named = top.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("words"))
    return placed.groupBy("topic").agg(F.count("*").alias("n")).join(named, "topic")


HASHED = "CAST('0x' || substr(md5('42:' || number || ':{0}'), 1, 6) AS INT) / 16777216.0"
SPREAD = "CASE WHEN {1} = '{2}' THEN round(0.5 + 0.35 * {0}, 2) ELSE round(0.05 + 0.2 * {0}, 2) END"


def _axis(name: str, keys: str) -> str:
    return ", ".join(f"{SPREAD.format(HASHED.format(name + k), name, k)} AS {name}{k}" for k in keys)


@query(f"""WITH made AS (SELECT number, ['L', 'C', 'R'][number % 3 + 1] AS d, ['L', 'M', 'H'][number % 9 // 3 + 1] AS g FROM range(0, 900) r(number)), raw AS (SELECT *, {_axis('d', 'LCR')}, {_axis('g', 'LMH')} FROM made)
SELECT number, d AS dir, g AS deg, round(dL / (dL + dC + dR) + 1e-9, 2) AS dl, round(dC / (dL + dC + dR) + 1e-9, 2) AS dc, round(dR / (dL + dC + dR) + 1e-9, 2) AS dr, round(gL / (gL + gM + gH) + 1e-9, 2) AS gl, round(gM / (gL + gM + gH) + 1e-9, 2) AS gm, round(gH / (gL + gM + gH) + 1e-9, 2) AS gh FROM raw""")
def M15_synthetic_rows(t):
    """100 rows for each of nine pairs: the leading key 0.50 to 0.85, the others 0.05 to 0.25, then shares of their sum."""
    return b.synthetic(t.spark, 100)


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 3) SELECT vec_id, round(1 - list_cosine_similarity(e, q), 5) AS distance FROM v, q WHERE 1 - (1 - list_cosine_similarity(e, q)) >= 0.3")
def P23_near_enough(t):
    """A query's results by distance, kept if 1 - distance is the threshold or more."""
    q = F.broadcast(t.embeddings.filter("vec_id = 3").select(C("embedding").alias("q")))  # one row
    hits = t.embeddings.crossJoin(q).select("vec_id", (1 - text.cosine(C("embedding"), C("q"))).alias("distance"))
    return hits.filter(1 - C("distance") >= 0.3).select("vec_id", F.round("distance", 5).alias("distance"))


@query("SELECT source, n, coalesce(sum(greatest(n - 20, 0)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 100 - coalesce(sum(greatest(n - 20, 0)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remainder FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def W1_running_remainder(t):
    """What is left of 100 rows before each bin takes what it has beyond 20. Bins are few, so one task orders them."""
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.greatest(C("n") - 20, F.lit(0))).over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select("source", "n", before.alias("before"), (100 - before).alias("remainder"))


@query("SELECT user_id, event_type, n, round(n / max(n) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def W7_share_of_largest(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(C("n") / F.max("n").over(Window.partitionBy("user_id")), 6))


CACHE = work.ResultCache(300)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def X7_cached_result(t):
    """Asked for twice; the second answer is the kept one for 300 s."""
    make = lambda: t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    key = (t.folder, "events by type", id(t.spark))
    CACHE.get(key, make)
    return CACHE.get(key, make)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 3 ELSE 3 END AS attempts, event_id % 3 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 AS done FROM events")
def X8_retried_tasks(t):
    k = C("event_id")
    works = lambda i: ((i == 1) & (k % 3 == 0)) | ((i == 2) & (k % 7 == 0)) | ((i == 3) & (k % 11 == 0))
    return work.with_retries(t.events.select("event_id"), works, 3)


@query("""WITH f AS (SELECT user_id, ts, event_id, CAST(value < 60 AS INT) AS bad FROM events), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS good FROM f),
r AS (SELECT *, CASE WHEN bad = 1 THEN sum(bad) OVER (PARTITION BY user_id, good ORDER BY ts, event_id) ELSE 0 END AS run FROM g), o AS (SELECT *, coalesce(max(CAST(run >= 3 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM r)
SELECT event_id, CASE WHEN open = 1 THEN 'skipped' WHEN bad = 1 THEN 'failed' ELSE 'processed' END AS status FROM o""")
def X9_broken_off_calls(t):
    return work.broken_off(t.events.select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], C("value") < 60, 3).select("event_id", "status")
