"""Bias labels: dominant keys, confidence, formats, balanced samples (F25, F39-F56, A18, A22, A29, K*, T11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bias as b
from .articles import SCO, scores
from .registry import query

C = F.col
DIRQ = "CASE WHEN dl >= greatest(dc, dr) THEN 'L' WHEN dc >= dr THEN 'C' ELSE 'R' END"
DEGQ = "CASE WHEN gl >= greatest(gm, gh) THEN 'L' WHEN gm >= gh THEN 'M' ELSE 'H' END"


def dirs():
    return {"L": C("dl"), "C": C("dc"), "R": C("dr")}


def degs():
    return {"L": C("gl"), "M": C("gm"), "H": C("gh")}


@query(f"WITH {SCO} SELECT id, {DIRQ} AS dir, {DEGQ} AS deg FROM scores")
def F25_dominant_keys(t):
    return scores(t).select("id", b.dominant(dirs()).alias("dir"), b.dominant(degs()).alias("deg"))


@query(f"WITH {SCO} SELECT id, round(least(1, greatest(0, (greatest(dl, dc, dr) + greatest(gl, gm, gh)) / 2)), 6) AS a, round(least(1, (greatest(dl, dc, dr) - (dl + dc + dr) / 3 + greatest(gl, gm, gh) - (gl + gm + gh) / 3) / 2), 6) AS b FROM scores")
def F39_confidence(t):
    x, y = list(dirs().values()), list(degs().values())
    return scores(t).select("id", F.round(b.confidence_mean_of_max(x, y), 6).alias("a"), F.round(b.confidence_above_mean(x, y), 6).alias("b"))


@query(f"WITH {SCO} SELECT id, round(dl * 100, 1) AS l, round(dc * 100, 1) AS c FROM scores")
def F41_percentages(t):
    return scores(t).select("id", F.round(C("dl") * 100, 1).alias("l"), F.round(C("dc") * 100, 1).alias("c"))


@query("SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_tax + l_discount, 0), 6) AS a, round(l_discount / nullif(l_tax + l_discount, 0), 6) AS b FROM lineitem WHERE l_tax + l_discount > 0")
def F42_normalised_axis(t):
    x, y = b.normalised([C("l_tax"), C("l_discount")])
    return t.lineitem.filter("l_tax + l_discount > 0").select("l_orderkey", "l_linenumber", F.round(x, 6).alias("a"), F.round(y, 6).alias("b"))


@query(f"WITH {SCO} SELECT id, round(dr - dl, 6) AS score, CASE WHEN dr - dl < -0.2 THEN 'blue' WHEN dr - dl > 0.2 THEN 'red' ELSE 'gray' END AS colour FROM scores")
def F43_score_and_colour(t):
    s = C("dr") - C("dl")
    return scores(t).select("id", F.round(s, 6).alias("score"), F.when(s < -0.2, "blue").when(s > 0.2, "red").otherwise("gray").alias("colour"))


@query(f"WITH {SCO} SELECT {DIRQ} AS dir, {DEGQ} AS deg, count(*) AS n, round(avg(dl), 6) AS dl, round(avg(gh), 6) AS gh FROM scores GROUP BY 1, 2")
def A18_batch_statistics(t):
    return scores(t).groupBy(b.dominant(dirs()).alias("dir"), b.dominant(degs()).alias("deg")).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("dl"), F.round(F.avg("gh"), 6).alias("gh"))


@query(f"WITH {SCO} SELECT {DIRQ} || '-' || {DEGQ} AS bucket, count(*) AS n FROM scores WHERE greatest(dl, dc, dr) >= 0.5 GROUP BY 1")
def A22_bucket_counts(t):
    bucket = F.concat_ws("-", b.dominant(dirs()), b.dominant(degs()))
    return scores(t).filter(F.greatest(*dirs().values()) >= 0.5).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {SCO} SELECT count(*) FILTER (WHERE abs(dl + dc + dr - 1) > 0.1) AS dir_errors, count(*) FILTER (WHERE abs(gl + gm + gh - 1) > 0.1) AS deg_errors, count(*) AS n FROM scores")
def A29_axis_sums(t):
    off = lambda x: F.count_if(F.abs(sum(x.values(), F.lit(0.0)) - 1) > 0.1)
    return scores(t).agg(off(dirs()).alias("dir_errors"), off(degs()).alias("deg_errors"), F.count("*").alias("n"))


@query(f"WITH {SCO}, b AS (SELECT source, count(*) AS avail FROM scores GROUP BY 1), q AS (SELECT source, least(avail, 50) + greatest(0, least(avail - least(avail, 50), 500 - sum(least(avail, 50)) OVER () - coalesce(sum(avail - least(avail, 50)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM b) SELECT source, CAST(quota AS BIGINT) AS n FROM q")
def T11_balanced_sample_sizes(t):
    s = scores(t).select("id", "source")
    bins = b.allocate(s.groupBy("source").agg(F.count("*").alias("avail")), "source", "avail", 50, 500)
    return b.balanced_sample(s, bins, "source", "id").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {SCO} SELECT id, printf('L: %.2f, C: %.2f, R: %.2f', dl + 0.00001, dc + 0.00001, dr + 0.00001) AS line FROM scores")
def F45_formatted(t):
    return scores(t).select("id", F.format_string("L: %.2f, C: %.2f, R: %.2f", *(C(c) + 0.00001 for c in ("dl", "dc", "dr"))).alias("line"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.dir') AS DOUBLE), 0.33) AS l, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0.34) AS c FROM events")
def F55_defaults(t):
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.coalesce(F.try_variant_get(v, "$.dir", "double"), F.lit(0.33)).alias("l"), F.coalesce(F.try_variant_get(v, "$.k", "double"), F.lit(0.34)).alias("c"))


@query("SELECT doc_id, CASE WHEN length(text) < 128 THEN true END AS too_short FROM documents")
def K25_too_short(t):
    return t.documents.select("doc_id", F.when(F.length("text") < 128, True).alias("too_short"))


@query("SELECT doc_id, list_filter(['a', lang, 'a', source], lambda x: x <> 'a') AS tags FROM documents")
def K17_remove_tag(t):
    return t.documents.select("doc_id", F.array_remove(F.array(F.lit("a"), "lang", F.lit("a"), "source"), "a").alias("tags"))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def K6_merge_field(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"))


@query("SELECT strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id % 2000), '%Y-%m-%d') AS published, source, CAST(doc_id AS VARCHAR) AS id, translate(substr(text, 1, 60), chr(9) || chr(10) || chr(13), '   ') AS title FROM documents")
def K7_title_export(t):
    from .articles import articles

    return articles(t).select(F.date_format("published", "yyyy-MM-dd").alias("published"), "source", F.col("id").cast("string").alias("id"), F.translate("title", "\t\n\r", "   ").alias("title"))
