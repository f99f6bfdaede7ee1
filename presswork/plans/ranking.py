"""Ranks, draws, splits and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..operators import models
from ..operators.bias import allocate
from ..operators.ranking import first_by, global_rank, split
from ..operators.search import bm25
from ..operators.text_index import TextIndex
from .articles import ART, SCO, articles, scores
from .models import WEIGHTS, vectors
from .registry import query

WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
RELEVANCE = f"""c AS (SELECT doc_id, {WORDS} AS w FROM documents), tok AS (SELECT doc_id, unnest(w) AS term FROM c), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM c), idf AS (SELECT term, ln((n.n - df + 0.5) / (df + 0.5)) AS raw FROM df, n), floor_ AS (SELECT 0.25 * avg(raw) AS eps FROM idf),
 relevance AS (SELECT c.doc_id, round(coalesce(sum(CASE WHEN raw < 0 THEN eps ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(c.w) / n.mean))), 0), 6) AS score
 FROM c CROSS JOIN n CROSS JOIN floor_ LEFT JOIN tf ON tf.doc_id = c.doc_id AND tf.term IN ('license', 'token', 'password') LEFT JOIN idf USING (term) GROUP BY c.doc_id)"""


def relevance(t):
    docs = t.documents.select("doc_id", tokens(F.col("text")).alias("words"))
    return bm25(docs, ["license", "token", "password"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {RELEVANCE} SELECT doc_id, score FROM relevance")
def F31_text_relevance(t):
    return relevance(t)


@query(f"WITH {RELEVANCE} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM relevance WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def T3_by_relevance(t):
    top = relevance(t).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))  # of 50 rows


def index(t):
    return TextIndex.build(t.documents, "doc_id", "text")


@query(f"WITH {RELEVANCE} SELECT doc_id, score FROM relevance")
def F31_index_relevance(t):
    """The same from the stored index: only the rows of the three terms are read; documents without them score 0."""
    own = index(t)
    held = own.docs.select("no", "id").join(own.scores(["license", "token", "password"]), "no", "left")
    return held.select(F.col("id").alias("doc_id"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query(f"WITH {RELEVANCE} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM relevance WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def T3_index_top(t):
    return index(t).top(["license", "token", "password"], 50).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, contains(lower(text), 'licensed under') AS licensed, contains(lower(text), 'mit license') AS mit FROM documents WHERE contains(lower(text), 'licensed under') OR contains(lower(text), 'mit license')")
def P9_index_phrases(t):
    """Documents with either string, by positions of terms; each candidate is then looked at."""
    own = index(t)
    found = own.containing("licensed under").withColumn("licensed", F.lit(True)).join(own.containing("MIT license").withColumn("mit", F.lit(True)), ["no", "id"], "full")
    return found.select(F.col("id").alias("doc_id"), F.coalesce("licensed", F.lit(False)).alias("licensed"), F.coalesce("mit", F.lit(False)).alias("mit"))


RATED = "rated AS (SELECT event_id % 200 AS id, sum(value) AS rating FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY 1), known AS (SELECT r.* FROM rated r WHERE r.id IN (SELECT id FROM weights))"


@query(f"""WITH {WEIGHTS}, {RATED}, prof AS (SELECT term, sum(rating * weight) / (SELECT sum(rating) FROM known) AS p FROM known JOIN weights USING (id) GROUP BY 1),
scored AS (SELECT id, round(sum(weight * p) / (SELECT sqrt(sum(p * p)) FROM prof), 9) AS cosine FROM weights JOIN prof USING (term) WHERE id NOT IN (SELECT id FROM rated) GROUP BY 1) SELECT id, round(cosine, 4) AS cosine FROM scored ORDER BY scored.cosine DESC, id LIMIT 10""")
def T9_recommended(t):
    """For one user: the unrated documents nearest to the user's profile."""
    user = t.events.agg(F.min("user_id").alias("user_id"))
    own = t.events.join(F.broadcast(user), "user_id").select("user_id", (F.col("event_id") % 200).alias("id"), F.col("value").alias("rating"))
    return models.recommend(own, vectors(t), 10).select("id", F.round("cosine", 4).alias("cosine"))


@query(f"WITH {WEIGHTS}, me AS (SELECT term, weight AS p FROM weights WHERE id = 3) SELECT id, round(sum(weight * p), 6) AS cosine FROM weights JOIN me USING (term) WHERE id <> 3 GROUP BY 1 ORDER BY cosine DESC, id LIMIT 10")
def T9_similar(t):
    return models.similar(vectors(t), 3, 10).select("id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {ART} SELECT id, coalesce(strftime(CASE WHEN id % 7 > 0 THEN published END, '%Y-%m-%dT%H:%M:%S'), '') AS published, row_number() OVER (ORDER BY coalesce(strftime(CASE WHEN id % 7 > 0 THEN published END, '%Y-%m-%dT%H:%M:%S'), '') DESC, id) AS rank FROM articles")
def T17_published_order(t):
    """By the text of the time, latest first, those without one last."""
    text = F.coalesce(F.date_format(F.when(F.col("id") % 7 > 0, F.col("published")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return global_rank(articles(t).select("id", text.alias("published")), [F.desc("published"), F.col("id")])


LINE = "strftime(published, '%Y-%m-%d') || chr(9) || source || chr(9) || CAST(id AS VARCHAR) || chr(9) || translate(title, chr(9) || chr(10) || chr(13), '   ')"


@query(f"WITH {ART}, lines AS (SELECT id, {LINE} AS line FROM articles), keyed AS (SELECT id, line, coalesce(list_filter(regexp_split_to_array(line, '[ \\t]+'), lambda x: true)[4], '') AS field FROM lines) SELECT id, row_number() OVER (ORDER BY encode(field), encode(line)) AS rank FROM keyed")
def T18_sorted_titles(t):
    """Lines of the title export by their fourth field between blanks and tabs, byte by byte, then by the line."""
    line = F.concat_ws("\t", F.date_format("published", "yyyy-MM-dd"), "source", F.col("id").cast("string"), F.translate("title", "\t\n\r", "   "))
    keyed = articles(t).select("id", line.alias("line")).withColumn("field", F.coalesce(F.get(F.split("line", "[ \t]+"), F.lit(3)), F.lit("")))
    return global_rank(keyed, [F.col("field"), F.col("line")]).select("id", "rank")


HASH = "md5('42:' || CAST(doc_id AS VARCHAR))"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {HASH}) <= CASE WHEN count(*) OVER () >= 5 THEN ceil(count(*) OVER () * 0.2) WHEN count(*) OVER () > 1 THEN 1 ELSE 0 END AS is_test FROM documents")
def T19_train_test_split(t):
    return split(t.documents.select("doc_id"), "doc_id")


@query("SELECT r_regionkey, row_number() OVER (ORDER BY md5('42:' || CAST(r_regionkey AS VARCHAR))) <= 1 AS is_test FROM region WHERE r_regionkey < 4")
def T19_tiny_set(t):
    return split(t.region.filter("r_regionkey < 4").select("r_regionkey"), "r_regionkey")


@query(f"SELECT doc_id FROM documents ORDER BY {HASH} LIMIT 100")
def T10_random_sample(t):
    return t.documents.select("doc_id").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))).limit(100)


QUOTA = f"WITH {SCO}, b AS (SELECT source, count(*) AS avail FROM scores GROUP BY 1), q AS (SELECT source, least(avail, 50) + greatest(0, least(avail - least(avail, 50), 500 - sum(least(avail, 50)) OVER () - coalesce(sum(avail - least(avail, 50)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM b)"


@query(f"{QUOTA} SELECT id, source, row_number() OVER (ORDER BY md5('shuffled:' || CAST(id AS VARCHAR)), source) AS place FROM (SELECT id, scores.source, quota, row_number() OVER (PARTITION BY scores.source ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS r FROM scores JOIN q USING (source)) WHERE r <= quota")
def T11_balanced_rows(t):
    """The rows themselves: each bin's quota by a seeded hash, then in a shuffled order."""
    s = scores(t).select("id", "source")
    quota = allocate(s.groupBy("source").agg(F.count("*").alias("avail")), "source", "avail", 50, 500).select("source", "quota")
    by = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id")
    drawn = s.join(quota, "source").withColumn("r", F.row_number().over(by)).filter("r <= quota").select("id", "source")
    return global_rank(drawn.withColumn("h", F.md5(F.concat(F.lit("shuffled:"), F.col("id").cast("string")))), [F.col("h"), F.col("source")], "place").drop("h")


@query("SELECT n_name AS agent, round(CASE WHEN ok + bad > 0 THEN ok / (ok + bad) ELSE n_nationkey / 100.0 END, 6) AS score, row_number() OVER (ORDER BY round(CASE WHEN ok + bad > 0 THEN ok / (ok + bad) ELSE n_nationkey / 100.0 END, 6) DESC, n_nationkey) AS rank FROM (SELECT n_name, n_nationkey, count(s_acctbal) FILTER (WHERE s_acctbal > 4000) AS ok, count(s_acctbal) FILTER (WHERE s_acctbal <= 4000) AS bad FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND n_nationkey % 3 > 0 GROUP BY 1, 2)")
def T12_agents_with_untried(t):
    """Agents by their share of successes; one that was never tried counts its place in the list over 100."""
    tried = t.supplier.filter("s_nationkey % 3 > 0").groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 4000).alias("ok"), F.count_if(F.col("s_acctbal") <= 4000).alias("bad"))
    score = F.coalesce(F.try_divide("ok", F.col("ok") + F.col("bad")), F.col("n_nationkey") / 100)
    agents = t.nation.join(tried, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("agent"), F.round(score, 6).alias("score"), "n_nationkey")
    return agents.select("agent", "score", F.row_number().over(Window.orderBy(F.desc("score"), "n_nationkey")).cast("long").alias("rank"))  # a short list


@query("SELECT ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][isodow(ts)] AS day, isodow(ts) AS place, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def R4_weekdays_in_order(t):
    place = (F.weekday("ts") + 1).cast("long")
    day = F.element_at(F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"))), place.cast("int"))
    return t.events.groupBy(day.alias("day"), place.alias("place")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).orderBy("place")
