"""Text functions (F*) and boilerplate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import boilerplate as bp
from .registry import query

LINES = "lines AS (SELECT doc_id AS id, source, pos, line, regexp_replace(lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')), '[^a-zA-Z0-9]', '', 'g') AS norm FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"
REP = f"{LINES}, rep AS (SELECT source, norm, count(DISTINCT id) AS n_docs FROM lines WHERE length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) >= 10 AND length(norm) >= 5 GROUP BY 1, 2 HAVING count(DISTINCT id) > 1)"
HIT = "marked AS (SELECT l.id, l.source, l.pos, l.line, r.norm IS NOT NULL AS hit FROM lines l LEFT JOIN rep r ON l.source = r.source AND l.norm = r.norm AND length(regexp_replace(l.line, '^\\s+|\\s+$', '', 'g')) >= 10)"


@query(f"WITH {REP} SELECT r.source, r.norm, r.n_docs, (SELECT arg_min(line, struct_pack(id := id, pos := pos)) FROM lines l WHERE l.source = r.source AND l.norm = r.norm AND length(regexp_replace(l.line, '^\\s+|\\s+$', '', 'g')) >= 10) AS sample FROM rep r")
def boilerplate_lines(t):
    return bp.repeated_lines(bp.article_lines(t.documents))


@query(f"WITH {REP}, {HIT} SELECT id, source, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS text FROM marked GROUP BY 1, 2")
def J5_boilerplate_removed(t):
    lines = bp.article_lines(t.documents)
    return bp.remove_lines(t.documents, bp.repeated_lines(lines))


@query(f"WITH {REP}, {HIT} SELECT source, count(DISTINCT id) AS docs, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_removed FROM marked GROUP BY ROLLUP (source)")
def A16_boilerplate_report(t):
    lines = bp.article_lines(t.documents)
    done = bp.remove_lines(t.documents, bp.repeated_lines(lines))
    return done.rollup("source").agg(F.count("*").alias("docs"), F.sum("n_lines").alias("n_lines"), F.sum("n_removed").alias("n_removed"))


SINGLE = "(regexp_replace(l, '^\\s+|\\s+$', '', 'g') <> '' AND NOT regexp_matches(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '\\s'))"
CLEAN = f"regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT {SINGLE}), chr(10)), '\\n\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def F11_clean_article(t):
    return t.documents.select("doc_id", x.clean_article(F.col("text")).alias("cleaned"))


@query(f"SELECT count(*) AS docs, count(*) FILTER (WHERE cleaned <> text) AS modified, count(*) FILTER (WHERE text = '') AS empty, CAST(sum(length(text) - length(cleaned)) AS BIGINT) AS saved, round(100.0 * sum(length(text) - length(cleaned)) / sum(length(text)), 4) AS percent FROM (SELECT text, {CLEAN} AS cleaned FROM documents)")
def A17_cleaning_report(t):
    c = t.documents.select("text", x.clean_article(F.col("text")).alias("cleaned"))
    saved = F.sum(F.length("text") - F.length("cleaned"))
    return c.agg(F.count("*").alias("docs"), F.count_if(F.col("cleaned") != F.col("text")).alias("modified"), F.count_if(F.col("text") == "").alias("empty"), saved.alias("saved"), F.round(100.0 * saved / F.sum(F.length("text")), 4).alias("percent"))


@query(f"SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE {SINGLE}")
def F10_single_word_lines(t):
    return t.documents.select(F.explode(F.split("text", "\n")).alias("l")).agg(F.count_if(x.is_single_word(F.col("l"))).alias("n"))


@query(f"WITH {LINES} SELECT id, CAST(pos AS BIGINT) AS pos, norm FROM lines")
def F12_normalised_lines(t):
    return bp.article_lines(t.documents).select("id", F.col("pos").cast("long").alias("pos"), "norm")


@query("SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS flat FROM documents")
def F14_flat_texts(t):
    return t.documents.select("doc_id", F.translate("text", "\t\n\r", "   ").alias("flat"))


@query("SELECT DISTINCT regexp_replace(text, '[^a-zA-Z0-9_]', '_', 'g') AS gid FROM documents")
def F15_graph_ids(t):
    return t.documents.select(F.regexp_replace("text", "[^a-zA-Z0-9_]", "_").alias("gid")).distinct()


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?* ,]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM pages")
def F16_file_name(t):
    return t.pages.select("page_id", x.file_name(F.col("url")).alias("name"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def F17_escaped_pages(t):
    c = F.col("html")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return t.pages.select("page_id", c.alias("escaped"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '[^a-zA-Z0-9 .,!?-]', '', 'g'), ' +', ' ', 'g')) AS spoken FROM documents")
def F18_speech_text(t):
    c = F.regexp_replace(F.regexp_replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), "[^a-zA-Z0-9 .,!?-]", ""), " +", " ")
    return t.documents.select("doc_id", F.trim(c).alias("spoken"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS n FROM documents")
def F19_sentence_count(t):
    return t.documents.select("doc_id", F.size(x.sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS head FROM documents")
def F24_truncated(t):
    return t.documents.select("doc_id", x.truncate(F.col("text"), 60).alias("head"))


@query("SELECT 'Summarise (' || role || '): ' || text AS prompt, conv_id, turn FROM conversations")
def F28_prompts(t):
    return t.conversations.select(F.format_string("Summarise (%s): %s", "role", "text").alias("prompt"), "conv_id", "turn")


@query("SELECT doc_id, list_transform(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT))), lambda i: substr(text, i * 1000 + 1, 1000)) AS pieces FROM documents")
def F29_pieces(t):
    return t.documents.select("doc_id", x.pieces(F.col("text"), 1000).alias("pieces"))


@query("SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS words FROM benchmark")
def F30_tokens(t):
    return t.benchmark.select("item_id", x.tokens(F.col("text")).alias("words"))


@query("SELECT event_id, CASE WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' h ago' ELSE s // 86400 || ' d ago' END AS label FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)")
def F32_time_ago(t):
    s = F.expr("cast(unix_timestamp(timestamp'2024-02-01 00:00:00') - unix_timestamp(cast(ts as timestamp)) as bigint)")
    unit = lambda n, name: F.concat(F.floor(F.col("s") / n).cast("string"), F.lit(name))
    return t.events.select("event_id", s.alias("s")).select("event_id", F.when(F.col("s") < 3600, unit(60, " min ago")).when(F.col("s") < 86400, unit(3600, " h ago")).otherwise(unit(86400, " d ago")).alias("label"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def F33_day(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, dayofweek(ts) + 1 AS dow FROM events")
def F34_day_of_week(t):
    return t.events.select("event_id", F.dayofweek("ts").cast("long").alias("dow"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def F35_iso_time(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT o_orderkey, regexp_replace(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z', '(\\.000)?Z$', '') AS plain FROM orders")
def F37_plain_time(t):
    return t.orders.select("o_orderkey", F.regexp_replace(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"), r"(\.000)?Z$", "").alias("plain"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))), 5) AS norm2 FROM embeddings")
def F38_squared_norm(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(x.dot(e, e), 5).alias("norm2"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE round(n_chars / 1024.0, 1) || ' KB' END AS size FROM documents")
def F40_human_bytes(t):
    return t.documents.select("doc_id", x.human_bytes(F.col("n_chars")).alias("size"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace('```json' || chr(10) || text || chr(10) || '```', '^```[a-z]*\\n', ''), '\\n```\\s*$', '')) AS body FROM conversations")
def F52_without_fences(t):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    return t.conversations.select("conv_id", "turn", F.trim(F.regexp_replace(F.regexp_replace(fenced, r"^```[a-z]*\n", ""), r"\n```\s*\z", "")).alias("body"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1)) AS n FROM pages")
def F2_paragraph_count(t):
    return t.pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))).cast("long").alias("n"))


@query("SELECT doc_id, regexp_replace(text, '(?s)Licensed under.*', '') AS text FROM documents WHERE source = 'src3'")
def F1_source_rule(t):
    return t.documents.filter("source = 'src3'").select("doc_id", F.regexp_replace("text", "(?s)Licensed under.*", "").alias("text"))
