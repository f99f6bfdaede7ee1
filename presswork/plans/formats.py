"""Records as text and text as records: F17, F44-F46, F55, K8, K9, M16, P27, P31 in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as f
from .articles import ENT, articles, entities
from .registry import query

C = F.col
BLOCK = "CASE WHEN len(names) = 0 THEN '(none)' ELSE array_to_string(list_transform(list_sort(list_distinct(list_transform(es, lambda e: e.label))), lambda l: l || ': ' || array_to_string(list_sort(list_distinct(list_transform(list_filter(es, lambda e: e.label = l), lambda e: e.t))), ', ')), chr(10)) END"
PACKED = f"{ENT}, packed AS (SELECT id, names, list_transform(names, lambda n: struct_pack(t := n, label := CASE WHEN length(n) % 3 = 0 THEN 'PERSON' WHEN length(n) % 3 = 1 THEN 'GPE' ELSE 'ORG' END)) AS es FROM ents), blocks AS (SELECT id, '<entities>' || chr(10) || {BLOCK} || chr(10) || '</entities>' AS block FROM packed)"


@query(f"WITH {PACKED} SELECT id, block FROM blocks")
def F44_entity_blocks(t):
    return entities(t).select("id", f.entity_block(C("entities")).alias("block"))


@query(f"WITH {ENT} SELECT CAST(n AS VARCHAR) || chr(9) || label || chr(9) || text AS line FROM (SELECT label, text, count(DISTINCT id) AS n FROM ent GROUP BY 1, 2)")
def K8_entity_count_lines(t):
    n = entities(t).select(F.explode(F.array_distinct("entities")).alias("e")).groupBy("e.label", "e.text").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "label", "text").select(F.concat_ws("\t", C("n").cast("string"), "label", "text").alias("line"))


# Records of four kinds, by the key: whole ones, ones with one axis, other text, nothing.
RECORD = """CASE o_orderkey % 5 WHEN 0 THEN format('{{"dir":{{"L":{},"R":0.5,"C":0.25}},"deg":{{"L":0.125,"M":{},"H":0.75}},"reason":"r{}"}}', (o_orderkey % 8) / 8, (o_orderkey % 4) / 4, o_custkey)
 WHEN 1 THEN format('{{"deg": {{"M": {}, "H": 0.75, "L": 1}}}}', (o_orderkey % 8) / 8) WHEN 2 THEN 'left of center' WHEN 3 THEN '' WHEN 4 THEN format('{{"dir":{{"L":{},"C":"x","R":1}},"deg":{{"L":0,"M":0,"H":1}},"reason":" "}}', (o_orderkey % 8) / 8) END"""


def record():
    n = lambda k: (C("o_orderkey") % k / k).cast("string")
    whole = F.concat(F.lit('{"dir":{"L":'), n(8), F.lit(',"R":0.5,"C":0.25},"deg":{"L":0.125,"M":'), n(4), F.lit(',"H":0.75},"reason":"r'), C("o_custkey").cast("string"), F.lit('"}'))
    part = F.concat(F.lit('{"deg": {"M": '), n(8), F.lit(', "H": 0.75, "L": 1}}'))
    broken = F.concat(F.lit('{"dir":{"L":'), n(8), F.lit(',"C":"x","R":1},"deg":{"L":0,"M":0,"H":1},"reason":" "}'))
    k = C("o_orderkey") % 5
    return F.when(k == 0, whole).when(k == 1, part).when(k == 2, "left of center").when(k == 3, "").when(k == 4, broken)


def records(t):
    return t.orders.select("o_orderkey", "o_custkey", record().alias("raw"))


REC = f"records AS (SELECT o_orderkey, o_custkey, {RECORD} AS raw FROM orders)"


@query("""SELECT o_orderkey, '<bias>' || chr(10) || CASE o_orderkey % 5 WHEN 0 THEN printf('Direction: C: 0.25, L: %.2f, R: 0.50', (o_orderkey % 8) / 8 + 1e-9) || chr(10) || printf('Degree: H: 0.75, L: 0.13, M: %.2f', (o_orderkey % 4) / 4) || chr(10) || 'Reason: r' || o_custkey
 WHEN 1 THEN printf('Degree: H: 0.75, L: 1.00, M: %.2f', (o_orderkey % 8) / 8 + 1e-9) WHEN 2 THEN 'left of center' WHEN 3 THEN '(none)' END || chr(10) || '</bias>' AS block FROM orders WHERE o_orderkey % 5 < 4""")
def F45_bias_blocks(t):
    return records(t).filter("o_orderkey % 5 < 4").select("o_orderkey", f.bias_block(C("raw")).alias("block"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE replace(props, ' ', '') END AS compact FROM events")
def F46_compact_json(t):
    raw = F.when(C("event_id") % 3 == 0, F.substr("props", F.lit(2), F.lit(99))).otherwise(C("props"))
    return t.events.select("event_id", f.compact_json(raw).alias("compact"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 8) / 8 ELSE 0.33 END AS dl, CASE WHEN o_orderkey % 5 = 0 THEN 0.25 ELSE 0.34 END AS dc, CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0.33 END AS dr,
 CASE o_orderkey % 5 WHEN 0 THEN 0.125 WHEN 1 THEN 1 ELSE 0.33 END AS gl, CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 4) / 4 WHEN 1 THEN (o_orderkey % 8) / 8 ELSE 0.34 END AS gm, CASE WHEN o_orderkey % 5 <= 1 THEN 0.75 ELSE 0.33 END AS gh,
 CASE o_orderkey % 5 WHEN 0 THEN 'r' || o_custkey WHEN 3 THEN 'No bias data' ELSE 'From MongoDB record' END AS reasoning FROM orders WHERE o_orderkey % 5 < 4""")
def F55_all_defaults(t):
    return records(t).filter("o_orderkey % 5 < 4").select("o_orderkey", f.canonical_with_defaults(C("raw")).alias("x")).select("o_orderkey", "x.*")


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS valid FROM orders")
def P27_valid_records(t):
    return records(t).select("o_orderkey", f.is_valid_bias(C("raw")).alias("valid"))


@query("SELECT o_orderkey, (o_orderkey % 8) / 8 > 0.5 AS left_wins, (o_orderkey % 8) / 8 > 0.5 AND 0.75 > 0.5 AS both FROM orders WHERE o_orderkey % 5 = 0 AND ((o_orderkey % 8) / 8 > 0.5 OR (o_orderkey % 4) / 4 > 0.5)")
def P31_nested_scores(t):
    """Records whose direction is left by more than a half, or whose degree is medium by more than a half; and those that are left and high."""
    v = F.try_parse_json("raw")
    left, medium, high = (F.coalesce(F.try_variant_get(v, p, "double"), F.lit(0.0)) > 0.5 for p in ("$.dir.L", "$.deg.M", "$.deg.H"))
    rows = records(t).filter("o_orderkey % 5 = 0")
    return rows.filter(left | medium).select("o_orderkey", left.alias("left_wins"), (left & high).alias("both"))


@query(f"""WITH {PACKED} SELECT d.doc_id AS id, '---' || chr(10) || 'ID: ' || d.doc_id || chr(10) || 'Title: ' || substr(text, 1, 60) || chr(10) || 'Published: ' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 2000), '%Y-%m-%dT%H:%M:%S') || chr(10) || 'Source: ' || source || chr(10) ||
 'Bias: <bias>' || chr(10) || CASE WHEN doc_id % 3 = 1 THEN 'Direction: L: 0.50' ELSE '(none)' END || chr(10) || '</bias>' || chr(10) || block || chr(10) || 'Text: ' || text AS block FROM documents d JOIN blocks b ON b.id = d.doc_id""")
def K9_article_blocks(t):
    bias = F.when(C("id") % 3 == 1, F.lit('{"dir":{"L":0.5}}'))
    rows = articles(t).select("id", "title", "published", "source").join(t.documents.select(C("doc_id").alias("id"), "text"), "id").join(entities(t).select("id", "entities"), "id")
    return rows.select("id", f.article_block(C("id"), C("title"), C("published"), C("source"), bias, C("entities"), C("text")).alias("block"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, replace(replace(replace(replace(replace(html, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') AS js FROM pages")
def F17_html_and_js(t):
    return t.pages.select("page_id", f.escape_html(C("html")).alias("html"), f.escape_js(C("html")).alias("js"))


OUT = """'{"direction":{"L":0.5,"C":0.25,"R":0.25}}'"""

@query(f"""SELECT doc_id, kind, CASE kind WHEN 't5' THEN 'classify political bias as json: ' || substr(text, 1, 1000) WHEN 'llama' THEN substr(text, 1, 2000) WHEN 'qwen' THEN 'Analyze the political bias:' || chr(10) || chr(10) || substr(text, 1, 2000) WHEN 'glm' THEN 'Analyze political bias: ' || substr(text, 1, 2000) ELSE text END AS asked, {OUT} AS answer
 FROM documents, (SELECT unnest(['t5', 'llama', 'qwen', 'glm', 'raw']) AS kind)""")
def M16_training_rows(t):
    """Each kind's row, read back from its JSON."""
    out = F.lit('{"direction":{"L":0.5,"C":0.25,"R":0.25}}')
    at = {"t5": ("$.input", "$.output"), "llama": ("$.input", "$.output"), "qwen": ("$.messages[1].content", "$.messages[2].content"), "glm": ("$.prompt", "$.response"), "raw": ("$.text", "$.bias")}
    read = lambda kind, path: F.get_json_object(f.training_row(kind, C("text"), out), path)
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), read(kind, ask).alias("asked"), read(kind, answer).alias("answer")) for kind, (ask, answer) in at.items()))
    return t.documents.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")
