"""Readers and writers, each written and read back (S*, K*): what comes out must be what the rules of the format leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import heuristics as h
from ..operators import models
from ..operators.filters import compile_filter, parse_entities
from ..sources import feeds, readers, writers
from ..streaming.run import work_folder
from .articles import SCO, scores
from .registry import query
from .stories import STORIES, stories

C = F.col


def put(t, lines, whole: bool = False) -> str:
    """One text file of the lines (place, value), in order of place; short lists only, or with whole a file for each row."""
    path = f"{work_folder(t.spark)}/file"
    rows = lines if whole else lines.orderBy("place").coalesce(1)
    rows.select("value").write.text(path)
    return path


def nations(t):
    return t.nation.select("n_nationkey", "n_name")


def named(rows, *columns):
    """place, value out of (place, value) Columns over rows."""
    each = F.explode(F.array(*(F.struct(p.cast("double").alias("place"), v.alias("value")) for p, v in columns)))
    return rows.select(each.alias("x")).select("x.place", "x.value")


def new_url():
    return F.concat(F.lit("http://new/"), C("n_nationkey").cast("string"))


NEW = "'http://new/' || n_nationkey"


def feed_file(t):
    rows = named(
        nations(t),
        (C("n_nationkey"), F.concat("n_name", F.lit("\thttp://old"))),
        (C("n_nationkey") + 0.5, F.lit("# a note\twith a tab")),
        (C("n_nationkey") + 0.6, F.lit("")),
        (C("n_nationkey") + 100, F.when(C("n_nationkey") % 2 == 0, F.concat(F.lit("  "), "n_name", F.lit(" \t "), new_url())).otherwise(F.lit(" # x"))),
    )
    return put(t, rows)


@query(f"SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN {NEW} ELSE 'http://old' END AS url FROM nation")
def S1_feed_list(t):
    return readers.feeds(t.spark, feed_file(t))


@query(f"SELECT n_name AS source, '(?s)' || CASE WHEN n_nationkey % 2 = 0 THEN {NEW} ELSE 'http://old' END AS pattern FROM nation")
def S2_kill_rules(t):
    return readers.kill_rules(t.spark, feed_file(t))


#: Rules by source: a later rule of a source replaces an earlier one.
KILL = (("src1", "never used"), ("src1", "Licensed under.*"), ("src3", "token = [^ ]*"), ("src5", "\\d+.*"))


@query("SELECT doc_id, CASE source WHEN 'src1' THEN regexp_replace(text, '(?s)Licensed under.*', '', 'g') WHEN 'src3' THEN regexp_replace(text, '(?s)token = [^ ]*', '', 'g') WHEN 'src5' THEN regexp_replace(text, '(?s)[0-9]+.*', '', 'g') ELSE text END AS text FROM documents")
def F1_rules_by_source(t):
    """Every source's rule out of the rule file."""
    lines = t.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(float(i)).alias("place"), F.lit(f"{s}\t{p}").alias("value")) for i, (s, p) in enumerate(KILL)))).alias("x")).select("x.*")
    rules = F.broadcast(readers.kill_rules(t.spark, put(t, lines)).withColumnRenamed("source", "of"))  # a short list
    d = t.documents.join(rules, C("source") == C("of"), "left")
    return d.select("doc_id", F.when(C("pattern").isNull(), C("text")).otherwise(F.regexp_replace("text", C("pattern"), F.lit(""))).alias("text"))


def title():
    return F.trim(F.translate(F.substring("text", 1, 60), "\t\n\r", "   "))


SQL_TITLE = "trim(translate(substr(text, 1, 60), chr(9) || chr(10) || chr(13), '   '))"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS article_id, {SQL_TITLE} AS title FROM documents WHERE doc_id % 3 > 0 AND {SQL_TITLE} <> ''")
def S8_headered_titles(t):
    path = f"{work_folder(t.spark)}/file"
    writers.tsv(t.documents.select(F.when(C("doc_id") % 3 == 0, F.lit(" ")).otherwise(title()).alias("title"), C("doc_id").alias("article_id"), F.lit("x").alias("more")), path)
    return readers.titles(t.spark, path, header=True)


@query("SELECT p_partkey % 2 = 0 AS numbered, count(*) AS n, min(p_name) AS least, max(p_name) AS most FROM part GROUP BY 1")
def S9_plain_titles(t):
    """Lines with and without an id; quotes around titles go."""
    name = F.concat(F.lit('"'), "p_name", F.lit('"'))
    lines = t.part.select(F.when(C("p_partkey") % 2 == 0, name).otherwise(F.concat(F.lit("k"), C("p_partkey").cast("string"), F.lit("\t"), name)).alias("value"))
    got = readers.title_lines(t.spark, put(t, lines, whole=True), number=True, strip_quotes=True)
    return got.groupBy((~F.startswith("article_id", F.lit("k"))).alias("numbered")).agg(F.count("*").alias("n"), F.min("title").alias("least"), F.max("title").alias("most"))


@query("SELECT CASE n_nationkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'no article' WHEN 2 THEN 'incomplete deg' ELSE 'no label' END AS what, count(*) AS n FROM nation GROUP BY 1")
def S10_training_file(t):
    axis = lambda keys: "{" + ", ".join(f'"{k}": 0.25' for k in keys) + "}"
    label = [f'{{"dir": {axis("LCR")}, "deg": {axis(keys)}, "reason": "x"}}' for keys in ("LMH", "LMH", "LH")]
    k = C("n_nationkey")
    article = F.when(k % 4 == 1, " ").otherwise(C("n_name"))
    own = F.when(k % 4 == 2, label[2]).when(k % 4 == 3, "null").otherwise(label[0])
    lines = named(nations(t), (k, F.concat(F.when(k == 0, "[").otherwise(","), F.lit('{"article": "'), article, F.lit('", "label": '), own, F.lit("}"))), (F.when(k == 24, 99).otherwise(98), F.when(k == 24, "]").otherwise("")))
    good, bad = readers.training_rows(t.spark, put(t, lines))
    return good.select(F.lit("good").alias("what")).union(bad.select("error")).groupBy("what").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def S11_id_list(t):
    return readers.id_list(t.spark, put(t, named(nations(t), (C("n_nationkey"), F.concat(F.lit(" "), C("n_nationkey").cast("string"), F.lit(" "))), (C("n_nationkey"), F.lit("#7")))))


@query("SELECT lpad(lower(hex(doc_id)), 24, '0') AS id FROM documents WHERE doc_id % 3 < 2")
def S12_found_ids(t):
    hex_ = F.lpad(F.lower(F.hex("doc_id")), 24, "0")
    lines = t.documents.select(F.when(C("doc_id") % 3 == 0, F.concat(F.lit("ID: "), hex_)).when(C("doc_id") % 3 == 1, F.concat(F.lit("id:"), hex_, F.lit("  "))).otherwise(F.concat(F.lit("ID: x"), hex_)).alias("value"))
    return readers.found_ids(t.spark, put(t, lines, whole=True))


@query("SELECT r_regionkey AS category_id, r_name AS category_name, CAST(n_nationkey AS VARCHAR) AS article_id, n_name AS title FROM region JOIN nation ON n_regionkey = r_regionkey")
def S13_category_file(t):
    each = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(C("n_nationkey").cast("string").alias("article_id"), C("n_name").alias("title"))).alias("articles"))
    one = t.region.join(each, C("r_regionkey") == C("n_regionkey")).agg(F.collect_list(F.struct(C("r_regionkey").alias("category_id"), C("r_name").alias("category_name"), "articles")).alias("categories"))  # five rows
    path = f"{work_folder(t.spark)}/file"
    writers.json_lines(one, path)
    return readers.categories(t.spark, path).select(C("category_id").cast("long").alias("category_id"), "category_name", "article_id", "title")


@query(f"WITH {STORIES} SELECT who AS source, place AS target, did AS relationship, what AS description FROM stories")
def S14_relation_tuples(t):
    lines = stories(t).select(F.concat(F.lit("some words "), F.lit('("'), "who", F.lit('", "'), "place", F.lit('" ,"'), "did", F.lit('","'), "what", F.lit('")'), F.lit(" and (others)")).alias("value"))
    return readers.relations(t.spark, put(t, lines, whole=True))


def report(t):
    """A report of a fixed size: a tuple and a name for each nation."""
    rows = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey"))
    one = F.concat(F.lit('("'), "n_name", F.lit('", "'), "r_name", F.lit('", "lies in", "number '), C("n_nationkey").cast("string"), F.lit('")'))
    tuples = rows.groupBy().agg(F.array_join(F.sort_array(F.collect_list(one)), "\n").alias("r"))
    names = t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("R"), C("n_regionkey").cast("string"), F.lit(": x, "), F.array_join(F.sort_array(F.collect_list("n_name")), " , ")).alias("line"))
    block = names.groupBy().agg(F.array_join(F.collect_list("line"), "\n").alias("e"))
    return tuples.crossJoin(block).select(F.concat(F.lit("text\n<relations>\n"), "r", F.lit("\n</relations>\n<entities>\n"), "e", F.lit("\nno label\n</entities>")).alias("value"), F.lit(0).alias("place"))


@query("SELECT 'R' || n_regionkey AS label, n_name AS text FROM nation")
def S15_entity_block(t):
    return readers.entity_block(t.spark, put(t, report(t)))


@query("SELECT n_name AS source, r_name AS target, 'lies in' AS relationship, 'number ' || n_nationkey AS description FROM nation JOIN region ON n_regionkey = r_regionkey")
def S15_relation_block(t):
    return readers.relation_block(t.spark, put(t, report(t)))


@query("SELECT 'about ' || n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'land ' || n_nationkey ELSE '' END AS background, 'GPE: ' || n_name || ';' || 'ORG: a,b' AS entities FROM nation")
def S16_segments(t):
    k = C("n_nationkey")
    tags = F.concat(F.lit("<entities><gpe>"), "n_name", F.lit("</gpe><org>a, b</org></entities>"))
    lines = named(nations(t), (k, F.concat(F.lit("<text>about "), "n_name", F.lit("</text>"))), (k + 0.2, F.when(k % 2 == 0, F.concat(F.lit("<background>land "), k.cast("string"), F.lit("</background>"))).otherwise("words")), (k + 0.4, tags), (k + 0.6, F.lit("<entities><gpe>lost</gpe></entities>")))
    got = readers.segments(t.spark, put(t, lines))
    told = F.array_join(F.transform("entities", lambda e: F.concat(e["label"], F.lit(": "), F.array_join(e["texts"], ","))), ";")
    return got.select("text", "background", told.alias("entities"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 5 <> 1")
def S17_json_lines(t):
    path = f"{work_folder(t.spark)}/file"
    writers.json_lines(t.documents.select(C("doc_id").alias("id"), F.when(C("doc_id") % 5 != 1, C("text")).alias("text"), F.lit("raw").alias("entities_raw")), path)
    return readers.jsonl(t.spark, path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'one file' END AS text FROM nation")
def S17_texts_in_files(t):
    folder, path = put(t, nations(t).limit(1).select(F.lit("one file").alias("value"), F.lit(0).alias("place"))), f"{work_folder(t.spark)}/file"
    file = t.spark.read.text(folder).select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("file"))
    rows = nations(t).crossJoin(F.broadcast(file)).select(C("n_nationkey").alias("id"), F.when(C("n_nationkey") % 2 == 0, C("n_name")).alias("text"), F.when(C("n_nationkey") % 2 == 1, C("file")).alias("file"))
    writers.json_lines(rows, path)
    return readers.jsonl_files(t.spark, path, folder).withColumn("text", F.rtrim(F.regexp_replace("text", "\n$", "")))


@query("SELECT n_name AS query, CAST(n_regionkey AS VARCHAR) AS top, row_number() OVER (ORDER BY n_nationkey) AS row FROM nation WHERE n_nationkey % 3 > 0")
def S18_batch_queries(t):
    k = C("n_nationkey")
    lines = named(nations(t).join(t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey"), (k, F.concat(F.when(k % 3 == 0, "# ").otherwise(""), "n_name", F.lit("\t"), C("n_regionkey").cast("string"))), (F.when(k == 0, -1).otherwise(-2), F.when(k == 0, "query\ttop")))
    return readers.batch_queries(t.spark, put(t, lines.filter("value is not null"))).select("query", "top", C("row").cast("long").alias("row"))


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, role AS model, replace(text, chr(10), ' ') AS prompt FROM conversations WHERE turn % 3 > 0")
def S19_prompt_queue(t):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    lines = t.conversations.select(F.when(C("turn") % 3 == 0, F.concat_ws("\t", "role", F.lit("no prompt"))).otherwise(F.concat_ws("\t", F.concat(C("conv_id").cast("string"), F.lit("-"), C("turn").cast("string")), "role", flat)).alias("value"))
    return readers.prompts(t.spark, put(t, lines, whole=True))


@query(f"WITH {STORIES} SELECT tone, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'killed') OR contains(lower(text), 'rejected') OR contains(lower(text), 'attack') THEN 'x' ELSE 'y' END AS tone FROM stories) GROUP BY 1")
def S21_folder_analysis(t):
    """Files below a folder, in folders of their own, each analysed; files of other kinds don't count."""
    path = work_folder(t.spark)
    stories(t).select(C("source"), F.concat("text", F.lit("\n")).alias("value")).write.partitionBy("source").text(path)
    got = readers.text_folder(t.spark, path, "*.{txt,md,text}").select(F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    bad = got.select(F.when((h.occurrences(F.lower("text"), ("killed", "rejected", "attack"))) > 0, "x").otherwise("y").alias("tone"))
    return bad.groupBy("tone").agg(F.count("*").alias("n"))


@query("SELECT s_name AS agent, s_nationkey AS success, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_suppkey END AS failure FROM supplier")
def S22_agent_statistics(t):
    path = f"{work_folder(t.spark)}/file"
    writers.agent_lines(t.supplier.select(C("s_name").alias("agent"), C("s_nationkey").alias("success"), F.when(C("s_suppkey") % 2 == 0, "none").otherwise(C("s_suppkey").cast("string")).alias("failure")), path)
    return readers.agent_stats(t.spark, path).select("agent", C("success").cast("long").alias("success"), "failure")


@query("SELECT trim(l) AS text FROM (SELECT unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS l FROM documents) WHERE trim(l) <> ''")
def S24_corpus_lines(t):
    return readers.corpus_lines(t.spark, put(t, t.documents.select(F.col("text").alias("value")), whole=True))


FILTER = {"$and": [{"o_orderstatus": {"$in": ["F", "O"]}}, {"$or": [{"o_totalprice": {"$gt": 100000.0}}, {"o_orderpriority": {"$regex": "^1-", "$options": "i"}}]}, {"o_custkey": {"$ne": 7}}]}


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_totalprice > 100000 OR regexp_matches(o_orderpriority, '(?i)^1-')) AND o_custkey <> 7")
def S26_typed_filter(t):
    return t.orders.filter(compile_filter(FILTER)).select("o_orderkey")


@query("SELECT 'GPE' AS label, 'New York' AS text UNION ALL SELECT NULL, 'Peter' UNION ALL SELECT 'ORG', 'A/B' UNION ALL SELECT 'PERSON', NULL")
def P4_entity_list(t):
    return t.spark.createDataFrame(parse_entities(" GPE/New York, Peter ,, ORG/A/B,PERSON/"), "label string, text string")


def vectors(t):
    return t.embeddings.select("vec_id", C("embedding").cast("array<double>").alias("v"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'old' ELSE 'new' END AS run FROM embeddings")
def K4_vectors_inserted(t):
    """Half the collection is there; only what is absent is added, once, though every row comes twice."""
    path = f"{work_folder(t.spark)}/store"
    writers.replace_collection(vectors(t).filter("vec_id % 2 = 0").withColumn("run", F.lit("old")), path)
    new = vectors(t).withColumn("run", F.lit("new"))
    writers.insert_absent(new.union(new), path, "vec_id")
    return t.spark.read.parquet(path).select("vec_id", "run")


@query("SELECT doc_id AS id, doc_id % 2 = 0 AS old, true AS unit FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{L}\\p{N}_]{2,}')")
def K4_embedded_and_added(t):
    """Texts are embedded and added to a collection that holds half of them; vectors have length 1."""
    path = f"{work_folder(t.spark)}/store"
    made = models.embed_hashed(t.documents, "doc_id", "text").filter(F.exists("vector", lambda x: x > 0))
    writers.replace_collection(made.filter("id % 2 = 0").withColumn("old", F.lit(True)), path)
    writers.insert_absent(made.withColumn("old", F.lit(False)), path, "id")
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return t.spark.read.parquet(path).select("id", "old", (F.abs(length - 1) < 1e-9).alias("unit"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS whole FROM embeddings")
def K5_collection_replaced(t):
    path = f"{work_folder(t.spark)}/store"
    writers.replace_collection(vectors(t).limit(5), path, expected=5)
    writers.replace_collection(vectors(t), path)
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_if(F.size("v") == 64).alias("whole"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))), 5) AS total FROM embeddings")
def K20_vector_nodes(t):
    path = f"{work_folder(t.spark)}/store"
    writers.replace_collection(vectors(t), path)
    return t.spark.read.parquet(path).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT printf('%03d_', r_regionkey) || regexp_replace(r_name, '[^A-Za-z0-9]+', '_', 'g') AS category, 1 + 3 * count(n_nationkey) AS n_lines FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def K10_category_files(t):
    path = work_folder(t.spark)
    rows = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).select(C("r_regionkey").alias("category_id"), C("r_name").alias("category_name"), C("n_nationkey").alias("article_id"), C("n_name").alias("title"))
    writers.vec_files(rows, path)
    got = t.spark.read.text(f"{path}/headers").union(t.spark.read.text(f"{path}/entries"))
    return got.groupBy("category").agg(F.count("*").alias("n_lines"))


@query(f"WITH {SCO} SELECT count(*) AS n, round(sum(dl), 3) AS dl, round(sum(gh), 3) AS gh FROM scores")
def K13_training_export(t):
    path = f"{work_folder(t.spark)}/file"
    writers.json_lines(scores(t).select("id", "dl", "gh"), path)
    return t.spark.read.schema("id long, dl double, gh double").json(path).agg(F.count("*").alias("n"), F.round(F.sum("dl"), 3).alias("dl"), F.round(F.sum("gh"), 3).alias("gh"))


@query("""SELECT upper(substr(name, 1, 1)) AS cluster, '"' || name || '";' AS value FROM (SELECT r_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT n_name FROM nation)
UNION ALL SELECT NULL, '"' || r_name || '" -> "' || n_name || '" [label="has"];' FROM region JOIN nation ON n_regionkey = r_regionkey""")
def K14_drawing(t):
    edges = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).select(C("r_name").alias("source"), C("n_name").alias("target"), F.lit("has").alias("relationship"))
    return writers.dot_lines(edges)


EDGE_SQL = "SELECT r_name AS source, n_name AS target, 'has' AS relationship FROM region JOIN nation ON n_regionkey = r_regionkey"


def region_edges(t):
    return t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).select(C("r_name").alias("source"), C("n_name").alias("target"), F.lit("has").alias("relationship"))


@query(f"WITH e AS ({EDGE_SQL}) SELECT 'edge' AS kind, source AS a, target AS b FROM e UNION ALL SELECT 'node', name, NULL FROM (SELECT source AS name FROM e UNION SELECT target FROM e)")
def K14_page_of_graph(t):
    """The page's data, read back: its nodes and edges."""
    lines = writers.html_lines(region_edges(t)).filter("place in (1, 2)")
    body = F.regexp_extract("value", ">(.*)</script>$", 1)
    x = lines.select(F.when(C("place") == 1, "node").otherwise("edge").alias("kind"), F.from_json(body, "id string, source string, target string").alias("x"))
    return x.select("kind", F.coalesce("x.id", "x.source").alias("a"), C("x.target").alias("b"))


@query(f"WITH e AS ({EDGE_SQL}) SELECT *, 'one' AS file FROM e UNION ALL SELECT *, 'two' FROM e WHERE source < 'B'")
def K14_combined_graph(t):
    e = region_edges(t)
    return writers.combined_edges({"two": e.filter("source < 'B'"), "one": e})


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text, 'v1' AS version FROM documents ORDER BY doc_id LIMIT 3")
def K13_preview(t):
    """A pretty export with metadata is read back and its first rows are shown."""
    path = f"{work_folder(t.spark)}/file"
    writers.training_file(t.documents.select("doc_id", "text"), path, metadata={"version": "v1"})
    got = t.spark.read.schema("doc_id long, text string, metadata struct<version: string>").json(path)
    return writers.preview(got.select("doc_id", "text", C("metadata.version").alias("version")), "doc_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey < 5 THEN 2 ELSE 1 END AS times FROM nation")
def K15_appended_ids(t):
    path = f"{work_folder(t.spark)}/file"
    writers.append_lines(t.nation.select(C("n_nationkey").alias("id")), path, "hybrid --all")
    writers.append_lines(t.nation.filter("n_nationkey < 5").select(C("n_nationkey").alias("id")), path, "hybrid --few")
    return readers.id_list(t.spark, path).groupBy("id").agg(F.count("*").alias("times"))


@query("SELECT event_type AS run_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def K16_telemetry(t):
    path = f"{work_folder(t.spark)}/store"
    for half in (0, 1):
        writers.telemetry(t.events.filter(C("event_id") % 2 == half).select(C("event_type").alias("run_id"), "event_id", "value"), path)
    return t.spark.read.parquet(path).groupBy(C("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS article, p_type AS topic FROM part")
def K19_topic_tables(t):
    path = f"{work_folder(t.spark)}/file"
    writers.tsv(t.part.select(C("p_partkey").alias("article"), C("p_type").alias("topic")), path)
    return t.spark.read.csv(path, sep="\t", header=True)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def K23_processed_log(t):
    """Ids that are logged as processed aren't processed again."""
    path = f"{work_folder(t.spark)}/file"
    writers.json_lines(t.documents.filter("doc_id % 4 <> 1").select("doc_id"), path)
    return t.documents.select("doc_id").join(t.spark.read.schema("doc_id long").json(path), "doc_id", "left_anti")


@query("SELECT conv_id, turn, role FROM conversations")
def K24_history_export(t):
    rows = writers.history(t.conversations.select("conv_id", "turn", "role"))
    x = F.from_json("export", ", ".join(f"{c} {kind}" for c, kind in t.conversations.select("conv_id", "turn", "role").dtypes))
    return rows.select(x.alias("x")).select("x.*")


@query("SELECT p_name || ' ' || p_partkey AS title, 'http://x/' || p_partkey AS link, CASE WHEN p_partkey % 3 = 0 THEN '2024-05-06 07:08:09' ELSE strftime(TIMESTAMP '2024-01-01 10:00:00' + to_days(CAST(p_partkey % 300 AS INT)), '%Y-%m-%d %H:%M:%S') END AS published FROM part")
def S3_saved_feed(t):
    day = F.expr("timestamp'2024-01-01 10:00:00' + make_dt_interval(cast(p_partkey % 300 as int))")
    date = F.when(C("p_partkey") % 3 == 0, "some day").when(C("p_partkey") % 3 == 1, F.date_format(day, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    path = f"{work_folder(t.spark)}/feed"
    t.part.select(F.concat_ws(" ", "p_name", C("p_partkey").cast("string")).alias("title"), F.concat(F.lit("http://x/"), C("p_partkey").cast("string")).alias("link"), date.alias("pubDate")).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    got = feeds.saved_feed(t.spark, path, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return got.select("title", "link", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


STATUS = "CASE WHEN (u * 7 + a * 3) % 5 < 2 THEN 403 WHEN (u * 7 + a * 3) % 5 = 2 THEN 429 WHEN (u * 7 + a * 3) % 11 = 0 THEN 500 ELSE 200 END"


@query(f"""WITH tries AS (SELECT p_partkey AS u, a, {STATUS.replace('u *', 'p_partkey *')} AS status FROM part, range(0, 3) r(a)), best AS (SELECT u, min(a) FILTER (WHERE status NOT IN (403, 429)) AS a FROM tries GROUP BY 1)
SELECT best.u AS url, 'agent' || best.a AS agent, CASE WHEN status = 200 THEN 'body ' || best.u END AS body, CASE WHEN best.a IS NULL THEN 'external' WHEN status = 200 THEN 'fetched' ELSE 'HTTP ' || status END AS how FROM best LEFT JOIN tries ON tries.u = best.u AND tries.a = best.a""")
def S4_agent_rotation(t):
    tries = t.part.select(C("p_partkey").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("a")).withColumn("status", F.expr(STATUS))
    rows = tries.select(C("u").alias("url"), F.concat(F.lit("agent"), C("a").cast("string")).alias("agent"), "status", F.concat(F.lit("body "), C("u").cast("string")).alias("body"))
    agents = t.spark.range(3).select(F.concat(F.lit("agent"), C("id").cast("string")).alias("agent"), C("id").alias("place"))
    return feeds.by_agents(rows, agents)


@query("SELECT page_id AS url, CASE WHEN page_id % 4 > 1 THEN html END AS body, CASE WHEN page_id % 4 = 0 THEN 'timeout' WHEN page_id % 4 = 1 THEN 'HTTP 404' END AS error FROM pages")
def S5_pages_fetched(t):
    k = C("page_id") % 4
    return feeds.fetched(t.pages.select(C("page_id").alias("url"), F.when(k == 1, 404).otherwise(200).alias("status"), F.when(k == 0, 15.5).otherwise(2.0).alias("seconds"), C("html").alias("body")))
