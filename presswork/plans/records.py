"""Answers of models as records (F48, F51, F53, F54, F56), sections (F13), hashes (F27) and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bias_json as bj
from ..functions.pages import readable_page
from ..functions.text import rolling_hash
from ..operators.sections import filter_sections
from .registry import query


def answers(part):
    """p_partkey, size (two digits as text), object: a record with other names, around it the chatter of a model."""
    x = F.format_string("0.%02d", "p_size")
    record = F.concat(F.lit('{"dir":{"left":'), x, F.lit(',"Center":0.7,"R":0.1},"intensity":{"L":0.1,"M":'), x, F.lit(',"H":0.0},"why":"size '), F.col("p_size").cast("string"), F.lit('"}'))
    return part.select("p_partkey", x.alias("x"), record.alias("object"))


ANSWERS = """answers AS (SELECT p_partkey, p_size, x, '{"dir":{"left":' || x || ',"Center":0.7,"R":0.1},"intensity":{"L":0.1,"M":' || x || ',"H":0.0},"why":"size ' || p_size || '"}' AS object FROM (SELECT *, '0.' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS x FROM part))"""


@query(f"WITH {ANSWERS} SELECT p_partkey, CAST(x AS DOUBLE) AS l, CAST(0.7 AS DOUBLE) AS c, CAST(x AS DOUBLE) AS m, 'size ' || p_size AS reason FROM answers")
def F48_normalised_keys(t):
    x = F.from_json(bj.normalise_keys(F.col("object")), bj.SHAPE)
    return answers(t.part).select("p_partkey", x.alias("x")).select("p_partkey", F.col("x.dir.L").alias("l"), F.col("x.dir.C").alias("c"), F.col("x.deg.M").alias("m"), "x.reason")


@query(f"WITH {ANSWERS} SELECT p_partkey, object FROM answers")
def F51_final_json(t):
    told = F.concat(F.lit("First {1} and [2]; then "), "object", F.lit(" is all."))
    return answers(t.part).select("p_partkey", bj.final_json(told).alias("object"))


@query(f"WITH {ANSWERS} SELECT p_partkey, object FROM answers")
def F53_first_object(t):
    told = F.concat(F.lit("Here: "), "object", F.lit(' or {"a":1}'))
    return answers(t.part).select("p_partkey", bj.first_object(told).alias("object"))


@query(f"WITH {ANSWERS} SELECT p_partkey, '[' || object || ',[1]]' AS list FROM answers")
def F54_outer_array(t):
    told = F.concat(F.lit("Sorted: ["), "object", F.lit(",[1]] done"))
    return answers(t.part).select("p_partkey", bj.outer_array(told).alias("list"))


@query(f"WITH {ANSWERS} SELECT p_partkey, 'Center' AS direction, CASE WHEN CAST(x AS DOUBLE) > 0.1 THEN 'Medium' ELSE 'Low' END AS degree, 'size ' || p_size AS reason FROM answers")
def F56_compact_results(t):
    """Rows are dealt out first: a million of them may stand in one row group of a file, which one task reads."""
    tasks = max(2 * t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    rows = t.part.select("p_partkey", "p_size").repartition(tasks, "p_partkey")
    return answers(rows).select("p_partkey", bj.results(F.col("object"), "compact").alias("x")).select("p_partkey", "x.*")


@query("SELECT doc_id, count(*) AS lines, sum(length(line)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(regexp_extract_all(line, '\\S+')) >= 5 GROUP BY 1")
def F13_filtered_sections(t):
    told = t.documents.select("doc_id", F.concat(F.lit("Source: x\nText:\n"), F.col("text"), F.lit("\n---")).alias("text"))
    kept = filter_sections(told, "doc_id", "text").filter("n >= 2 and line <> '---'")
    return kept.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)"


@query(f"SELECT p_partkey, CASE WHEN h >= 2147483648 THEN '-' || lower(to_hex(4294967296 - h)) ELSE lower(to_hex(h)) END AS hash FROM (SELECT p_partkey, {HASH} AS h FROM part)")
def F27_rolling_hash(t):
    return t.part.select("p_partkey", rolling_hash(F.col("p_name")).alias("hash"))


@query()
def F3_readable_pages(t):
    return t.pages.select("page_id", readable_page(F.col("html")).alias("text"))
