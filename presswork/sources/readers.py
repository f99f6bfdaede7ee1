"""Readers of small text formats (S*). Paths are anything that Spark can read; bad rows go by the stated rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """name, url of a feed list (S1): blank and # lines are skipped, a line without a tab is an error, a later name wins."""
    order = F.monotonically_increasing_id()
    parts = F.split("value", "\t", 2)
    pair = _lines(spark, path).select(F.trim(parts[0]).alias("name"), F.when(F.size(parts) == 2, F.trim(F.get(parts, 1))).otherwise(F.raise_error(F.concat(F.lit("no tab in: "), "value"))).alias("url"), order.alias("n"))
    return pair.groupBy("name").agg(F.max_by("url", "n").alias("url"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id (S11)."""
    return _lines(spark, path).select(F.trim("value").alias("id"))


def found_ids(spark: SparkSession, path: str) -> DataFrame:
    """id of each line "ID: <24 hex digits>" of result files, in lower or upper case."""
    got = F.regexp_extract("value", r"(?i)^ID:\s*([0-9a-f]{24})\s*$", 1)
    return spark.read.text(path).select(got.alias("id")).filter("id <> ''")


def titles(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """article_id, title of a TSV (S8, S9); rows without a title go."""
    if header:
        rows = spark.read.csv(path, sep="\t", header=True, quote="")
        if missing := {"article_id", "title"} - set(rows.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
    else:
        rows = spark.read.schema("article_id string, title string").csv(path, sep="\t", quote="")
    return rows.select("article_id", F.trim("title").alias("title")).filter("title <> ''")


def relations(spark: SparkSession, path: str) -> DataFrame:
    """source, target, relationship, description of tuples ("s","t","r","d") in whole files."""
    each = F.explode(F.regexp_extract_all("value", F.lit(r'\(\s*("[^"]*"\s*,\s*"[^"]*"\s*,\s*"[^"]*"\s*,\s*"[^"]*")\s*\)'), F.lit(1)))
    got = spark.read.text(path, wholetext=True).select(each.alias("t")).select(F.regexp_extract_all("t", F.lit('"([^"]*)"'), F.lit(1)).alias("x"))
    return got.select(*(F.get("x", F.lit(i)).alias(n) for i, n in enumerate(("source", "target", "relationship", "description"))))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """id, model, prompt (S19); lines with fewer fields go."""
    parts = F.split("value", "\t", 3)
    return _lines(spark, path).filter(F.size(parts) == 3).select(parts[0].alias("id"), parts[1].alias("model"), parts[2].alias("prompt"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """id, text of JSON lines that have both."""
    return spark.read.schema("id string, text string").json(path).filter("id is not null and text is not null")


def text_folder(spark: SparkSession, path: str, pattern: str = "*.{txt,md,text}") -> DataFrame:
    """path, text of every matching file below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """category_id, category_name, article_id, title of a nested result."""
    shape = "categories array<struct<category_id: int, category_name: string, articles: array<struct<article_id: string, title: string>>>>"
    each = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("categories").alias("c"))
    return each.select("c.category_id", "c.category_name", F.explode("c.articles").alias("a")).select("category_id", "category_name", "a.*")


def kill_rules(spark: SparkSession, path: str) -> DataFrame:
    """source, pattern of a rule list (S2), where a dot matches newlines too: as for feeds, and a later source wins."""
    return feeds(spark, path).select(F.col("name").alias("source"), F.concat(F.lit("(?s)"), "url").alias("pattern"))


def agent_stats(spark: SparkSession, path: str) -> DataFrame:
    """agent, success, failure (S22); lines with fewer fields go, what isn't a number counts as 0."""
    parts = F.split("value", "\t", 3)
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0)).alias(("", "success", "failure")[i])
    return _lines(spark, path).filter(F.size(parts) == 3).select(parts[0].alias("agent"), number(1), number(2))


def training_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(article, label) of a JSON array, and (entry, error) of what isn't valid (S10). The caller decides if none is an error."""
    shape = "article string, label struct<dir: struct<L: double, C: double, R: double>, deg: struct<L: double, M: double, H: double>, reason: string>, _corrupt_record string"
    rows = spark.read.schema(shape).json(path, multiLine=True)
    error = F.when(F.col("_corrupt_record").isNotNull(), "not JSON").when(F.coalesce(F.trim("article"), F.lit("")) == "", "no article").when(F.col("label").isNull(), "no label")
    for axis, keys in (("dir", "LCR"), ("deg", "LMH")):
        error = F.coalesce(error, F.when(sum((F.col(f"label.{axis}.{k}").isNull().cast("int") for k in keys), F.lit(0)) > 0, f"incomplete {axis}"))
    marked = rows.withColumn("error", error)
    return marked.filter("error is null").select("article", "label"), marked.filter("error is not null").select(F.to_json(F.struct("article", "label")).alias("entry"), "error")


def entity_block(spark: SparkSession, path: str) -> DataFrame:
    """label, text of lines "LABEL: a, b" in a file's <entities> block (S15); single characters go; no block is an error."""
    found = F.regexp_extract("value", r"(?s)<entities>(.*?)</entities>", 1)
    block = F.when(F.col("value").rlike("(?s)<entities>.*?</entities>"), found).otherwise(F.raise_error(F.lit("no <entities> block")))
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(block, "\n")).alias("line")).filter(F.contains("line", F.lit(":")))
    parts = F.split("line", ":", 2)
    each = lines.select(F.trim(parts[0]).alias("label"), F.explode(F.split(parts[1], ",")).alias("text"))
    return each.select("label", F.trim("text").alias("text")).filter(F.length("text") > 1)


def relation_block(spark: SparkSession, path: str) -> DataFrame:
    """source, target, relationship, description of the tuples in a file's <relations> block."""
    tuples = F.regexp_extract_all(F.regexp_extract("value", r"(?s)<relations>(.*?)</relations>", 1), F.lit(r'\("[^"]+",\s*"[^"]+",\s*"[^"]+",\s*"[^"]+"\)'), F.lit(0))
    got = spark.read.text(path, wholetext=True).select(F.explode(tuples).alias("t")).select(F.regexp_extract_all("t", F.lit('"([^"]+)"'), F.lit(1)).alias("x"))
    return got.select(*(F.get("x", F.lit(i)).alias(n) for i, n in enumerate(("source", "target", "relationship", "description"))))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """text, background, entities (label and texts) for each <entities> line after a <text> line.

    The window is one input file in line order, which the format demands; files are dealt over tasks.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    tagged = lambda tag: F.regexp_extract(F.trim("line"), f"^<{tag}>(.*)</{tag}>$", 1)
    is_tag = lambda tag: F.trim("line").rlike(f"^<{tag}>.*</{tag}>$")
    marked = lines.select("file", "n", *(F.when(is_tag(tag), tagged(tag)).alias(tag) for tag in ("text", "background", "entities")))
    before = Window.partitionBy("file").orderBy("n")
    # a segment ends the group: its text and background hold for it alone
    part = marked.withColumn("seen", F.last(F.when(F.col("text").isNotNull(), 1).when(F.col("entities").isNotNull(), 0), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    part = part.withColumn("ends", (F.col("entities").isNotNull() & (F.col("seen") == 1)).cast("int"))
    part = part.withColumn("g", F.coalesce(F.sum("ends").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = part.groupBy("file", "g").agg(F.max_by("text", F.when(F.col("text").isNotNull(), F.col("n"))).alias("text"), F.max_by("background", F.when(F.col("background").isNotNull(), F.col("n"))).alias("background"), F.max(F.when(F.col("ends") == 1, F.col("entities"))).alias("e"))
    pairs = F.transform(F.regexp_extract_all("e", F.lit(r"<(\w+)>[^<]+</\1>"), F.lit(0)), lambda x: F.struct(F.upper(F.regexp_extract(x, "^<([^>]+)>", 1)).alias("label"), F.transform(F.split(F.regexp_extract(x, ">([^<]+)<", 1), ","), lambda v: F.trim(v)).alias("texts")))
    return each.filter("e is not null").select("text", F.coalesce("background", F.lit("")).alias("background"), pairs.alias("entities"))


def batch_queries(spark: SparkSession, path: str, row: int | None = None) -> DataFrame:
    """The parameter rows of a TSV with a header (S18), numbered from 1 as `row`; rows that begin with # don't count."""
    got = spark.read.csv(path, sep="\t", header=True, quote="")
    first = got.columns[0]
    kept = got.filter(F.col(first).isNull() | ~F.startswith(F.ltrim(first), F.lit("#")))
    numbered = kept.withColumn("_order", F.monotonically_increasing_id()).withColumn("row", F.row_number().over(Window.orderBy("_order"))).drop("_order")  # a short hand-written list
    return numbered if row is None else numbered.filter(F.col("row") == row)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """text of each line that isn't blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''")


def title_lines(spark: SparkSession, path: str, number: bool = False, strip_quotes: bool = False) -> DataFrame:
    """article_id, title of a TSV without a header (S9). Lines without a tab go, or with number get one in the order of
    the file (numbers have gaps between tasks); quotes around a title go if asked for; lines without a title go."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    parts = F.split("value", "\t", 2)
    whole = F.size(parts) == 2
    rows = lines if number else lines.filter(whole)
    title = F.trim(F.when(whole, F.get(parts, F.lit(1))).otherwise(F.col("value")))
    if strip_quotes:
        title = F.regexp_replace(title, r"""^["']+|["']+$""", "")
    return rows.select(F.when(whole, F.trim(parts[0])).otherwise(F.col("n").cast("string")).alias("article_id"), title.alias("title")).filter("title <> ''")


def jsonl_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """id, text of JSON lines; where a line names a `file` of the folder, its text is what the file holds."""
    rows = spark.read.schema("id string, text string, file string").json(path).filter("id is not null")
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("file"), F.col("value").alias("body"))
    return rows.join(files, "file", "left").select("id", F.coalesce("text", "body").alias("text")).filter("text is not null")
