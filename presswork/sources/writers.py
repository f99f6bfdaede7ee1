"""Writers (K*). Every one writes a folder that Spark's tasks fill; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import escape_html
from ..functions.heuristics import colour
from ..functions.text import file_name, truncate


def insert_absent(new: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the store lacks (K1, K4); a key that comes twice is stored once."""
    spark = new.sparkSession
    there = spark.read.schema(new.schema).parquet(path).select(key)
    new.dropDuplicates([key]).join(there, key, "left_anti").select(*new.columns).write.mode("append").parquet(path)


def replace_collection(rows: DataFrame, path: str, expected: int | None = None) -> None:
    """Drops what is there and stores the rows (K4 with force, K5, K20); another number of rows than expected is an error."""
    rows.write.mode("overwrite").parquet(path)
    if expected is not None and (n := rows.sparkSession.read.schema(rows.schema).parquet(path).count()) != expected:
        raise ValueError(f"{n} rows stored, {expected} expected")


def vec_files(rows: DataFrame, path: str) -> None:
    """A folder for each category, NNN_name, with a header and one entry for each article.

    rows: category_id, category_name, article_id, title. The rows of a category stay in the tasks they are in, so a
    large category is many files; the header is a file of its own that sorts first.
    """
    folder = F.concat(F.format_string("%03d_", F.col("category_id")), file_name(F.col("category_name")))
    named = rows.withColumn("category", folder)
    named.select("category", F.concat(F.lit("# "), "category_name").alias("value")).distinct().write.mode("overwrite").partitionBy("category").text(f"{path}/headers")
    entry = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("ID: "), F.col("article_id").cast("string")), F.concat(F.lit("Title: "), F.col("title")))
    named.select("category", entry.alias("value")).write.mode("overwrite").partitionBy("category").text(f"{path}/entries")


def json_lines(rows: DataFrame, path: str, drop: tuple[str, ...] = ("entities_raw",)) -> None:
    """One record a line."""
    rows.drop(*drop).write.mode("overwrite").json(path)


def tsv(rows: DataFrame, path: str) -> None:
    """With a header."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def agent_lines(rows: DataFrame, path: str) -> None:
    """agent, success, failure by tabs under a line of names that readers skip."""
    told = rows.sparkSession.range(1).select(F.lit("# agent\tsuccess\tfailure").alias("value"))
    told.union(rows.select(F.concat_ws("\t", "agent", F.col("success").cast("string"), F.col("failure").cast("string")))).write.mode("overwrite").text(path)


def append_lines(rows: DataFrame, path: str, comment: str) -> None:
    """ids, and a comment that tells where they come from (K15). rows: id."""
    told = rows.sparkSession.range(1).select(F.lit(f"# {comment}").alias("value"))
    told.union(rows.select(F.col("id").cast("string"))).write.mode("append").text(path)


def telemetry(rows: DataFrame, path: str) -> None:
    """Appends events of a training run, in folders by run."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def dot_lines(edges: DataFrame) -> DataFrame:
    """cluster, value: the lines of a graph drawing (K14), nodes in clusters by their first letter. edges: source, target, relationship."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    nodes = edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct().filter("name <> ''")
    node = nodes.select(F.upper(F.substring("name", 1, 1)).alias("cluster"), F.concat(quoted(F.col("name")), F.lit(";")).alias("value"))
    edge = F.concat(quoted(F.col("source")), F.lit(" -> "), quoted(F.col("target")), F.lit(" [label="), quoted(F.coalesce("relationship", F.lit(""))), F.lit("];"))
    return node.union(edges.select(F.lit(None).cast("string"), edge))


def history(rows: DataFrame) -> DataFrame:
    """export: each row as JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("export"))


def html_lines(edges: DataFrame, title: str = "Graph") -> DataFrame:
    """place, value: the lines, in order of place, of a page that holds a graph's nodes (with colours) and edges as data."""
    json = lambda **columns: F.to_json(F.struct(*(c.alias(name) for name, c in columns.items())))
    line = lambda place, c: (F.lit(place).alias("place"), c.alias("value"))
    nodes = edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct().filter("name <> ''")
    node = nodes.select(*line(1, F.concat(F.lit('<script type="application/json" class="node">'), _in_script(json(id=F.col("name"), color=colour(F.col("name")))), F.lit("</script>"))))
    edge = edges.select(*line(2, F.concat(F.lit('<script type="application/json" class="edge">'), _in_script(json(source=F.col("source"), target=F.col("target"), label=F.coalesce("relationship", F.lit("")))), F.lit("</script>"))))
    one = edges.sparkSession.range(1)
    head = one.select(*line(0, F.concat(F.lit("<!doctype html><title>"), escape_html(F.lit(title)), F.lit('</title><svg id="graph"></svg>'))))
    return head.union(node).union(edge).union(one.select(*line(3, F.lit(f"<script>{DRAW}</script>"))))


def _in_script(c):
    """Data within a script element mustn't end it."""
    return F.replace(c, F.lit("</"), F.lit("<\\/"))


#: Puts nodes on a circle and lets them be dragged.
DRAW = """const read = k => [...document.querySelectorAll("." + k)].map(x => JSON.parse(x.textContent)), svg = document.getElementById("graph"), at = {}, make = (k, a) => { const e = document.createElementNS("http://www.w3.org/2000/svg", k); for (const n in a) e.setAttribute(n, a[n]); svg.append(e); return e; }; svg.setAttribute("viewBox", "0 0 1000 1000"); const nodes = read("node"), edges = read("edge"); nodes.forEach((n, i) => at[n.id] = [500 + 450 * Math.cos(6.283 * i / nodes.length), 500 + 450 * Math.sin(6.283 * i / nodes.length)]); const draw = () => { svg.replaceChildren(); for (const e of edges) { const [a, b] = [at[e.source], at[e.target]]; make("line", {x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: "#999"}); } for (const n of nodes) { const c = make("circle", {cx: at[n.id][0], cy: at[n.id][1], r: 8, fill: n.color}); c.onpointerdown = () => { svg.onpointermove = v => { const p = new DOMPoint(v.clientX, v.clientY).matrixTransform(svg.getScreenCTM().inverse()); at[n.id] = [p.x, p.y]; draw(); }; svg.onpointerup = () => svg.onpointermove = null; }; make("text", {x: at[n.id][0] + 10, y: at[n.id][1], "font-size": 14}).textContent = n.id; } }; draw();"""


def combined_edges(files: dict[str, DataFrame]) -> DataFrame:
    """source, target, relationship, file: the edges of several files as one graph; equal edges of two files both stay."""
    out = None
    for name, edges in sorted(files.items()):
        part = edges.select("source", "target", "relationship", F.lit(name).alias("file"))
        out = part if out is None else out.unionByName(part)
    return out


def training_file(rows: DataFrame, path: str, pretty: bool = False, metadata: dict[str, str] | None = None) -> None:
    """One JSON record a line, or pretty; metadata goes into each record under its own name."""
    told = rows if not metadata else rows.withColumn("metadata", F.struct(*(F.lit(v).alias(k) for k, v in sorted(metadata.items()))))
    told.select(F.to_json(F.struct(*told.columns), {"pretty": "true"} if pretty else None).alias("value")).write.mode("overwrite").text(path)


def preview(rows: DataFrame, order: str, n: int = 3, width: int = 100) -> DataFrame:
    """The first n rows by `order`, texts cut to `width`."""
    cut = [truncate(F.col(c), width).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes]
    return rows.orderBy(order).limit(n).select(*cut)
