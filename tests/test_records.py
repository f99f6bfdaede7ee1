"""Readers, writers and records against literal cases; streams and pages without an SQL twin against plain Python."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from presswork.functions import bias_json as bj
from presswork.functions.pages import readable
from presswork.operators import graph, models
from presswork.operators.sections import filter_sections
from presswork.operators.vector_index import pairs_within
from presswork.plans import registry
from presswork.sources import readers, writers

from .test_sources import got, put


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]


def test_readers(spark, tmp_path):
    assert got(readers.kill_rules(spark, put(tmp_path, "kill", "a\tx.*y\na\tz\n"))) == [("a", "(?s)z")]
    assert got(readers.agent_stats(spark, put(tmp_path, "ua", "# h\nM/5\t3\tx\nshort\t1\n"))) == [("M/5", 3, 0)]
    assert got(readers.entity_block(spark, put(tmp_path, "e", "x\n<entities>\nGPE: Iran, x, Oman\nnone\n</entities>"))) == [("GPE", "Iran"), ("GPE", "Oman")]
    with pytest.raises(Exception, match="no <entities>"):
        readers.entity_block(spark, put(tmp_path, "e2", "nothing")).collect()
    assert got(readers.relation_block(spark, put(tmp_path, "r", '("o","o","o","o")<relations>("a", "b","c d","e")</relations>'))) == [("a", "b", "c d", "e")]
    out = readers.segments(spark, put(tmp_path, "s", "<background>b</background>\n<text>one</text>\n<entities><person>A, B</person></entities>\n<entities></entities>\n<text>two</text>\n<entities></entities>\n")).collect()
    assert sorted((r["text"], r["background"], [(e["label"], e["texts"]) for e in r["entities"]]) for r in out) == [("one", "b", [("PERSON", ["A", "B"])]), ("two", "", [])]
    assert got(readers.batch_queries(spark, put(tmp_path, "b", "label\tn\n#x\t1\ny\t2\nz\t3\n"), row=2)) == [("z", "3", 2)]
    assert got(readers.corpus_lines(spark, put(tmp_path, "c", " a b \n\n"))) == [("a b",)]
    label = {"dir": {"L": 0.1, "C": 0.8, "R": 0.1}, "deg": {"L": 1, "M": 0, "H": 0}, "reason": "r"}
    rows = [{"article": "t", "label": label}, {"article": " ", "label": label}, {"article": "t", "label": {"dir": {"L": 1}, "deg": label["deg"]}}, {"article": "t"}]
    good, bad = readers.training_rows(spark, put(tmp_path, "t", json.dumps(rows)))
    assert [r["article"] for r in good.collect()] == ["t"]
    assert sorted(r["error"] for r in bad.collect()) == ["incomplete dir", "no article", "no label"]


def test_writers(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    writers.replace_collection(rows.filter("id = 1"), path)
    writers.insert_absent(rows, path, "id")
    assert got(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    writers.vec_files(spark.createDataFrame([(7, "a / b", "x", "t")], "category_id int, category_name string, article_id string, title string"), f"file://{tmp_path}/vec")
    assert got(spark.read.text(f"file://{tmp_path}/vec/entries/category=007_a_b")) == [("---",), ("ID: x",), ("Title: t",)]
    edges = spark.createDataFrame([("Ann", "Bob", "knows"), ("Ann", 'C"', None)], "source string, target string, relationship string")
    assert ("A", '"Ann";') in [tuple(r) for r in writers.dot_lines(edges).collect()]
    assert got(writers.dot_lines(edges).filter("cluster is null")) == [(None, '"Ann" -> "Bob" [label="knows"];'), (None, '"Ann" -> "C\\"" [label=""];')]


def test_records(spark):
    assert one(spark, 'a {"x":[1,{"y":2}]} z', bj.final_json) == '{"x":[1,{"y":2}]}'
    assert one(spark, "a [1,[2]] z", bj.final_json) == "[1,[2]]"
    assert one(spark, "none", bj.final_json) is None and one(spark, "1}", bj.final_json) is None and one(spark, None, bj.final_json) is None
    assert json.loads(one(spark, '{"direction":{"left":1,"L":2},"deg":{"heavy":3},"why":"w"}', bj.normalise_keys)) == {"dir": {"L": 2.0}, "deg": {"H": 3.0}, "reason": "w"}
    good = '{"dir":{"L":0.1,"C":0.8,"R":0.1},"deg":{"L":0.7,"M":0.2,"H":0.1},"reason":"r"}'
    text = json.loads(one(spark, good, lambda c: bj.formatted(c, "text")))["text"]
    assert "Direction: Center (80.0%)" in text and "Degree: Low (70.0%)" in text and "Confidence: 41.7%" in text
    assert json.loads(one(spark, good, bj.formatted))["confidence"] == 0.417
    assert one(spark, '{"dir":{}}', bj.formatted) is None


def test_sections(spark):
    text = "short\nText: x\nfew words\none two three four five\n<script a\none two three four five\n</script>\none two three four six\n---\nfew"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    kept = sorted((r["id"], r["n"]) for r in filter_sections(docs, "id", "text").collect())
    assert kept == [(1, 0), (1, 1), (1, 3), (1, 7), (1, 8), (1, 9), (3, 0)]


def test_pages():
    html = "<body><nav>menu</nav><article>Hello <b>big</b>\n world<script>x</script><div class='ad'>buy</div><br>end</article></body>"
    assert readable(html) == "menu Hello big world end" or readable(html) == "Hello big world end"
    assert readable("<div>only</div>") == "only" and readable("") == "" and readable(None) is None


def test_cache(spark):
    folder = "/root/testdata/sf0.001"
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/events.parquet").selectExpr("user_id", "cast(cast(ts as timestamp) as double) as at").collect():
        rows[r["user_id"]].append(r["at"])
    want = []
    for user, times in rows.items():
        stored = None
        for at in sorted(times):
            hit = stored is not None and at - stored < 86_400
            stored = stored if hit else at
            want.append((user, int(at), hit))
    assert got(registry.queries()["X6_cache_hits"](spark, folder)) == sorted(want)


def test_graph_and_models(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<double>")
    assert [(r["a"], r["b"]) for r in pairs_within(vectors, "id", "v", 0.9).collect()] == [(1, 2)]
    assert got(graph.dbscan(vectors, "id", "v", 0.9, 2)) == [(1, 1), (2, 1), (3, -1), (4, -1), (5, -1)]
    assert got(pairs_within(vectors.limit(0), "id", "v", 0.9)) == []
    texts = spark.createDataFrame([(1, "aa bb"), (2, ""), (3, None), (4, "bb aa aa")], "i int, x string")
    made = {r["id"]: r["vector"] for r in models.embed_hashed(texts, "i", "x").collect()}
    assert sorted(made) == [1, 2, 4] and set(made[2]) == {0.0}
    assert all(abs(sum(x * x for x in made[i]) - 1) < 1e-9 for i in (1, 4)) and sum(a * b for a, b in zip(made[1], made[4], strict=True)) > 0.9
    with pytest.raises(ValueError, match="entities"):
        models.tag_entities(F.col("x"), {"A": tuple(map(str, range(11)))}, limit=10)


def test_final_json_is_that_of_a_scan(spark):
    """brackets are looked at, not characters, once for each text; the plan holds no fold over characters."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("{}[]aé") for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", "x", '{"a":[1]} then {"b":{"c":2}} end']

    def scan(text):
        end = max((text or "").rfind("}"), (text or "").rfind("]"))
        depth, pair = 0, "{}" if end >= 0 and text[end] == "}" else "[]"
        for i in range(end, -1, -1):
            depth += (text[i] == pair[1]) - (text[i] == pair[0])
            if not depth and text[i] == pair[0]:
                return text[i : end + 1]
        return None

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bj.final_json(F.col("t")).alias("o"))
    assert {r["i"]: r["o"] for r in df.collect()} == {i: scan(t) for i, t in enumerate(texts)}
    assert "aggregate(" not in df._jdf.queryExecution().analyzed().toString()


def test_records_are_parsed_once(spark):
    """before, each field of a record parsed it anew."""
    df = spark.createDataFrame([('{"dir":{"left":0.2,"C":0.7,"R":0.1},"deg":{"L":0.1,"M":0.2,"H":0}, "why":"w"}',)], "o string").select(bj.formatted(bj.normalise_keys(F.col("o")), "compact").alias("x"))
    assert df.first()["x"] == '{"direction":"Center","degree":"Medium","reason":"w"}'
    assert df._jdf.queryExecution().analyzed().toString().lower().count("from_json") <= 2


def test_results_without_json_between(spark):
    """before, each record went through JSON twice more, and all rows of a row group in one task."""
    from presswork.plans import registry

    odd = ['{"dir":{"left":0.2,"C":0.7,"R":0.1},"deg":{"L":0.1,"M":0.2,"H":0}, "why":"w"}', '{"dir":{"L":1,"C":1,"R":0},"intensity":{"L":0,"M":0,"H":1e-3},"reason":"' + "r" * 101 + '"}', '{"dir":{"L":1,"C":1},"deg":{"L":0,"M":0,"H":1},"reason":"r"}', '{"dir":{"L":1,"C":1,"R":0},"deg":{"L":0,"M":0,"H":1}}', "{}", "[1]", "", "no", None, '{"orientation":{"L":"NaN","C":2,"R":0},"deg":{"l":0,"moderate":3,"H":1},"analysis":"\\"q\\" ü"}', '{"dir":null,"deg":1,"reason":{"a":1}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, o string")
    for style, kinds in (("compact", "direction string, degree string, reason string"), ("text", "text string, direction string, degree string"), ("json", f"{bj.SHAPE}, dominant_direction string, dominant_degree string, confidence double")):
        both = df.select("i", bj.results(F.col("o"), style).alias("x"), F.from_json(bj.formatted(bj.normalise_keys(F.col("o")), style), kinds).alias("y")).collect()
        assert [str(r["x"]) for r in both] == [str(r["y"]) for r in both] and both[0]["x"] is not None and both[2]["x"] is None
    plan = registry.queries()["F56_compact_results"](spark, "/root/testdata/sf0.001")
    assert plan._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") == 1 and plan.rdd.getNumPartitions() > 1
