"""Operators without a SQL twin: clusterings, paragraphs, caches, model tools, ranks; and odd inputs of those that have one."""

import datetime
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.functions import formats, heuristics, pages
from presswork.operators import clusters, inference, ranking, work
from presswork.sources import feeds, writers


def blobs(seed=3):
    rng = np.random.default_rng(seed)
    centers = np.eye(6)[:3]
    rows = [c + rng.normal(0, 0.03, 6) for c in centers for _ in range(12)]
    return np.array(rows + [np.array([-1.0, 1, -1, 1, -1, 1]), np.array([1.0, -1, -1, -1, 1, 1])]), np.repeat(np.arange(3), 12)


def mean_linkage(vectors, threshold):
    """By the definition: all pairs of clusters are looked at anew after each merge."""
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    far = 1 - v @ v.T
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        d, a, b = min((far[np.ix_(x, y)].mean(), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2))
        if d >= threshold:
            break
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups)


def test_average_linkage():
    vectors, _ = blobs()
    rng = np.random.default_rng(1)
    for table, threshold in ((vectors, 0.5), (rng.normal(size=(40, 4)), 0.3), (rng.normal(size=(40, 3)), 0.8), (vectors[:1], 0.5)):
        labels = clusters.average_linkage(table, threshold)
        assert sorted(np.flatnonzero(labels == k).tolist() for k in set(labels.tolist())) == mean_linkage(table, threshold)


def test_density_tree():
    vectors, own = blobs()
    labels, probability = clusters.hdbscan(vectors, 5, 2)
    found = labels[:36].reshape(3, 12)
    assert labels.max() == 2 and all(len(set(x.tolist()) - {-1}) == 1 and (x >= 0).sum() >= 9 for x in found)
    assert len({x.max() for x in found}) == 3 and (probability >= 0).all() and (probability <= 1).all() and (probability[labels < 0] == 0).all()
    assert (clusters.hdbscan(vectors[:3])[0] == -1).all()


def test_groups(spark):
    vectors, _ = blobs()
    rows = [("a", i, v.tolist()) for i, v in enumerate(vectors)] + [("b", 0, [1.0, 0.0]), ("b", 1, None)]
    table = spark.createDataFrame(rows, "g string, i int, v array<double>")
    got = {(r["group"], r["id"]): r["cluster"] for r in clusters.by_group(table, "g", "i", "v").collect()}
    assert got["b", 0] == 0 and got["b", 1] == -1 and len({got["a", i] for i in range(36)}) == 3
    assert clusters.by_group(table.limit(0), "g", "i", "v", method="density").count() == 0
    with pytest.raises(Exception, match="at most 5"):
        clusters.by_group(table, "g", "i", "v", most=5).collect()


@pytest.mark.parametrize("tile", [7, 2_048])
def test_groups_in_tiles(spark, monkeypatch, tile):
    """Groups are cut into tiles (before, a group beyond 4,000 rows was an error); clusters are those of a group at once."""
    monkeypatch.setattr(clusters, "TILE", tile)
    rng = np.random.default_rng(8)
    a = np.concatenate([c + rng.normal(0, 0.25, (25, 5)) for c in rng.normal(size=(3, 5))] + [rng.normal(size=(10, 5))])
    rows = [("a", i, v.tolist()) for i, v in enumerate(a)] + [(None, i, v.tolist()) for i, v in enumerate(a[:30, ::-1])] + [("b", 0, [1.0] * 5), ("b", 1, None), ("c", 5, [0.0] * 5), ("c", 6, [1.0] * 5), ("c", 7, [1.0] * 5)]
    table = spark.createDataFrame(rows, "g string, i int, v array<double>").repartition(3)
    for method, options in (("average", {}), ("average", {"threshold": 0.2}), ("density", {}), ("density", {"min_cluster": 3, "min_samples": 4})):
        got = {(r["group"], r["id"]): r for r in clusters.by_group(table, "g", "i", "v", method=method, **options).collect()}
        assert len(got) == len(rows) and got["b", 1]["cluster"] == -1
        for g, whole in (("a", a), (None, a[:30, ::-1]), ("c", np.array([[0.0] * 5, [1.0] * 5, [1.0] * 5]))):
            first = 5 if g == "c" else 0
            own = [got[g, first + i]["cluster"] for i in range(len(whole))]
            if method == "average":
                assert own == clusters.average_linkage(whole, **options).tolist()
            else:
                want, probability = clusters.hdbscan(whole, **options)
                assert own == want.tolist() and [got[g, first + i]["probability"] for i in range(len(whole))] == pytest.approx(probability.tolist())


def test_groups_beyond_4000(spark):
    rng = np.random.default_rng(9)
    table = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(np.repeat(np.eye(8), 550, 0) + rng.normal(0, 0.02, (4400, 8)))], "g int, i int, v array<float>")
    for method in ("average", "density"):
        found = clusters.by_group(table, "g", "i", "v", method=method, **({"min_cluster": 400} if method == "density" else {})).filter("cluster >= 0")
        assert [(r["of"], r["n"]) for r in found.groupBy(F.floor(F.col("id") / 550).alias("of")).agg(F.countDistinct("cluster").alias("n")).orderBy("of").collect()] == [(i, 1) for i in range(8)]


def test_paragraphs():
    assert pages.paragraph_text("<p> one <b>two</b>&amp;</p><script>'<p>no</p>'</script><div><p>three<p>four</div>five<p> </p>") == "one two&\n\nthree\n\nfour"
    assert pages.paragraph_text("<div>nothing</div>") is None and pages.paragraph_text(None) is None and pages.paragraph_text("") is None
    assert pages.paragraph_text("<p>open " + "x" * 50_000) == "open " + "x" * 50_000


def test_cache(spark):
    now, asked = [0.0], []
    cache = work.ResultCache(60, lambda: now[0])

    def make():
        asked.append(1)
        return spark.range(len(asked))

    assert [cache.get("k", make).count() for _ in range(2)] == [1, 1]
    now[0] = 59.0
    assert cache.get("k", make).count() == 1 and cache.get("other", make).count() == 2
    now[0] = 60.0
    assert cache.get("k", make).count() == 3
    cache.drop("k")
    assert cache.get("k", make).count() == 4


def test_tools(spark, tmp_path):
    tools = inference.BiasTools(spark)
    assert tools.get_model_info() == {"name": "keywords", "loaded": False, "fallback": "keywords"}
    left = tools.analyze_bias("Progressive climate and healthcare plans")
    assert left["dl"] == 0.9 and left["how"] == "heuristic" and left["reason"].endswith("3 left, 0 right, 0 neutral signals")
    none = tools.analyze_bias("")
    assert (none["dl"], none["dc"], none["gm"]) == (0.33, 0.34, 0.34)
    answer = '{"dir":{"L":0.25,"C":0.25,"R":0.5},"deg":{"L":1.0,"M":0.0,"H":0.0},"reason":"told"}'
    loaded = inference.BiasTools(spark, "fixed", lambda c: F.lit(answer))
    assert loaded.analyze_bias("x")["dr"] == 0.5 and loaded.analyze_bias("x")["how"] == "strict"
    (tmp_path / "a.txt").write_text("taxes, border, faith")
    (tmp_path / "b.bin").write_text("not read")
    assert [(r["path"].rsplit("/", 1)[1], r["dr"]) for r in tools.analyze_file(f"file://{tmp_path}").collect()] == [("a.txt", 0.9)]
    docs = spark.createDataFrame([(1, "x")], "i int, t string")
    assert loaded.compare_bias(docs, "i", "t", heuristics.bias).first()["same"] is False
    loaded.unload_model()
    assert loaded.get_model_info()["loaded"] is False and loaded.analyze_bias("x")["how"] == "heuristic"


def test_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Dr. Ann Lee by Tom Park in Chicago, city of crime. killed killed peace")], "i int, t string")
    c = F.col("t")
    got = {r["i"]: r for r in rows.select("i", heuristics.people(c).alias("p"), heuristics.places(c).alias("w"), heuristics.topics(c).alias("x"), heuristics.tone(c).alias("tone"), heuristics.colour(c).alias("colour"), formats.compact_json(c).alias("json"), formats.bias_block(c).alias("b"), formats.is_valid_bias(c).alias("ok")).collect()}
    assert got[1]["p"] is None and got[1]["w"] is None and got[1]["tone"] == "neutral" and got[1]["colour"] == heuristics.OTHER_COLOUR and got[1]["json"] == "{}"
    assert (got[2]["p"], got[2]["w"], got[2]["x"], got[2]["tone"]) == ([], [], [], "neutral") and got[2]["b"] == "<bias>\n(none)\n</bias>"
    assert (got[3]["p"], got[3]["w"], got[3]["x"], got[3]["tone"]) == (["Ann Lee", "Tom Park"], ["Chicago"], ["crime", "city"], "negative")
    assert got[3]["b"].startswith("<bias>\nDr. Ann") and not got[3]["ok"] and not got[1]["ok"]


def test_ranks_and_splits(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert all(r["k"] + 1 == r["rank"] for r in ranking.global_rank(rows, [F.col("k")]).collect())
    assert ranking.global_rank(rows.limit(0), [F.col("k")]).count() == 0
    for n, want in ((1000, 200), (7, 2), (5, 1), (4, 1), (2, 1), (1, 0), (0, 0)):
        got = ranking.split(spark.range(n), "id")
        assert got.count() == n and got.filter("is_test").count() == want
    first = {r["id"] for r in ranking.split(spark.range(1000), "id").filter("is_test").collect()}
    assert first == {r["id"] for r in ranking.split(spark.range(1000).repartition(7), "id").filter("is_test").collect()}


def test_agents(spark):
    agents = spark.createDataFrame([("a", 0), ("b", 1)], "agent string, place int")
    tries = spark.createDataFrame([("u", "a", 403, None), ("u", "b", 200, "body"), ("v", "a", 429, None), ("v", "b", 403, None), ("w", "a", 404, None), ("w", "b", 200, "late")], "url string, agent string, status int, body string")
    got = sorted((r["url"], r["agent"], r["body"], r["how"]) for r in feeds.by_agents(tries, agents).collect())
    assert got == [("u", "b", "body", "fetched"), ("v", None, None, "external"), ("w", "a", None, "HTTP 404")]


def test_gated_flush(spark):
    from presswork.plans import registry

    folder = "/root/testdata/sf0.001"
    buffers, ticks, want = {}, {}, []
    for r in sorted(spark.read.parquet(f"{folder}/events.parquet").collect(), key=lambda r: r["ts"]):
        user, now = r["user_id"], int(r["ts"].replace(tzinfo=datetime.timezone.utc).timestamp())
        if user in ticks and now >= ticks[user] and len(buffers[user]) >= 100:
            want.append((user, ticks[user], buffers[user]))
            buffers[user] = ""
        if now >= ticks.get(user, 0):
            ticks[user] = now // 21_600 * 21_600 + 21_600
        buffers[user] = buffers.get(user, "") + f"{r['event_type']} {r['event_id']}. "
    got = [tuple(r) for r in registry.queries()["X4_gated_flush"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and len(want) > 3


def test_page_of_graph(spark):
    edges = spark.createDataFrame([("a</script>", 'b"', None), ("a</script>", "King", "x")], "source string, target string, relationship string")
    lines = [r["value"] for r in writers.html_lines(edges, "A & B").orderBy("place").collect()]
    assert lines[0].startswith("<!doctype html><title>A &amp; B</title>") and lines[-1].startswith("<script>const read") and len(lines) == 7
    data = [json.loads(x.split(">", 1)[1].rsplit("</script>", 1)[0]) for x in lines[1:-1]]
    assert all(x.count("</script>") == 1 for x in lines[1:-1]) and {"id": "King", "color": "#3498db"} in data and {"source": "a</script>", "target": 'b"', "label": ""} in data
