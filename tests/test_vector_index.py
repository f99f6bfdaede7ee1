"""The vector index against a scan."""

import numpy as np
import pytest
from presswork.operators import graph, vector_index
from presswork.operators.vector_index import VectorIndex, neighbours, pairs_within, search_within
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.1"
SCHEMA = "id long, v array<float>"


def scan(rows, queries, least=-1.0, others=False):
    """{query: [(-cos, id)], best first}"""
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    ids = [i for i, _ in rows]
    cos = unit(np.array([v for _, v in queries], np.float32).astype(float)) @ unit(np.array([v for _, v in rows], np.float32).astype(float)).T
    return {q: sorted((-round(c, 9), i) for i, c in zip(ids, own, strict=True) if c >= least - 1e-12 and not (others and i == q)) for (q, _), own in zip(queries, cos.tolist(), strict=True)}


def clustered(n, dims, groups, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(i, (centres[i % groups] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = clustered(1500, 16, 12, 0.5)
    return out + [(5000 + i, v) for i, v in out[:40]]  # copies: ties


def got(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((-round(r["cos"], 9), r["id"]))
    return out


def test_exact_is_a_scan(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = VectorIndex.build(df, "id", "v")
    queries = rows[::97]
    for n in (1, 7, 60):
        want = {q: hits[:n] for q, hits in scan(rows, queries).items()}
        assert got(index.search(spark.createDataFrame(queries, SCHEMA), "id", "v", n, probes=2, exact=True)) == want
    assert index.compared.value <= index.offered.value
    again = VectorIndex(spark, index.path)  # from the folder alone
    assert got(again.search(spark.createDataFrame(queries, SCHEMA), "id", "v", 7, probes=1, exact=True)) == {q: hits[:7] for q, hits in scan(rows, queries).items()}


def test_recall_and_pruning(spark):
    """Of the ten nearest of a scan at least nine in ten are found, and only the cells that are looked into are read."""
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = VectorIndex.build(df, "id", "v")
    assert index.calibrate(n=10, recall=0.95) >= 0.95 and 1 <= index.probes < len(index.cells)
    queries = df.filter("id % 100 = 0")
    all_rows = [(r["id"], r["v"]) for r in df.collect()]
    want = scan(all_rows, [x for x in all_rows if x[0] % 100 == 0])
    index.offered.value = index.compared.value = 0
    found = got(index.search(queries, "id", "v", 10))
    hit = sum(len({i for _, i in found[q]} & {i for _, i in hits[:10]}) for q, hits in want.items())
    assert hit >= 0.9 * 10 * len(want)
    assert index.compared.value <= index.offered.value < len(want) * len(all_rows)
    assert "PartitionFilters: [cell" in index.blocks([0, 1])._jdf.queryExecution().toString()
    assert index.blocks([0, 1]).select(F.input_file_name()).distinct().count() < index.blocks().select(F.input_file_name()).distinct().count()


def test_neighbours(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for k, least in ((3, -1.0), (10, 0.8)):
        want = {q: hits[:k] for q, hits in scan(rows, rows, least, others=True).items() if hits}
        assert got(neighbours(df, "id", "v", k, least)) == want


@pytest.mark.parametrize("least", [0.4, 0.9, 1.0 - 1e-9])
def test_pairs_within(spark, rows, least):
    want = {(q, i, -c) for q, hits in scan(rows, rows, least).items() for c, i in hits if q < i}
    pairs = pairs_within(spark.createDataFrame(rows, SCHEMA), "id", "v", least).collect()
    assert len(pairs) == len(want) and {(r["a"], r["b"]) for r in pairs} == {x[:2] for x in want}


def test_hot_cell(spark, monkeypatch):
    """A third of all vectors are one vector: blocks and shares bound what is together; all hits are there."""
    monkeypatch.setattr(vector_index, "TASK_ROWS", 50)
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    monkeypatch.setattr(vector_index, "QUERIES", 8)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(150)] + [(1000 + i, v) for i, v in clustered(300, 3, 5, 0.3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = VectorIndex.build(df, "id", "v")
    assert index.blocks().select(F.max(F.size("ids"))).first()[0] <= 16
    want = {q: hits[:160] for q, hits in scan(rows, rows[:3] + rows[-3:]).items()}
    assert got(index.search(df.filter("id < 3 or id > 1296"), "id", "v", 160, exact=True)) == want
    assert neighbours(df, "id", "v", 2, 0.5).groupBy("query").count().agg(F.max("count")).first()[0] <= 2


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [float("nan"), 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, v array<float>, cell string, query int")
    index = VectorIndex.build(df, "id", "v")
    hits = index.search(df, "id", "v", 9, exact=True).collect()
    assert {r["query"] for r in hits} == {1, 7} and {r["id"] for r in hits} == {1, 7}
    for empty in (df.limit(0), df.filter("id = 3")):
        assert VectorIndex.build(empty, "id", "v") is None
        assert pairs_within(empty, "id", "v", 0.5).collect() == [] and neighbours(empty, "id", "v", 3).collect() == []
    assert index.search(df.limit(0), "id", "v", 3, exact=True).collect() == []


def test_filtered(spark, rows):
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), "id", "v")
    queries = rows[:3]
    allowed = spark.createDataFrame([(i,) for i, _ in rows if i % 3 == 0], "id long")
    want = {q: [h for h in hits[:100] if h[1] % 3 == 0][:5] for q, hits in scan(rows, queries).items()}
    assert got(search_within(index, spark.createDataFrame(queries, SCHEMA), "id", "v", 5, allowed, over=20, exact=True)) == {q: h for q, h in want.items() if h}


def test_calibrated_on_clusters(spark, rows):
    """Where vectors do hang together a few cells are enough, and few pairs are multiplied in full."""
    df = spark.createDataFrame([r for r in clustered(4000, 32, 40, 0.25)], SCHEMA)
    index = VectorIndex.build(df, "id", "v")
    index.calibrate(n=10, recall=0.95, queries=50)
    all_rows = [(r["id"], r["v"]) for r in df.collect()]
    want = scan(all_rows, [x for x in all_rows if x[0] % 100 == 0])
    index.offered.value = index.compared.value = 0
    found = got(index.search(df.filter("id % 100 = 0"), "id", "v", 10))
    assert sum(len({i for _, i in found[q]} & {i for _, i in hits[:10]}) for q, hits in want.items()) >= 0.9 * 10 * len(want)
    assert index.offered.value < 0.35 * len(want) * len(all_rows)
    index.offered.value = index.compared.value = 0
    pairs = index.within(df, "id", "v", 0.4).filter("query < id").count()
    assert pairs == sum(sum(1 for _, i in hits if q < i) for q, hits in scan(all_rows, all_rows, 0.4).items())
    assert index.compared.value < 0.35 * len(all_rows) ** 2  # of all ordered pairs


def test_joins_shuffle_in_proportion(spark):
    """Vectors without clusters: nearly all pairs are looked at, but what is shuffled follows the vectors, not the pairs."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 16)))]
    df = spark.createDataFrame(rows, SCHEMA)
    df.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    for job in (lambda: pairs_within(df, "id", "v", 0.7), lambda: neighbours(df, "id", "v", 3, 0.7)):
        before = written()
        job().collect()
        assert written() - before < 4 * 2000 * 16 * 8


def test_tiles_of_copies(spark, monkeypatch):
    """A third of all vectors are one vector, tiles and blocks are small, ids are text: pairs and ranks are those of a scan."""
    monkeypatch.setattr(vector_index, "TILE_BYTES", 16 * 8 * 3)
    monkeypatch.setattr(vector_index, "BLOCK", 4)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(1000 + i, v) for i, v in clustered(80, 3, 5, 0.3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = scan(rows, rows, 0.9, others=True)
    assert got(neighbours(df, "id", "v", 5, 0.9)) == {q: hits[:5] for q, hits in want.items() if hits}
    text = df.selectExpr("cast(id as string) as id", "v")
    pairs = pairs_within(text, "id", "v", 0.9).collect()
    assert len(pairs) == len({(r["a"], r["b"]) for r in pairs}) == sum(map(len, want.values())) // 2
    assert all(r["a"] < r["b"] for r in pairs)


def test_thinned_edges(spark):
    """All that hangs together still does, with at most one edge less than points in a task; dense groups don't grow with the square."""
    edges = [(i, j) for g in range(3) for i in range(g * 40, g * 40 + 40) for j in range(i + 1, g * 40 + 40)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(2)
    few = graph.thinned(df)
    assert few.count() <= 2 * 3 * 39
    labels = graph.components(spark.range(121), df).collect()
    assert sorted(map(tuple, labels)) == [(i, i // 40 * 40) for i in range(121)]
    assert sorted(map(tuple, graph.components(spark.range(121), few).collect())) == sorted(map(tuple, labels))


def test_neighbours_shuffle_k_rows(spark, monkeypatch):
    """before, each pair of blocks put out k rows of each vector; now a task's best of all it has met."""
    monkeypatch.setattr(vector_index, "TILE_BYTES", 16 * 8 * 40)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 16)))], SCHEMA)
    plan = neighbours(df, "id", "v", 3, -1.0)  # the tiles are written here
    summary = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = summary()
    assert plan.count() == 2000 * 3
    assert summary() - before < 2000 * 3 * 40
