"""TF-IDF vectors in blocks and profiles against plain versions, also for ids that stand several times."""

import math
from collections import Counter, defaultdict

import pytest
from presswork.operators import models, term_vectors
from presswork.operators.term_vectors import TermVectors
from pyspark.sql import functions as F

DOCS = [(i, [f"w{j}" for j in range(40) if (i * 7 + j * j) % 5 < 3] * (1 + i % 3)) for i in range(60)] + [(3, ["w1", "x", "x"]), (3, None), (None, ["y", "w2"]), (None, ["y"]), (99, []), (98, None)]


def plain(docs):
    tf = defaultdict(Counter)
    for i, terms in docs:
        tf[i].update(terms or [])
    df = Counter(t for c in tf.values() for t in c)
    raw = {i: {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()} for i, c in tf.items()}
    return {(i, t): w / math.sqrt(sum(x * x for x in c.values())) for i, c in raw.items() for t, w in c.items()}


def shuffled(spark, job):
    """Rows that the job's stages write for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup(group := f"term vectors {id(job)}", "")
    try:
        job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in spark.sparkContext.statusTracker().getJobIdsForGroup(group) for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.fixture(params=[1, 8 << 20])
def docs(spark, monkeypatch, request):
    monkeypatch.setattr(term_vectors, "BLOCK_BYTES", request.param)
    return spark.createDataFrame(DOCS, "doc long, terms array<string>").repartition(3)


def test_weights(spark, docs):
    want = plain(DOCS)
    vectors = TermVectors(docs, "doc", "terms")
    got = {(r["id"], r["term"]): r["weight"] for r in vectors.weights().collect()}
    assert got == pytest.approx(want) and vectors.weights().count() == len(want)
    some = spark.createDataFrame([(3,), (7,), (500,)], "id long")
    for part in (vectors.weights(some), TermVectors(docs, "doc", "terms", some).weights()):
        assert {(r["id"], r["term"]): r["weight"] for r in part.collect()} == pytest.approx({k: w for k, w in want.items() if k[0] in (3, 7)})
    profile = spark.createDataFrame([("x", 2.0), ("y", 0.5), ("nowhere", 1.0)], "term string, p double")
    assert {r["id"]: r["dot"] for r in vectors.dots(profile).collect()} == pytest.approx({3: 2 * want[3, "x"], None: 0.5 * want[None, "y"]})
    empty = TermVectors(docs.limit(0), "doc", "terms")
    assert empty.weights().collect() == [] and empty.dots(profile).collect() == []


@pytest.mark.parametrize("small", [False, True])
def test_profiles(spark, monkeypatch, small):
    if small:
        for name, n in (("RATINGS", 5), ("ENTRIES", 50), ("PRODUCTS", 30), ("SUMS", 40)):
            monkeypatch.setattr(models, name, n)
    weights = plain(DOCS)
    rows = [(u, (u * 5 + k) % 70, float(u % 4 + k)) for u in range(30) for k in range(12)] + [(1, 5, 2.0), (1, 5, None), (50, 4, None), (50, 6, 1.0), (51, 4, 1.0), (51, 6, -1.0), (52, 69, 1.0), (None, 4, 1.0)]
    sums, total = defaultdict(float), Counter()
    held = {i for i, _ in weights}
    for u, i, r in rows:
        if u is not None and i in held:
            total[u] += r or 0
            for (d, t), w in weights.items():
                if d == i:
                    sums[u, t] += (r or 0) * w
    want = {k: s / total[k[0]] for k, s in sums.items() if total[k[0]]}
    ratings = spark.createDataFrame(rows, "user_id long, id long, rating double")
    table = TermVectors(spark.createDataFrame(DOCS, "doc long, terms array<string>"), "doc", "terms", ratings).weights()
    got = models.profiles(ratings, table).collect()
    assert len(got) == len(want) and {(r["user_id"], r["term"]): r["weight"] for r in got} == pytest.approx(want)
    sizes = {r["user_id"]: (r["n_terms"], r["total"]) for r in models.profile_sizes(ratings, table).collect()}
    assert {u: n for u, (n, _) in sizes.items()} == Counter(u for u, _ in want)
    assert all(x == pytest.approx(sum(w for (v, _), w in want.items() if v == u)) for u, (_, x) in sizes.items())


def test_profiles_are_not_shuffled_by_term(spark):
    """before, every (user, document, term) and every (user, term) was shuffled."""
    docs = spark.range(20).select("id", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda j: F.concat(F.lit("w"), j)).alias("terms"))
    ratings = spark.range(2_000).select((F.col("id") % 100).alias("user_id"), (F.col("id") % 20).alias("id"), F.lit(1.0).alias("rating"))
    n = shuffled(spark, lambda: models.profile_sizes(ratings, TermVectors(docs, "id", "terms", ratings).weights()).collect())
    assert n < 100 * 200  # the profiles have as many terms


def test_pairs_are_not_shuffled(spark):
    """before, every (document, term) was shuffled, several times."""
    docs = spark.range(0, 2_000, 1, 2).select("id", F.transform(F.sequence(F.lit(0), F.lit(49)), lambda j: F.concat(F.lit("w"), j)).alias("terms"))
    rated = spark.createDataFrame([(1, 3, 1.0)], "user_id long, id long, rating double")
    assert shuffled(spark, lambda: TermVectors(docs, "id", "terms").weights().write.format("noop").mode("overwrite").save()) < 2_000 * 50 / 5
    assert shuffled(spark, lambda: models.recommend(rated, TermVectors(docs, "id", "terms"), 5).collect()) < 2_000 * 50 / 5


@pytest.fixture
def many_blocks(spark):
    """40 blocks (one in each task) of five documents with the same 200 terms each; as with large tables, none is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.range(0, 200, 1, 40).select("id", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda j: F.concat(F.lit("w"), j)).alias("terms"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recommended_shuffles_no_terms_of_blocks(spark, many_blocks):
    """before, every (block, term) was a row of several shuffles."""
    rated = spark.createDataFrame([(1, 3, 1.0)], "user_id long, id long, rating double")
    vectors = TermVectors(many_blocks, "id", "terms")
    assert vectors.blocks.count() == 40
    assert shuffled(spark, lambda: models.recommend(rated, vectors, 5).collect()) < 40 * 200 / 2


def test_weights_shuffle_no_terms_of_blocks(spark, many_blocks):
    """before, every (block, term) was a row of several shuffles."""
    vectors = TermVectors(many_blocks, "id", "terms")
    assert shuffled(spark, lambda: vectors.weights().write.format("noop").mode("overwrite").save()) < 40 * 200 / 2


def test_blocks_are_not_shuffled(spark, many_blocks):
    """before, blocks were shuffled to what is known of their words, so all their bytes stood on disk twice."""
    vectors, profile = TermVectors(many_blocks, "id", "terms"), spark.createDataFrame([("w3", 1.0)], "term string, p double")
    for found, moved in ((vectors.weights(), 1), (vectors.dots(profile), 2)):  # what is known of words and what the profile has of them
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(block#") == moved and found.count() > 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rows_")]


def test_equal_weights_meet(spark):
    """before, a block's rows came by term; written, their weights took 8 bytes each."""
    docs = spark.range(0, 300, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(40) + F.col("id") % 5), lambda j: F.concat(F.lit("w"), j * (F.col("id") % 3 + 1))).alias("terms"))
    rows = TermVectors(docs, "id", "terms").weights().collect()
    falls = sum(a["weight"] > b["weight"] for a, b in zip(rows, rows[1:], strict=False))
    assert falls <= 1  # where terms of few documents begin
