"""Repeated passages against brute force."""

import random

from presswork.llm import repeats
from pyspark.sql import functions as F

from . import brute


def check(docs, n=20):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute.repeats(rows, n)
    out = {r["doc_id"]: r for r in repeats.remove_repeats(docs, n).collect()}
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in out.items()} == want
    for i, text in rows:
        words, passages = brute.words(text), out[i]["passages"]
        gone = {j for p in passages for j in range(p["start"], p["start"] + p["words"])}
        assert " ".join(w for j, w in enumerate(words) if j not in gone) == out[i]["kept"] and all(p["words"] >= n for p in passages)
        assert all(a["start"] + a["words"] < b["start"] for a, b in zip(passages, passages[1:], strict=False))  # maximal
    return sum(x[1] for x in want.values())


def test_fixture(spark):
    assert check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")) > 1000


def test_random(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    rows = []
    for i in range(300):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            text += p if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.3:
                text[rng.randrange(len(text))] = "x"
        rows.append((rng.randint(-5, 5) * 1000 + i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert check(docs) > 100 and check(docs, 7) > 100


def test_odd(spark):
    docs = spark.createDataFrame(list(enumerate(brute.ODD)), "doc_id long, text string")
    check(docs)
    null = spark.createDataFrame([(None, "a " * 50), (None, "a " * 50), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeats.remove_repeats(null).collect()) == [0, 0, 0, 0]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    """Rows of one id are documents of their own, by a hash of the text; rows equal in both are one."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["kept"][:2], r["n_removed"]) for r in repeats.remove_repeats(docs).collect())
    assert got == [(1, "a0", 0), (2, "", 30), (2, "b0", 0), (2, "b0", 0)]
    rng = random.Random(7)
    rows = [(i // 3, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted({(r["doc_id"], r["tie"], r["text"]) for r in docs.withColumn("tie", F.xxhash64("text")).collect()})
    want = brute.repeats([((i, tie), t) for i, tie, t in order], 6)
    by_text = {(i, t): want[i, tie] for i, tie, t in order}
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(docs, 6).collect())
    assert got == sorted((i, *by_text[i, t]) for i, t in rows)
