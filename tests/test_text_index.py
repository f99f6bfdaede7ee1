"""The inverted index against scans."""

import math
import random
import re

import pytest
from presswork.operators import text_index
from presswork.operators.text_index import TextIndex

SCHEMA = "id long, text string"


def words(t):
    return re.findall(r"[^ \t-\r]+", (t or "").lower())


def bm25(rows, terms, k1=1.5, b=0.75, eps=0.25):
    """[(id, score)] of all rows, in order."""
    held = [words(t) for _, t in rows]
    mean = sum(map(len, held)) / len(held)
    df = {}
    for w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log((len(rows) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    floor = eps * sum(raw.values()) / max(1, len(raw))
    out = []
    for (i, _), w in zip(rows, held, strict=True):
        s = 0.0
        for t in terms:
            if tf := w.count(t):
                s += (floor if raw[t] < 0 else raw[t]) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
        out.append((i, s))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Under", "licensed", "unlicensed", "under(", "é", "the"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    out = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choices(vocabulary, weight, k=rng.randint(0, 60)))) for i in range(250)]
    return out + [(3, "licensed under the"), (3, "licensed under the"), (9001, None), (9002, ""), (9003, "licensed  under"), (9004, "UNLICENSED UNDER("), (9005, "x" * 5000 + " the " * 3000)]


@pytest.fixture(scope="module", params=[(5, 2000)])
def index(spark, rows, request):
    patch = pytest.MonkeyPatch()
    patch.setattr(text_index, "BITS", request.param[0])
    patch.setattr(text_index, "WORDS", request.param[1])
    yield TextIndex.build(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", term string").repartition(3), "id", "text")
    patch.undo()


def test_phrases(index, rows):
    held = [(i, words(t)) for i, t in rows]
    for phrase in (["licensed", "under"], ["the"], ["w1", "w0", "w1"], ["W0", "w0"], ["nowhere"], ["the", "nowhere"]):
        low = [p.lower() for p in phrase]
        want = sorted(i for i, w in held if any(w[j : j + len(low)] == low for j in range(len(w))))
        assert sorted(r["id"] for r in index.phrase(phrase).collect()) == want
    assert index.phrase([]).collect() == []


def test_containing(index, rows):
    for text in ("licensed under", "Licensed Under(", "ed u", "w1\nw", "the ", "nowhere", " ", ""):
        want = sorted(i for i, t in rows if t is not None and text.lower() in t.lower())
        assert sorted(r["id"] for r in index.containing(text).collect()) == want, text


def test_scores(index, rows):
    for terms in (["the"], ["w0", "w5", "licensed"], ["w0", "w0"], ["nowhere", "é"]):
        want = sorted((i, round(s, 6)) for i, s in bm25(rows, terms) if s)
        got = index.scores(terms).join(index.docs, "no").collect()
        assert sorted((r["id"], round(r["score"], 6)) for r in got) == want


def test_top(index, rows):
    for terms, k in ((["licensed", "under"], 5), (["w3", "w50", "é"], 20), (["the"], 1), (["nowhere"], 3), (["w59"], 1000)):
        best = sorted(((-round(s, 9), i) for i, s in bm25(rows, terms) if s > 0))[:k]
        got = [(r["id"], round(r["score"], 6), r["rank"]) for r in index.top(terms, k).collect()]
        assert sorted(got, key=lambda r: r[2]) == [(i, round(-s, 6), n + 1) for n, (s, i) in enumerate(best)]


def test_blocks_are_left_out(spark, monkeypatch):
    """One document is far better than all others: their blocks are never scored."""
    monkeypatch.setattr(text_index, "BITS", 3)
    rows = [(i, "news of the day " * 20) for i in range(400)] + [(1000, "rare " * 30)] + [(2000 + i, "rare " + "word " * 200) for i in range(200)]
    index = TextIndex.build(spark.createDataFrame(rows, SCHEMA).coalesce(1), "id", "text")
    assert [r["id"] for r in index.top(["rare"], 1).collect()] == [1000]
    assert index.skipped > 5


def test_only_rows_of_the_terms_are_read(index):
    plan = index.rows(["the"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan or "EqualTo(term" in plan


def test_reopened_and_empty(spark, index):
    again = TextIndex(spark, index.path)
    assert again.phrase(["licensed", "under"]).count() == index.phrase(["licensed", "under"]).count()
    none = TextIndex.build(spark.createDataFrame([], SCHEMA), "id", "text")
    assert none.phrase(["a"]).collect() == none.containing("a").collect() == none.top(["a"], 3).collect() == none.scores(["a"]).collect() == []
