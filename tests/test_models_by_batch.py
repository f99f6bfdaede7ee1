"""Batched model calls, and entities of a table."""

import glob
import random

import duckdb
import pytest
import regex
from presswork.operators.batched import answered
from presswork.operators.gazetteer import find_entities
from presswork.plans import registry

from . import oracle


def counting(folder, answer, fail=lambda texts: False):
    """A factory that leaves a file for each time it is made and for each call."""

    def factory():
        import uuid

        open(f"{folder}/made-{uuid.uuid4().hex}", "w").close()

        def call(texts):
            open(f"{folder}/call-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            if fail(texts):
                raise RuntimeError("busy")
            return [answer(t) for t in texts]

        return call

    return factory


def test_a_call_for_each_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(730)], "id int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = answered(df, "text", [("up", counting(tmp_path, str.upper))]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["id"], r["answer"], r["provider"]) for r in sorted(out)] == [(i, f"T{i}", "up") for i in range(730)]
    assert len(glob.glob(f"{tmp_path}/made-*")) == 1 and len(glob.glob(f"{tmp_path}/call-*")) == 8  # ceil(730 / 100)
    assert len(glob.glob(f"{tmp_path}/call-100-*")) == 7


def test_failures(spark, tmp_path):
    """One bad text spoils its batch, so that is asked text by text; what has no answer goes to the next provider."""
    for name in "ab":
        (tmp_path / name).mkdir()
    df = spark.createDataFrame([(i, None if i == 3 else "bad" if i == 7 else "blank" if i == 8 else f"t{i}") for i in range(20)], "id int, text string").coalesce(1)
    first = counting(tmp_path / "a", lambda t: " " if t == "blank" else t.upper(), lambda texts: "bad" in texts)
    second = counting(tmp_path / "b", lambda t: None if t == "bad" else f"second {t}")
    got = {r["id"]: (r["answer"], r["provider"]) for r in answered(df, "text", [("a", first), ("b", second)], batch=10, retries=1).collect()}
    assert got == {i: (None, None) if i in (3, 7) else ("second blank", "b") if i == 8 else (f"T{i}", "a") for i in range(20)}
    assert len(glob.glob(f"{tmp_path}/a/call-9-*")) == 2 and len(glob.glob(f"{tmp_path}/a/call-1-*")) == 9 and len(glob.glob(f"{tmp_path}/b/call-2-*")) == 1
    with pytest.raises(ValueError):
        answered(df.withColumnRenamed("id", "Answer"), "text", [])
    assert answered(df.limit(0), "text", [("a", first)]).collect() == []


def test_first_characters_are_those_of_sql(spark, tmp_path):
    """ß, ligatures and Greek letters whose upper case is several characters; whitespace that isn't a space is an answer."""
    firsts = "ßŉǰΐᾳᾨﬁéxß\t\n\x1f\u0085\u2028 \u00a0\u3000\u1680\u200b1"
    texts = [f"{c}word" for c in firsts] + ["", None, "ß", "a license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    oracle.compare(spark, con, str(tmp_path), registry.queries()["M5_batched_calls"], registry.oracle_sql()["M5_batched_calls"])


def test_whole_texts_are_shown(spark, tmp_path):
    """What stands after a text's first 2,000 characters, or after its first 200,000, is shown to each provider and answered by SQL."""
    texts = ["x" * n + " license" + "é" * 3_000 for n in (0, 1_990, 1_999, 2_000, 200_000)] + ["x" * 300_000, " " * 3_000 + "license", " " * 3_000 + "y", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    first, second = lambda: lambda some: [None for _ in some], lambda: lambda some: [f"{len(t)} {t[-1:]}" for t in some]
    shown = {r["doc_id"]: r["answer"] for r in answered(df, "text", [("first", first), ("second", second)]).collect()}
    assert shown == {i: None if t is None else f"{len(t)} {t[-1:]}" for i, t in enumerate(texts)}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plan, sql = registry.queries()["M5_batched_calls"], registry.oracle_sql()["M5_batched_calls"]
    got = {r["doc_id"]: (r["answer"], r["provider"]) for r in plan(spark, str(tmp_path)).collect()}
    assert got == {i: (str(len(t)), "first") if t and "license" in t else ("X", "second") if i == 5 else (None, None) for i, t in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    oracle.compare(spark, con, str(tmp_path), plan, sql)


def scan(docs, entities):
    token = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
    known = {}
    for name, label in entities:
        key = tuple(m.group().lower() for m in token.finditer(name or ""))
        if key:
            known.setdefault(key, set()).add(label)
    out = []
    for i, text in docs:
        toks = list(token.finditer(text or ""))
        at = 0
        while at < len(toks):
            for n in range(len(toks) - at, 0, -1):
                key = tuple(m.group().lower() for m in toks[at : at + n])
                if key in known:
                    s, e = toks[at].start(), toks[at + n - 1].end()
                    out.append((i, s, e, text[s:e], sorted(known[key])))
                    at += n
                    break
            else:
                at += 1
    return sorted(out, key=str)


def test_entities_are_those_of_a_scan(spark):
    rng = random.Random(9)
    words = ["New", "York", "new", "the", "Bank", "of", "São", "Paulo", "王芳", "É", "x_1", "U2"]
    entities = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice(["GPE", "ORG"])) for _ in range(60)] + [("", "X"), ("--", "X"), (None, "X"), ("O'Neil", "PERSON"), ("new-york", "ORG")]
    docs = [(i % 70, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(90)] + [(None, "New York"), (5, None), (6, ""), (7, "o'neil O’NEIL newyork")]
    got = find_entities(spark.createDataFrame([(*d, "x") for d in docs], "id long, text string, name string"), "id", "text", spark.createDataFrame(entities, "e string, label string"), "e", "label")
    assert sorted((tuple(r) for r in got.collect()), key=str) == scan(docs, entities)


def test_the_plan_does_not_grow(spark):
    docs = spark.createDataFrame([(1, "entity 77 and entity 12345")], "id long, text string")
    plans = []
    for n in (10, 20_000):
        found = find_entities(docs, "id", "text", spark.range(n).selectExpr("concat('entity ', id) as e", "'X' as label"), "e", "label")
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString().split("\n")))
        assert [r["found"] for r in found.orderBy("start").collect()] == [x for x in ("entity 77", "entity 12345") if int(x[7:]) < n]
    assert plans[0] == plans[1]
    none = spark.createDataFrame([], "e string, label string")
    assert find_entities(docs, "id", "text", none, "e", "label").collect() == [] and find_entities(docs.limit(0), "id", "text", none, "e", "label").collect() == []


def test_tokens_hold_little():
    """Of a batch of texts only the tokens' texts are objects: what is allocated at most follows them."""
    import tracemalloc

    import pyarrow as pa
    from presswork.operators.gazetteer import _cut

    texts = pa.array(["Ab é_1 " * 20_000, None, ""])
    tracemalloc.start()
    out = _cut(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].as_py()[:2] == [{"t": "ab", "s": 0, "e": 2}, {"t": "é_1", "s": 3, "e": 6}] and out.to_pylist()[1:] == [None, []]
    assert peak < 150 * 40_000  # bytes for each token
