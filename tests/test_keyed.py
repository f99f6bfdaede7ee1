"""Stored tables: changes, versions, conflicts and failures."""

import pytest
from presswork.operators.keyed import Conflict, KeyedTable
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark):
    df = spark.createDataFrame([(i, f"t{i}", None if i % 3 else "x") for i in range(30)] + [(None, "null key", None)], "id long, title string, bias string")
    return KeyedTable.create(df, ["id"], buckets=8)


def test_merge_and_versions(spark, table):
    before = rows(table.read())
    assert len(before) == 31 and table.version() == 0
    changes = spark.createDataFrame([(1, "new"), (100, "added"), (None, "changed")], "id long, title string")
    assert table.merge(changes) == 1
    want = sorted([(1, "new", None), (100, "added", None), (None, "changed", None), *(r for r in before if r[0] not in (1, None))], key=str)
    assert rows(table.read()) == want and rows(table.read(0)) == before
    assert table.merge(changes) == 2 and rows(table.read()) == want  # again: the same
    first, last = table.head(1)["parts"], table.head(2)["parts"]
    assert 0 < sum(first[b] != last.get(b) for b in first) <= 3  # three keys touch three buckets at most
    again = KeyedTable(spark, table.path)
    again.drop_old()
    assert rows(again.read()) == want
    with pytest.raises(Exception):
        again.read(0).collect()


def test_fields_kept_or_forced(spark, table):
    changes = spark.createDataFrame([(0, "new"), (1, "new"), (500, "new")], "id long, bias string")
    table.merge(changes, {"bias": F.coalesce("old.bias", "new.bias")}, insert=False)
    assert {r["id"]: r["bias"] for r in table.read().collect() if r["id"] in (0, 1, 2, 500)} == {0: "x", 1: "new", 2: None}
    table.merge(changes, {"bias": F.coalesce("new.bias", "old.bias")}, insert=False)
    assert {r["id"]: r["bias"] for r in table.read().collect() if r["id"] in (0, 1)} == {0: "new", 1: "new"}


def test_repeated_keys(spark, table):
    twice = spark.createDataFrame([(7, "a", 1), (7, "b", 3), (7, "c", 2)], "id long, title string, at int")
    with pytest.raises(ValueError, match="repeated"):
        table.merge(twice.drop("at"))
    with pytest.raises(ValueError, match="repeated"):
        KeyedTable.create(twice, ["id"])
    assert table.version() == 0
    table.merge(twice, latest="at")
    assert [r["title"] for r in table.read().filter("id = 7").collect()] == ["b"]


def test_update(spark, table):
    assert table.update(F.col("id") == -1, {"title": F.lit("none")}) == 0  # nothing to do, no version
    table.update(F.col("id") < 3, {"title": F.upper("title"), "bias": F.lit("y")})
    assert rows(table.read().filter("bias = 'y'")) == [(0, "T0", "y"), (1, "T1", "y"), (2, "T2", "y")]
    with pytest.raises(ValueError):
        table.update(F.col("id") < 3, {"id": F.lit(1)})


def test_a_failed_write_leaves_the_old_version(spark, table):
    before = rows(table.read())
    fails = spark.createDataFrame([(1, "x"), (2, "y")], "id long, title string").withColumn("title", F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="no"):
        table.merge(fails)
    assert table.version() == 0 and rows(table.read()) == before


def test_two_writers(spark, table, monkeypatch):
    """The one that comes second applies its change to what the first has made; neither change is lost."""
    other, commit = KeyedTable(spark, table.path), table._commit
    calls = []

    def late(head):
        if not calls:
            calls.append(1)
            other.merge(spark.createDataFrame([(1, "first")], "id long, title string"))
        commit(head)

    monkeypatch.setattr(table, "_commit", late)
    assert table.merge(spark.createDataFrame([(2, "second")], "id long, title string")) == 2
    assert rows(table.read().filter("id in (1, 2)").select("id", "title")) == [(1, "first"), (2, "second")]
    with pytest.raises(Conflict):
        KeyedTable.create(table.read(), ["id"], table.path)


def test_batches_count_once(spark, table):
    n = lambda: table.read().filter("id = 5").first()["title"]
    change = spark.createDataFrame([(5, "!")], "id long, title string")
    for _ in range(3):
        table.merge(change, {"title": F.concat("old.title", "new.title")}, batch="b1")
    assert n() == "t5!" and table.version() == 1
    table.merge(change, {"title": F.concat("old.title", "new.title")}, batch="b2")
    assert n() == "t5!!"


def test_empty(spark):
    none = KeyedTable.create(spark.createDataFrame([], "id long, v string"), ["id"])
    assert none.read().collect() == [] and none.merge(none.read()) == 0
    none.merge(spark.createDataFrame([(1, "a")], "id long, v string"))
    assert rows(none.read()) == [(1, "a")]
