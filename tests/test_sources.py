"""Readers of small text formats, and the literal cases of JSON repair."""

import json

import pytest
from pyspark.sql import functions as F

from presswork.functions import bias_json
from presswork.sources import readers


def put(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder}/{name}"


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers(spark, tmp_path):
    assert got(readers.feeds(spark, put(tmp_path, "feeds", "# c\n\na\tu1\nb\tu2\na\tu3\tx\n"))) == [("a", "u3\tx"), ("b", "u2")]
    with pytest.raises(Exception, match="no tab"):
        readers.feeds(spark, put(tmp_path, "bad", "a u\n")).collect()
    assert got(readers.id_list(spark, put(tmp_path, "ids", "#x\n 1 \n\n2\n"))) == [("1",), ("2",)]
    assert got(readers.found_ids(spark, put(tmp_path, "out", f"id: {'a' * 24}\nID: zz\n"))) == [("a" * 24,)]
    assert got(readers.titles(spark, put(tmp_path, "t", '1\t"A\n2\n3\t \n'))) == [("1", '"A')]
    assert got(readers.titles(spark, put(tmp_path, "th", "title\tarticle_id\nA\t1\n"), header=True)) == [("1", "A")]
    with pytest.raises(ValueError, match="title"):
        readers.titles(spark, put(tmp_path, "tb", "article_id\tx\n1\t2\n"), header=True)
    assert got(readers.relations(spark, put(tmp_path, "r", 'x ("a","b","c","d, e"), ("f" , "g","h","") ("i","j")'))) == [("a", "b", "c", "d, e"), ("f", "g", "h", "")]
    assert got(readers.prompts(spark, put(tmp_path, "p", "1\tm\tp\tq\nbad\n"))) == [("1", "m", "p\tq")]
    assert got(readers.jsonl(spark, put(tmp_path, "j", '{"id":"1","text":"t"}\n{"id":"2"}\n'))) == [("1", "t")]
    assert got(readers.categories(spark, put(tmp_path, "c", '{"categories":[{"category_id":1,"category_name":"n",\n"articles":[{"article_id":"7","title":"t"}]}]}'))) == [(1, "n", "7", "t")]
    (tmp_path / "d" / "e").mkdir(parents=True)
    put(tmp_path / "d" / "e", "x.md", "one\ntwo")
    put(tmp_path / "d", "y.bin", "no")
    assert [r["text"] for r in readers.text_folder(spark, f"file://{tmp_path}/d").collect()] == ["one\ntwo"]


#: A record that is whole, and what each rule has to mend: (broken text, key, value).
WHOLE = '{"dir":{"L":0.125,"C":0.5,"R":0.375},"deg":{"L":0.75,"M":0.125,"H":0.125},"reason":"both sides speak"}'
CASES = (
    (WHOLE, "reason", "both sides speak"),
    (WHOLE[1:-1], "deg", {"L": 0.75, "M": 0.125, "H": 0.125}),  # no outer braces
    (WHOLE.replace('"dir":{', '"dir":').replace('},"deg":{', ',"deg":').replace('},"reason"', ',"reason"'), "dir", {"L": 0.125, "C": 0.5, "R": 0.375}),  # no inner ones
    (WHOLE.replace('{"dir"', '{dir"'), "dir", {"L": 0.125, "C": 0.5, "R": 0.375}),  # a key that lost its first quote
    (WHOLE.replace("0.375}", "0.375 , }").replace("0.125}", "0.125,}"), "deg", {"L": 0.75, "M": 0.125, "H": 0.125}),  # commas before braces
    (WHOLE[: WHOLE.index(" speak")], "reason", "both sides"),  # broken off in a string
    ('dir":"L":0.125,"C":0.5,"R":0.375,"deg":"L":0.75,"M":0.125,"H":0.125,"reason":"both', "deg", {"L": 0.75, "M": 0.125, "H": 0.125}),  # all of it
)


def test_repair(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, *_) in enumerate(CASES)] + [(90, ""), (91, None)], "i int, raw string")
    out = {r["i"]: r["x"] for r in rows.select("i", bias_json.repair_json(F.col("raw")).alias("x")).collect()}
    for i, (_, key, value) in enumerate(CASES):
        assert json.loads(out[i])[key] == value
    assert out[90] is None and out[91] is None
