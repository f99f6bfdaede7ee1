"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline as pipeline
from presswork.llm import decontaminate, pii

from . import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        rows = [tuple(r) for r in out.collect()]
        docs = spark.createDataFrame(rows, out.schema)
        kept[name] = before, {r[0]: r for r in docs.collect()}
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = kept["near_duplicates"]
    comp = brute.components([(i, r["text"]) for i, r in before.items()], 5, 8, 10)
    assert set(after) == {i for i, (_, c) in comp.items() if i == c} and len(after) < len(before)
    before, after = kept["decontamination"]
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, r in before.items() if any(t in decontaminate.normal(r["text"]) for t in items)}
    assert held and not held & set(after) and len(before) - len(after) < len(held) + 5
    before, after = kept["private_data"]
    for i, r in before.items():
        for kind, start, end in pii.detect(r["text"]):
            assert r["text"][start:end] not in after[i]["text"], kind
    before, after = kept["mix"]
    assert all(1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * len(brute.words(r["text"])) for r in after.values())
    before, after = kept["toxicity"]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert len(toxic - set(after)) > 0.7 * len(toxic) and len(clean & set(after)) > 0.95 * len(clean)


CLASHING = ("copies", "taken", "source_target", "_copies", "_id", "_near_id", "_near_key", "_near_gone", "_near_rows", "point", "text_key", "size", "target", "score", "neighbours", "entities", "edge_of", "of")


def test_odd(spark):
    more = ("x",) * len(CLASHING)
    rows = [(i, t, "en", "s", 1, *more) for i, t in enumerate(brute.ODD)] + [(None, "a b c", None, None, None, *more)]
    rows += [(3, "a second text of an id that is there", "en", "s", 1, *more), (3, "a second text of an id that is there", "en", "s", 1, *more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    for table in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.columns[: len(docs.columns)] == docs.columns
            got = out.collect()
            assert len(got) <= table.count() and all(r[c] == "x" for r in got for c in CLASHING)
            if name == "near_duplicates" and got:
                assert sorted(r["text"] for r in got if r["doc_id"] == 3) == ["a", "a second text of an id that is there"]
            if name == "mix" and got:
                assert out.columns[len(docs.columns) :] == ["__copies", "_taken", "_source_target"]
