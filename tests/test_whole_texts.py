"""Queries over whole texts: nothing is lost after a prefix."""

from presswork.plans import registry


def test_whole_texts(spark, tmp_path):
    a, b = "x" * 600 + "\t,<a>", "x" * 600 + "\n,<b>"
    spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, a), (2, b)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([("user", a), ("user", b), ("user", b)], "role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {name: sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()) for name in ("F14_flat_texts", "F15_graph_ids", "F17_escaped_pages", "U5_unique_texts", "U6_text_tags")}
    x = "x" * 600
    assert got["F14_flat_texts"] == [(1, x + " ,<a>"), (2, x + " ,<b>")]
    assert got["F15_graph_ids"] == [(x + "___a_",), (x + "___b_",)]
    assert got["F17_escaped_pages"] == [(1, x + "\t,&lt;a&gt;"), (2, x + "\n,&lt;b&gt;")]
    assert got["U5_unique_texts"] == sorted([("user", a), ("user", b)])
    assert got["U6_text_tags"] == [(1, ["<a>", x + "\t"]), (2, ["<b>", x + "\n"])]
