"""The feed source, read at once and as a stream that is stopped and taken up."""

import pytest
from presswork.sources.feed_source import FeedSource
from presswork.streaming.state import run_available


def feed(path, items):
    body = "".join(f"<item><title>{t}</title><link>http://x/{t}</link><pubDate>{d}</pubDate></item>" for t, d in items)
    path.write_text(f"<rss><channel><title>feed</title>{body}</channel></rss>")


@pytest.fixture
def feeds(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    feed(tmp_path / "a.xml", [("a2", "Mon, 06 May 2024 10:00:00 GMT"), ("a1", "some day")])
    feed(tmp_path / "b.xml", [("b1", "2024-05-06T07:08:09Z")])
    (tmp_path / "bad.xml").write_text("<rss><item>")
    (tmp_path / "list").write_text(f"# feeds\n\na\tfile://{tmp_path}/a.xml\nb\t{tmp_path}/b.xml\nbad\t{tmp_path}/bad.xml\ngone\t{tmp_path}/gone.xml\n")
    return tmp_path


def test_read(spark, feeds):
    df = spark.read.format("presswork_feeds").option("feeds", f"{feeds}/list").load()
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert [(r["source"], r["link"]) for r in rows if not r["error"]] == [("a", "http://x/a1"), ("a", "http://x/a2"), ("b", "http://x/b1")]
    assert [r["published"] is None for r in rows if not r["error"]] == [True, False, False]
    assert [r["title"] for r in rows if not r["error"]] == ["a1", "a2", "b1"] and {r["source"] for r in rows if r["error"]} == {"bad", "gone"}
    assert df.selectExpr("source", "title", "date_format(published, 'yyyy-MM-dd HH:mm:ss') as at").filter("title = 'a2'").first()["at"] == "2024-05-06 10:00:00"
    with pytest.raises(Exception, match="list of feeds"):
        spark.read.format("presswork_feeds").load().collect()


def test_stream_takes_up_where_it_ended(spark, feeds):
    def run():
        stream = spark.readStream.format("presswork_feeds").option("feeds", f"{feeds}/list").load()
        return sorted(r["title"] for r in run_available(stream, "append", f"{feeds}/state").rows.collect())

    assert run() == ["a1", "a2", "b1"]
    assert run() == []
    feed(feeds / "a.xml", [("a3", ""), ("a2", ""), ("a1", "")])
    feed(feeds / "bad.xml", [("now good", "")])
    assert run() == ["a3", "now good"]
