"""The source tree as a batch and as a stream."""

import os

import pytest

from factloom.sources.tree import SourceTree, TreeStream


def plant(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "it's a tree"
    plant(root, a_DOT_js="a", src__b_DOT_py="b", src__deep__c_DOT_ts="c", src__d_DOT_d_DOT_ts="typing", node_modules__x_DOT_js="x", note_DOT_md="n")
    return root


def test_a_batch_reads_each_source_once(spark, tree):
    spark.dataSource.register(SourceTree)
    for parts in (1, 2, 64):
        rows = spark.read.format("source_tree").option("partitions", parts).load(str(tree)).collect()
        assert sorted((r["path"], r["op"], r["content"]) for r in rows) == [("a.js", "add", "a"), ("src/b.py", "add", "b"), ("src/deep/c.ts", "add", "c")]
        assert len({r["seq"] for r in rows}) == 3
    (tree / "none").mkdir()
    assert spark.read.format("source_tree").load(str(tree / "none")).count() == 0


def test_a_stream_tells_what_changes_between_batches(spark, tree, tmp_path):
    spark.dataSource.register(SourceTree)
    feed = spark.readStream.format("source_tree").option("listings", str(tmp_path / "listings")).option("buckets", 4).load(str(tree))

    def start():
        return feed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).start()

    def told():
        rows = spark.read.schema(feed.schema).parquet(str(tmp_path / "out")).orderBy("seq").collect() if os.path.exists(tmp_path / "out") else []
        return [(r["path"], r["op"], r["content"]) for r in rows]

    query = start()
    try:
        query.processAllAvailable()
        assert told() == []
        plant(tree, a_DOT_js="a, edited", src__new_DOT_ts="new", node_modules__y_DOT_js="y")
        (tree / "src/b.py").unlink()
        query.processAllAvailable()
        first = told()
        assert sorted(first) == [("a.js", "change", "a, edited"), ("src/b.py", "unlink", None), ("src/new.ts", "add", "new")]
    finally:
        query.stop()
    plant(tree, src__b_DOT_py="b again")
    query = start()
    try:
        query.processAllAvailable()
        assert told() == first + [("src/b.py", "add", "b again")]
    finally:
        query.stop()


def test_listings_stay_where_nothing_changes(tree, tmp_path):
    stream = TreeStream(str(tree), str(tmp_path / "listings"), 4, True)
    assert stream.initialOffset() == {"listing": 0} and stream.latestOffset() == stream.latestOffset() == {"listing": 1}
    before = len(os.listdir(tmp_path / "listings"))
    plant(tree, a_DOT_js="longer")
    assert stream.latestOffset() == {"listing": 2} and len(os.listdir(tmp_path / "listings")) == before + 2
    (part,) = stream.partitions({"listing": 1}, {"listing": 2})
    assert [x[2:] for x in stream.read(part)] == [x[2:] for x in stream.read(part)] == [("a.js", "change", "longer")]
    told = [x[2] for p in stream.partitions({"listing": 0}, {"listing": 2}) for x in stream.read(p)]
    assert sorted(told) == ["a.js", "src/b.py", "src/deep/c.ts"]
    stream.commit({"listing": 2})
    assert not os.path.exists(tmp_path / "listings/1.json") and stream.latestOffset() == {"listing": 2}
    assert sorted(x[2] for p in stream.partitions({"listing": 0}, {"listing": 2}) for x in stream.read(p)) == ["a.js", "src/b.py", "src/deep/c.ts"]
