"""Sources, sinks and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, html, sinks
from millrace.streaming import ingest


def test_walk(spark, tmp_path):
    for name, data in {"documents/a.pdf": b"x", "documents/sub/b.HTML": b"x", "documents/.hidden": b"y", "documents/c.txt": b"z"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    f, audit = files.walk(spark, str(tmp_path))
    got = {r.relative_path: (r.content_sha256, r.document_type) for r in f.collect()}
    assert set(got) == {"documents/a.pdf", "documents/sub/b.HTML"}
    assert got["documents/a.pdf"][0] == got["documents/sub/b.HTML"][0]
    assert {(r.relative_path, r.reason) for r in audit.collect()} >= {("documents/c.txt", "unsupported")}


def test_json_array_missing_is_empty(spark, tmp_path):
    assert files.json_array(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r.a for r in files.json_array(spark, str(tmp_path / "x.json"), "a int").orderBy("a").collect()] == [1, 2]


def test_json_lines_tail_is_quarantined_and_middle_fails(spark):
    good = spark.createDataFrame([(0, '{"a": 1}'), (1, " "), (2, '{"a": ')], "ord int, value string")
    rows, bad = files.json_lines(good, "a int")
    assert [tuple(r) for r in rows.collect()] == [(0, 1)] and [r.ord for r in bad.collect()] == [2]
    broken = spark.createDataFrame([(0, '{"a": '), (1, '{"a": 1}')], "ord int, value string")
    with pytest.raises(Exception, match="corrupt line 0"):
        files.json_lines(broken, "a int")[0].collect()


def test_html_blocks():
    page = """<html><head><title>T &amp; t</title><script>var p = '</p>';</script></head><body><nav><p>menu item that is long enough</p></nav>
    <p>outside of the article, long enough</p><article><h2>Head</h2><p>First paragraph, <b>bold</b> text here.</p><p>short.</p><ul><li>A list item of good length</ul></article></body></html>"""
    title, blocks = html.blocks(page)
    assert title == "T & t"
    assert blocks == [(0, "Head", "First paragraph, bold text here."), (1, "Head", "A list item of good length")]
    assert html.blocks(None) == ("", []) and html.blocks("") == ("", [])


def test_html_audit(spark):
    pages = spark.createDataFrame([(1, "<p>a paragraph of some length</p>"), (2, None)], "page_id long, html string")
    got = html.audit(pages, html.block_table(pages)).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, None), (2, 0, "empty")]


def test_idempotent_append_and_conflict(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert [tuple(r) for r in sinks.new_rows(old, new, "k").collect()] == [(2, "b")]
    with pytest.raises(Exception, match="conflicting row for key 1"):
        sinks.new_rows(old, spark.createDataFrame([(1, "z")], "k int, v string"), "k").collect()


def test_publish_writes_the_manifest_last(spark, tmp_path):
    p = str(tmp_path / "out")
    sinks.publish(spark, p, {"rows": 3}, nodes=spark.range(3))
    assert json.loads((tmp_path / "out/manifest.json").read_text()) == {"rows": 3, "tables": ["nodes"]}
    sinks.publish(spark, p, {"rows": 4}, nodes=spark.range(4))
    assert spark.read.parquet(p + "/nodes").count() == 4


def test_text_cells_and_blind(spark):
    d = spark.createDataFrame([(1, [1, 2])], "id int, a array<int>")
    assert sinks.text_cells(d).first().a == "[1,2]"
    sheet, key = sinks.blind(spark.createDataFrame([("b", 1), ("a", 2)], "name string, x int"), "name")
    assert sheet.columns == ["x", "blind_id"] and {(r.blind_id, r.name) for r in key.collect()} == {("R0001", "a"), ("R0002", "b")}


def test_stream_ingest_is_exactly_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id": 1, "v": "x"}\n{"id": 2, "v": null}\n')
    out, bad = str(tmp_path / "ok"), str(tmp_path / "bad")

    def go(checkpoint):
        ingest.ingest(spark, str(src), "id int, v string", out, bad, "id", str(tmp_path / checkpoint), ("missing", F.col("v").isNull())).awaitTermination(60)

    go("c1")
    (src / "b.json").write_text('{"id": 3, "v": "y"}\n{"id": 1, "v": "x"}\n')
    go("c1")
    go("c2")  # a lost checkpoint replays everything and appends nothing
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3]
    assert {r.reason for r in spark.read.parquet(bad).collect()} == {"missing"}


def test_event_windows(spark):
    d = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:01:00', 'a', 1.0D), (1, timestamp'2024-01-01 00:04:00', 'a', 2.0D), (1, timestamp'2024-01-01 01:00:00', 'a', 4.0D) AS t(user_id, ts, event_type, value)")
    assert sorted((r.n, r.total) for r in ingest.tumbling(d, "10 minutes").collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in ingest.sessions(d, "5 minutes").collect()) == [1, 2]
