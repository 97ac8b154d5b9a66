import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventboard.operators import resolve as rs
from eventboard.schemas import SNAPSHOTS
from eventboard.sources import feeds, results, snapshots, versions
from eventboard.sources.documents import write_documents
from test_resolve import frame, obs


def test_json_round_trip(spark, tmp_path):
    extras = {"nextSeasonStart": None, "sourceName": "Label"}
    rows = [obs("r1", "a", True, 1, extras=extras, notes=None), obs("r1", "b", True, 1), obs("r2", "b", False, 2), obs("r2", "c", False, 2)]
    live = rs.resolve_history(frame(spark, rows))
    text = {(r.path, json.loads(r.json)["status"]): json.loads(r.json) for r in results.to_result_json(live).collect()}
    fresh, stale, down = text["a.status.json", "fresh"], text["b.status.json", "stale"], text["c.status.json", "unavailable"]
    assert "notes" not in fresh and fresh["nextSeasonStart"] is None and fresh["nextEventUtc"] == "2026-02-02T00:00:00.000Z"
    assert stale["reason"] == "Crashed: r2" and stale["last_success_at_utc"] < stale["fetched_at_utc"]
    assert down["nextEventUtc"] is None and down["failure_type"] == "blocked" and "confidence" not in down
    results.write_json(live, str(tmp_path / "out"))
    written = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted((d.pop("path"), d["status"]) for d in written) == sorted(text)
    assert all(d in text.values() for d in written)
    back = results.normalize_results(results.read_results(spark, str(tmp_path / "out"), lines=True))
    shared = ["source_id", "event_type", "title", "status", "event_at", "fetched_at", "last_success_at", "reason", "notes"]
    assert back.select(shared).exceptAll(live.select(shared)).count() == 0 and back.count() == 4


def test_unreadable_and_missing_records_leave_no_row(spark, tmp_path):
    assert results.read_results(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "a.json").write_text('{\n "game": "g",\n "type": "t",\n "status": "fresh"\n}')
    (tmp_path / "b.json").write_text('{"game": "g", "type"')
    (tmp_path / "c.json").write_text('{"game": "g"}')
    assert [r.game for r in results.read_results(spark, str(tmp_path)).collect()] == ["g"]


def test_live_table_keeps_one_record_per_key(spark, tmp_path):
    path, lkg = str(tmp_path / "live"), str(tmp_path / "lkg")
    first = rs.resolve_history(frame(spark, [obs("r1", s, True, 1) for s in "abcdef"]))
    results.write_live(first, path, buckets=3)
    results.write_lkg(first, lkg, buckets=3)
    second = rs.resolve_history(frame(spark, [obs("r2", "a", False, 2), obs("r2", "b", True, 2), obs("r2", "g", True, 2)]), lkg=first)
    results.write_live(second, path, buckets=3)
    results.write_lkg(second, lkg, buckets=3)
    live = {r.source_id: (r.run_id, r.status) for r in results.read_records(spark, path).collect()}
    good = {r.source_id: r.run_id for r in results.read_records(spark, lkg).collect()}
    assert live == {"a": ("r2", "stale"), "b": ("r2", "fresh"), "g": ("r2", "fresh"), **{s: ("r1", "fresh") for s in "cdef"}}
    assert good == {"a": "r1", "b": "r2", "g": "r2", **dict.fromkeys("cdef", "r1")}


def test_older_records_do_not_replace_newer_ones(spark, tmp_path):
    path = str(tmp_path / "lkg")
    older = rs.resolve_history(frame(spark, [obs("r1", s, True, 1) for s in "ab"]))
    newer = rs.resolve_history(frame(spark, [obs("r2", "a", True, 2)]))
    for live in (newer, older, older):
        results.write_lkg(live, path)
    assert sorted((r.source_id, r.run_id) for r in results.read_records(spark, path).collect()) == [("a", "r2"), ("b", "r1")]


def test_number_of_buckets_belongs_to_the_table(spark, tmp_path):
    path = str(tmp_path / "live")
    live = rs.resolve_history(frame(spark, [obs("r1", s, True, 1) for s in "ab"]))
    results.write_live(live, path, buckets=3)
    with pytest.raises(ValueError, match="3 buckets"):
        results.write_live(live, path, buckets=5)
    results.write_live(live, path)
    assert results.read_records(spark, path).count() == 2


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "live")
    first = rs.resolve_history(frame(spark, [obs("r1", s, True, 1) for s in "abcd"]))
    results.write_live(first, path, buckets=2)

    def killed(*_):
        raise RuntimeError("killed after the files, before the manifest")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "publish", killed)
        with pytest.raises(RuntimeError):
            results.write_live(rs.resolve_history(frame(spark, [obs("r2", "a", True, 2)])), path)
    assert {(r.source_id, r.run_id) for r in results.read_records(spark, path).collect()} == {(s, "r1") for s in "abcd"}
    results.write_live(rs.resolve_history(frame(spark, [obs("r3", "b", True, 3)])), path)
    assert {(r.source_id, r.run_id) for r in results.read_records(spark, path).collect()} == {("a", "r1"), ("b", "r3"), ("c", "r1"), ("d", "r1")}


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "live")
    runs = [rs.resolve_history(frame(spark, [obs(f"r{i}", "a", True, i)])) for i in range(1, 5)]
    results.write_live(runs[0], path)
    early = results.read_records(spark, path)
    for live in runs[1:]:
        results.write_live(live, path)
    assert early.first().run_id == "r1" and results.read_records(spark, path).first().run_id == "r4"
    assert versions.versions(spark, path) == [1, 2, 3, 4] and results.read_records(spark, path, 3).first().run_id == "r3"
    assert versions.expire(spark, path, keep=2) == 2 and versions.versions(spark, path) == [3, 4]
    assert results.read_records(spark, path).first().run_id == "r4" and results.read_records(spark, path, 3).first().run_id == "r3"


def test_second_writer_starts_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "live")
    a, b = (rs.resolve_history(frame(spark, [obs("r1", s, True, 1)])) for s in "ab")
    write, raced = versions.write, []

    def slow(df, *rest):
        if not raced:
            raced.append(1)
            results.write_live(b, path, buckets=1)
        return write(df, *rest)

    monkeypatch.setattr(versions, "write", slow)
    results.write_live(a, path, buckets=1)
    assert {r.source_id for r in results.read_records(spark, path).collect()} == {"a", "b"}


def test_documents_are_written_whole_or_not_at_all(spark, tmp_path):
    path = tmp_path / "documents"
    rows = spark.createDataFrame([(f"g{i}.status.json", f'{{"status":"fresh","game":"g{i}"}}') for i in range(20)], "path string, json string").repartition(4)
    write_documents(rows, str(path))

    def names():
        return sorted(p.name for p in path.rglob("*.json"))

    assert names() == sorted(f"g{i}.status.json" for i in range(20)) and results.read_results(spark, str(path), nested=True).count() == 20

    @F.udf("string")
    def broken(text):
        if "g7" in text:
            raise ValueError("no document")
        return text

    before = names()
    with pytest.raises(Exception, match="no document"):
        write_documents(rows.withColumn("json", broken("json")), str(path))
    for _ in range(100):  # tasks that still ran when the job failed take their own files away
        if names() == before:
            break
        time.sleep(0.1)
    assert names() == before and results.read_results(spark, str(path), nested=True).count() == 20
    write_documents(rows.filter("path < 'g1'").limit(3), str(path))
    assert len(names()) == rows.filter("path < 'g1'").limit(3).count()
    write_documents(rows.limit(0), str(path))
    assert names() == [] and not [p for p in path.iterdir() if p.name.startswith("_")]


def test_history_is_replaced_by_run(spark, tmp_path):
    path = str(tmp_path / "history")
    live = rs.resolve_history(frame(spark, [obs("r1", "a", True, 1), obs("r2", "a", True, 2)]))
    results.write_history(live, path)
    results.write_history(live.filter("run_id = 'r2'"), path)
    assert spark.read.parquet(path).count() == 2


def test_feed_files_and_columns(spark, tmp_path):
    xml = ("<rss><channel><item><title>Update</title><pubDate>Thu, 29 Jan 2026 22:00:00 +0000</pubDate><link>u</link></item>"
           "<item><title>Old</title><pubDate>bad</pubDate></item></channel></rss>")
    (tmp_path / "feed.xml").write_text(xml)
    rows = feeds.read_feed(spark, str(tmp_path / "feed.xml")).collect()
    assert [(r.title, r.event_at) for r in rows] == [("Update", datetime(2026, 1, 29, 22)), ("Old", None)]
    df = spark.createDataFrame([(1, xml), (2, "not xml"), (3, None)], "snapshot_id long, doc string")
    assert [(r.snapshot_id, r.pos, r.link) for r in feeds.feed_items(df, "doc").orderBy("pos").collect()] == [(1, 0, "u"), (1, 1, None)]


def test_status_documents(spark):
    docs = ['{"result":{"status_overall":{"updated":1700000000}}}', '{"result":{"status_overall":{"status":"Up","updated":"x"}}}', "[", "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "snapshot_id long, doc string")
    rows = feeds.status_docs(df, "doc").orderBy("snapshot_id").collect()
    assert [r.status_word for r in rows] == ["unknown", "Up", "unknown", "unknown"]
    assert [r.event_at for r in rows] == [datetime(2023, 11, 14, 22, 13, 20), None, None, None]


def test_snapshots_and_quarantine(spark, tmp_path):
    at = datetime(2026, 2, 4, 21, 35, 6, 572000)
    rows = [(1, "r", "s", "u", None, at, 403, "browser", None, "x" * 60000), (2, "r", "s", "u", None, at, 200, "http", None, "ok")]
    spark.createDataFrame(rows, SNAPSHOTS).write.parquet(str(tmp_path / "snaps"))
    snaps = snapshots.read_snapshots(spark, str(tmp_path / "snaps"))
    for kept, size in ((None, 60000), (51200, 51200)):
        out = snapshots.quarantine(snaps, kept).collect()
        assert [(r.snapshot_id, r.name, len(r.body)) for r in out] == [(1, "s.2026-02-04T21-35-06-572Z.html", size)]
    stream = snapshots.stream_snapshots(spark, str(tmp_path / "snaps"))
    assert stream.isStreaming and len(stream.columns) == 10
