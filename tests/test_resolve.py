from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventboard.operators import pick
from eventboard.operators import resolve as rs
from eventboard.operators.carry import with_slices
from eventboard.plans.tables import HISTORY_COLUMNS, run_log, table
from eventboard.schemas import KEY, LIVE, OBSERVATIONS, REGISTRY

T0 = datetime(2026, 2, 1)


def obs(run, source, ok, hours, **more):
    base = dict.fromkeys(
        "run_id source_id event_type title ok event_at source_url confidence notes http_status fetch_mode failure_type "
        "explanation fetched_at extras".split()
    )
    base.update(run_id=run, source_id=source, event_type="status", title=f"Title {source}", ok=ok, http_status=200,
                fetched_at=T0 + timedelta(hours=hours))
    base.update(dict(event_at=T0 + timedelta(days=hours), confidence="high", extras={"a": run}) if ok else
                dict(explanation=f"Crashed: {run}", failure_type="blocked", http_status=403))
    return base | more


def frame(spark, rows):
    return spark.createDataFrame(rows, OBSERVATIONS)


def test_history_sequence(spark):
    rows = [obs("r1", "s", False, 1), obs("r2", "s", True, 2), obs("r3", "s", False, 3), obs("r4", "s", True, 4), obs("r5", "s", False, 5)]
    out = rs.resolve_history(frame(spark, rows)).orderBy("fetched_at").collect()
    assert [r.status for r in out] == ["unavailable", "fresh", "stale", "fresh", "stale"]
    assert [r.last_success_at and r.last_success_at.hour for r in out] == [None, 2, 2, 4, 4]
    assert out[2].extras == {"a": "r2"} and out[2].reason == "Crashed: r3" and out[2].http_status == 200
    assert out[0].failure_type == "blocked" and out[0].event_at is None
    assert all(r.last_success_at < r.fetched_at for r in out if r.status == "stale")


def test_one_run(spark):
    registry = spark.createDataFrame([(s, "status", f"Name {s}", i) for i, s in enumerate("abcd")], REGISTRY)
    lkg = rs.fresh_records(frame(spark, [obs("r0", "b", True, 1), obs("r0", "d", True, 2)]))
    now = frame(spark, [obs("r1", "a", True, 9), obs("r1", "b", False, 9), obs("r1", "c", False, 9)])
    out = {r.source_id: r for r in rs.resolve(now, lkg, registry, "r1", T0 + timedelta(hours=9)).collect()}
    assert {k: r.status for k, r in out.items()} == {"a": "fresh", "b": "stale", "c": "unavailable", "d": "stale"}
    assert out["a"].title == "Title a" and out["b"].title == "Name b"
    assert out["b"].last_success_at == T0 + timedelta(hours=1) and out["b"].fetched_at == T0 + timedelta(hours=9)
    assert out["d"].reason == "Crashed: Provider returned invalid/empty result"
    assert out["d"].run_id == "r1" and out["d"].fetched_at == T0 + timedelta(hours=9)


def test_folding_single_runs_gives_the_history(spark):
    pattern = {"a": "1010011", "b": "0001000", "c": "0000000"}
    registry = spark.createDataFrame([(s, "status", f"Title {s}", i) for i, s in enumerate(pattern)], REGISTRY)
    rows = [obs(f"r{i}", s, bits[i] == "1", i) for s, bits in pattern.items() for i in range(7)]
    whole = rs.resolve_history(frame(spark, rows)).select("run_id", *KEY, "status", "event_at", "last_success_at", "reason")
    lkg, folded = spark.createDataFrame([], LIVE), []
    for i in range(7):
        live = rs.resolve(frame(spark, [r for r in rows if r["run_id"] == f"r{i}"]), lkg, registry).drop("ord")
        folded += live.select(*whole.columns).collect()
        lkg = spark.createDataFrame(rs.update_lkg(lkg, live).collect(), LIVE)
    assert sorted(map(tuple, folded), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert {r.status for r in lkg.collect()} == {"fresh"}
    latest = rs.resolve_latest(frame(spark, rows)).select(*whole.columns)
    assert sorted(map(tuple, latest.collect()), key=str) == sorted((tuple(r) for r in whole.collect() if r.run_id == "r6"), key=str)


def test_stale_never_moves_the_last_good_record(spark):
    first = rs.resolve_history(frame(spark, [obs("r1", "s", True, 1)]))
    later = rs.resolve_history(frame(spark, [obs("r2", "s", False, 2)]), lkg=first)
    assert later.first().status == "stale"
    kept = rs.update_lkg(first, later).collect()
    assert len(kept) == 1 and kept[0].run_id == "r1"


def test_late_rows_do_not_inherit_from_their_future(spark):
    seed = rs.resolve_history(frame(spark, [obs("r5", "s", True, 5)]))
    out = rs.resolve_history(frame(spark, [obs("r3", "s", False, 3), obs("r6", "s", False, 6)]), lkg=seed)
    assert {r.run_id: r.status for r in out.collect()} == {"r3": "unavailable", "r6": "stale"}


def by_window(log, tie, keep):
    """The same history by one plain window over each source."""
    line = W.partitionBy(*KEY).orderBy("fetched_at", tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    good = F.last(F.when(F.col("ok"), rs.good_record()), ignorenulls=True).over(line)
    return rs.settle(log.withColumn("lkg", good), keep)


@pytest.mark.parametrize("slices", [None, 1, 3, 60])
def test_history_in_slices_equals_the_plain_window(spark, sf_dir, slices):
    log = run_log(table(spark, sf_dir, "events"))
    plain = by_window(log, "event_id", ["event_id"]).select(*HISTORY_COLUMNS)
    sliced = rs.resolve_history(log, tie="event_id", keep=["event_id"], slices=slices).select(*HISTORY_COLUMNS)
    assert sliced.exceptAll(plain).count() == 0 and sliced.count() == plain.count()


def test_sources_without_a_name_have_a_history_too(spark):
    rows = [obs("r1", None, True, 1), *[obs(f"r{i}", None, False, i) for i in range(2, 40)]]
    out = rs.resolve_history(frame(spark, rows), slices=8).collect()
    assert Counter(r.status for r in out) == {"fresh": 1, "stale": 38}


def skewed(spark, n=6000):
    """Two thirds of the rows belong to one source, half of those to a single instant."""
    i = F.col("id")
    hot, same = i % 3 != 0, i % 3 == 1
    when = F.lit("2026-02-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.when(same, 777).otherwise(i))
    rows = spark.range(n).select(
        i.alias("seq"), F.lit("r").alias("run_id"), F.when(hot, "hot").otherwise(F.concat(F.lit("s"), i % 50)).alias("source_id"),
        F.lit("status").alias("event_type"), F.lit("t").alias("title"), (F.xxhash64("id") % 4 == 0).alias("ok"),
        when.alias("event_at"), F.lit("u").alias("source_url"), F.lit("high").alias("confidence"), i.cast("string").alias("notes"),
        F.lit(200).alias("http_status"), F.lit("http").alias("fetch_mode"), F.lit("blocked").alias("failure_type"),
        F.lit("e").alias("explanation"), when.alias("fetched_at"), F.lit(None).cast("map<string,string>").alias("extras"),
    )
    return rows


def in_slices(log, tie, keep):
    """Rows of the largest piece of a timeline, and differences to the plain window."""
    cut = with_slices(log, KEY, "fetched_at", tie, 20)
    largest = cut.groupBy(*KEY, "_slice").count().agg(F.max("count")).first()[0]
    want = by_window(log, tie, keep).drop("extras")
    got = rs.resolve_history(log, tie=tie, keep=keep, slices=20).drop("extras")
    return largest, got.exceptAll(want).count() + abs(got.count() - want.count())


def test_hot_source_and_hot_instant_are_split(spark):
    largest, differences = in_slices(skewed(spark), "seq", ["seq"])
    assert largest <= 2 * 300 and not differences


@pytest.mark.parametrize("digits", [4, 8])
def test_hot_instant_is_split_by_a_text_too(spark, digits):
    log = skewed(spark).withColumn("run_id", F.concat(F.lit("run-2026-"), F.lpad(F.col("seq").cast("string"), digits, "0")))
    largest, differences = in_slices(log, "run_id", ["seq"])
    assert largest <= 2 * 300 and not differences


def test_input_is_read_twice(spark, tmp_path):
    """Once to sample the ranges, once to deal the rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def told(ok):
        seen.add(1)
        return ok

    skewed(spark).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log")).withColumn("ok", told("ok"))
    rs.resolve_history(log, tie="seq", slices=6).write.format("noop").mode("overwrite").save()
    assert seen.value <= 2 * 6000


def test_every_run_has_every_source(spark):
    log = frame(spark, [obs("r1", "a", True, 1), obs("r1", "b", True, 1), obs("r2", "a", True, 2), obs("r3", "a", False, 3)])
    entries = [(s, "status", s.upper(), i) for i, s in enumerate("abc")]
    registry = spark.createDataFrame(entries, "source_id string, event_type string, name string, ord int")
    rows = rs.resolve_history(rs.every_run(registry, log)).collect()
    got = {(r.run_id, r.source_id): (r.status, r.reason, r.failure_type) for r in rows}
    silent = rs.CRASHED + rs.NO_RESULT
    assert len(rows) == 9 and got["r1", "a"][0] == got["r1", "b"][0] == got["r2", "a"][0] == "fresh"
    assert got["r3", "a"][0] == "stale" and got["r2", "b"] == got["r3", "b"] == ("stale", silent, "unavailable")
    assert all(got[r, "c"] == ("unavailable", None, "unavailable") for r in ("r1", "r2", "r3"))
    assert rs.every_run(registry, log.limit(0)).count() == 0


def test_health_gate(spark):
    def run(down, total):
        rows = [("unavailable" if i < down else "fresh",) for i in range(total)]
        return rs.health_gate(spark.createDataFrame(rows, "status string"), keys=[]).first().failed

    assert (run(6, 12), run(7, 12), run(0, 0)) == (False, True, False)


def test_picks(spark):
    rows = [(1, 0, 1, "a", 5), (1, 1, 1, "b", 9), (1, 2, 2, "c", 9), (1, 3, 1, "d", None)]
    cand = spark.createDataFrame(
        [(s, p, t, n, T0 + timedelta(days=d) if d else None) for s, p, t, n, d in rows],
        "snapshot_id int, pos int, tier int, title string, event_at timestamp_ntz",
    )
    assert pick.pick_latest(cand).first().title == "b"
    assert pick.pick_next(cand, T0 + timedelta(days=6)).first().title == "b"
    assert pick.pick_first_valid(cand).first().title == "a"
    assert pick.pick_match_or_first(cand, F.col("title") == "c").first().title == "c"
    assert pick.pick_match_or_first(cand, F.col("title") == "x").first().title == "a"
    counts = pick.relevant_count(cand, F.col("title").isin("c", "d")).first()
    assert (counts.relevant, counts.dated, counts.next_channel) == (2, 1, False)
