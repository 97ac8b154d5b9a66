from pyspark.sql import functions as F

from eventboard.operators import resolve as rs
from eventboard.plans.streamqueries import late_event_stream
from eventboard.plans.tables import HISTORY_COLUMNS, run_log, table
from eventboard.sources.results import read_records
from eventboard.streaming import keyed
from eventboard.streaming.freshness import lkg_stream, resolve_stream, write_lkg_stream


def parts(spark, sf_dir, tmp_path):
    """The event table as three files in time order, and a stream that reads one file per batch."""
    events = table(spark, sf_dir, "events")
    folder = str(tmp_path / "events")
    for i, (low, high) in enumerate([("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-03-01")]):
        one = events.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1)
        one.write.mode("append").parquet(folder)
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_history_equals_the_batch(spark, sf_dir, tmp_path):
    events, stream = parts(spark, sf_dir, tmp_path)
    out = str(tmp_path / "out")

    def run():
        query = resolve_stream(run_log(stream), f"{out}/history", f"{out}/lkg", f"{out}/checkpoint", "event_id", ["event_id"])
        query.awaitTermination()

    run()
    want = rs.resolve_history(run_log(events), tie="event_id", keep=["event_id"]).select(*HISTORY_COLUMNS)
    got = spark.read.parquet(f"{out}/history").select("batch", *HISTORY_COLUMNS)
    assert got.select("batch").distinct().count() == 3
    assert got.drop("batch").exceptAll(want).count() == 0 and got.count() == want.count()
    run()
    assert spark.read.parquet(f"{out}/history").count() == want.count()


def test_streamed_lkg_equals_the_batch(spark, sf_dir, tmp_path):
    events, stream = parts(spark, sf_dir, tmp_path)
    out = str(tmp_path / "out")
    write_lkg_stream(lkg_stream(run_log(stream)), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    want = rs.newest_per_key(rs.fresh_records(run_log(events))).drop("extras")
    got = read_records(spark, f"{out}/table").drop("bucket", "extras")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def keyed_batches(spark, sf_dir, tmp_path, delay=None, seed=None):
    """The late stream written by the keyed operator: its rows, the query and the events."""
    out = str(tmp_path / "keyed")
    log, covers = late_event_stream(spark, sf_dir, f"{out}/events")
    live = keyed.resolved(log, delay or covers, "event_id", ["event_id"], seed)

    def run():
        query = keyed.write_stream(live, f"{out}/history", f"{out}/checkpoint")
        query.awaitTermination()
        return query

    return run(), run, lambda: spark.read.parquet(f"{out}/history").select(*HISTORY_COLUMNS)


def test_late_rows_of_five_batches_equal_the_history(spark, sf_dir, tmp_path):
    query, again, history = keyed_batches(spark, sf_dir, tmp_path)
    assert len([p for p in query.recentProgress if p["numInputRows"] > 1]) >= 5
    want = rs.resolve_history(run_log(table(spark, sf_dir, "events")), tie="event_id", keep=["event_id"]).select(*HISTORY_COLUMNS)
    assert history().exceptAll(want).count() == 0 and history().count() == want.count()
    # A batch writes state for the sources it has rows of: a few records each.
    for p in query.recentProgress:
        assert all(o["numRowsUpdated"] <= 4 * p["numInputRows"] + 3 * 300 for o in p["stateOperators"])
    again()
    assert history().count() == want.count()


def test_rows_behind_the_watermark_are_marked(spark, sf_dir, tmp_path):
    keyed_batches(spark, sf_dir, tmp_path, delay="1 hour")
    rows = spark.read.parquet(str(tmp_path / "keyed" / "history")).cache()
    assert rows.count() == table(spark, sf_dir, "events").count() and 0 < rows.filter("late").count() < rows.count() / 4
    # No row inherits from its future, whoever was late.
    assert rows.filter("last_success_at > fetched_at").count() == 0


def test_closed_runs_leave_late_rows_to_be_counted_apart(spark, sf_dir, tmp_path):
    _, _, _ = keyed_batches(spark, sf_dir, tmp_path, delay="1 hour")
    history = spark.read.parquet(str(tmp_path / "keyed" / "history"))
    out = str(tmp_path / "health")
    log, _ = late_event_stream(spark, sf_dir, f"{out}/events")
    health = keyed.health_stream(keyed.resolved(log, "1 hour", "event_id"), "1 day")
    keyed.write_stream(health, f"{out}/health", f"{out}/checkpoint").awaitTermination()
    told = {r.run_id: r.total for r in spark.read.parquet(f"{out}/health").collect()}
    late = {r.run_id: r.total for r in rs.run_summary(history.filter("late")).collect()}
    events = {r.run_id: r.total for r in rs.run_summary(rs.resolve_history(run_log(table(spark, sf_dir, "events")), tie="event_id")).collect()}
    assert late and {r: told.get(r, 0) + late.get(r, 0) for r in events} == events


def test_keyed_stream_starts_from_a_table(spark, sf_dir, tmp_path):
    log = run_log(table(spark, sf_dir, "events"))
    source = log.filter("NOT ok").orderBy("fetched_at", "event_id").first()
    early = log.filter(F.col("ok")).limit(1).select(*[
        F.lit(source[c]).alias(c) if c in ("source_id", "event_type") else F.lit("2020-01-01").cast("timestamp_ntz").alias(c) if c == "fetched_at"
        else F.col(c) for c in log.columns
    ])
    seed = rs.resolve_history(early, tie="event_id")
    _, _, history = keyed_batches(spark, sf_dir, tmp_path, seed=seed)
    want = rs.resolve_history(log, seed, tie="event_id", keep=["event_id"]).select(*HISTORY_COLUMNS)
    assert history().exceptAll(want).count() == 0 and history().count() == want.count()
    assert history().filter(F.col("event_id") == source.event_id).first().status == "stale"
