"""What a task holds and computes does not grow with the table or the length of an expression."""

from types import SimpleNamespace

import pyarrow as pa
from eventboard.functions import dates as dt
from eventboard.operators import outline
from eventboard.operators import pages as pg
from eventboard.plans import tables
from eventboard.streaming import keyed
from pyspark.sql import functions as F


def _mentions(spark, make):
    df = spark.createDataFrame([("x",)], "marker string").select(make(F.col("marker")).alias("v"))
    return df._jdf.queryExecution().analyzed().toString().split("LocalRelation")[0].split("LogicalRDD")[0].count("marker#")


def test_a_date_reading_mentions_its_text_once(spark):
    assert _mentions(spark, dt.any_date) == 1
    assert _mentions(spark, dt.month_loose) == 1
    assert _mentions(spark, dt.iso_instant) == 1
    assert _mentions(spark, dt.rfc822) == 1
    assert _mentions(spark, pg.time_value) == 1


def test_no_cast_is_tried_that_must_fail(value):
    for text, number in (("12", 12), (" +7\t", 7), ("-3", -3), ("", None), ("Jan", None), ("1.5", None), ("99999999999", None), ("4\n", 4), ("٣", None)):
        assert value(lambda t=text: dt._int(F.lit(t))) == number == value(lambda t=text: F.lit(t).try_cast("int"))
    shown = str(dt._int(F.col("x")))
    assert "CASE WHEN" in shown.upper()


def test_rows_are_dealt_out_by_number(spark):
    narrow = spark.range(300_000, numPartitions=1)
    assert tables.spread(narrow).rdd.getNumPartitions() == 300_000 // tables.TASK_ROWS == 6
    assert tables.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(10, numPartitions=9)).rdd.getNumPartitions() == 9


def test_a_batch_of_pages_is_parsed_in_chunks(spark, monkeypatch):
    sizes = []

    def array(rows, kind=None):
        sizes.append(len(rows))
        return pa.array(rows, kind)

    udf = outline._outline_udf().func
    monkeypatch.setitem(udf.__globals__, "pa", SimpleNamespace(array=array, concat_arrays=pa.concat_arrays, Array=pa.Array))
    n = 3 * outline.CHUNK + 5
    bodies = [f"<p><a href='/{k}'>n{k}</a></p>" if k % 7 else None for k in range(n)]
    chosen = pa.array(['[{"tag": "a"}]'] * n)
    got = udf(pa.array(bodies), chosen, pa.nulls(n, pa.string()), pa.array([True] * n)).to_pylist()
    assert max(sizes) == outline.CHUNK and len(got) == n
    assert [g and g[0]["href"] for g in got] == [f"/{k}" if k % 7 else None for k in range(n)]
    assert udf(pa.array([], pa.string()), chosen[:0], chosen[:0], pa.array([], pa.bool_())).to_pylist() == []


def test_a_stream_asks_for_each_value_once_and_writes_only_changes():
    calls = []

    class Value:
        def __init__(self, name, held=None):
            self.name, self.held = name, held

        def __getattr__(self, kind):
            def call(*given):
                calls.append(f"{self.name}.{kind}")
                if kind == "update":
                    self.held = given[0]
                elif kind == "clear":
                    self.held = None
                return self.held is not None if kind == "exists" else self.held if kind == "get" else None

            return call

    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10)
    p = keyed.KeyedFreshness("long")
    p.handle = SimpleNamespace(registerTimer=lambda ms: None, deleteTimer=lambda ms: None)
    p.good, p.wake, p.waiting = Value("good", (1, "r")), Value("wake", (5,)), Value("waiting", [(2_000, 1, None, "row")])
    (out,) = p.handleExpiredTimer(("s", "t"), times, None)
    assert out[["row", "lkg", "late"]].values.tolist() == [["row", "r", False]]
    assert calls == ["waiting.get", "good.get", "wake.clear", "waiting.clear"]
    calls.clear()
    p.waiting.held = [(3_000, 1, "new", "row")]
    list(p.handleExpiredTimer(("s", "t"), times, None))
    assert p.good.held == (3_000, "new") and calls.count("good.get") == calls.count("good.update") == 1
    calls.clear()
    p.wake.held = (20,)
    p._wake_at(30_000)
    assert calls == ["wake.get"]
