from datetime import datetime

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventboard.functions import boardtext as bt
from eventboard.operators import board as bd
from eventboard.operators import resolve as rs
from eventboard.operators.board import board, board_many
from eventboard.plans.tables import run_log, table
from eventboard.schemas import LIVE, REGISTRY

NOW = "2026-02-04 21:00:00"


@pytest.mark.parametrize(
    ("ms", "long", "card"),
    [
        (223_402_000, "02d 14h 03m 22s", "2d 14h"),
        (-223_402_000, "02d 14h 03m 22s", "2d 14h"),
        (0, "00s", "00m"),
        (86_400_000, "01d 00h 00m 00s", "1d 00h"),
        (3_780_000, "01h 03m 00s", "01h 03m"),
        (123 * 86_400_000, "123d 00h 00m 00s", "123d 00h"),
    ],
)
def test_durations(value, ms, long, card):
    assert value(lambda: bt.duration_long(F.lit(ms))) == long
    assert value(lambda: bt.duration_card(F.lit(ms))) == card


@pytest.mark.parametrize(
    ("ts", "expected"),
    [
        ("2026-02-03 20:00:00", "1 day ago"), ("2026-02-04 19:00:00", "2 hours ago"),
        ("2026-02-04 20:59:00", "1 minute ago"), ("2026-02-04 20:59:30", "just now"),
    ],
)
def test_age(value, ts, expected):
    assert value(lambda: bt.age_text(F.lit(ts).cast("timestamp_ntz"), NOW)) == expected


def live_row(source, kind, status, event_at, **more):
    base = dict.fromkeys(
        "run_id source_id event_type title status event_at source_url confidence notes http_status fetch_mode "
        "failure_type explanation fetched_at last_success_at reason extras".split()
    )
    base.update(source_id=source, event_type=kind, title=f"T {source}", status=status, confidence="high",
                event_at=datetime.fromisoformat(event_at) if event_at else None,
                fetched_at=datetime(2026, 2, 4, 19, 0))
    return base | more


@pytest.fixture(scope="module")
def cards(spark):
    open_season = {"nextSeasonStart": None, "nextSeasonEstimateFriendly": "March 6, 2026", "sourceName": "Label"}
    rows = [
        live_row("a", "next-patch", "stale", "2026-02-07 11:03:22", reason="Crashed: HTTP 503"),
        live_row("b", "last-patch", "stale", "2026-02-01", notes="n"),
        live_row("c", "next-patch", "fresh", "2026-02-01"),
        live_row("d", "status", "unavailable", None, confidence=None, explanation="Crashed: x"),
        live_row("e", "status", "fresh", "2026-02-01", confidence="none"),
        live_row("fortnite", "next-season", "fresh", "2026-03-05", extras=open_season, notes="more"),
    ]
    registry = [(r["source_id"], r["event_type"], r["source_id"].upper(), i) for i, r in enumerate(rows)]
    registry.append(("z", "status", "Z", 9))
    out = board(spark.createDataFrame(registry, REGISTRY), spark.createDataFrame(rows, LIVE), NOW)
    return {r.source_id: r for r in out.collect()}


def test_badges(cards):
    assert {k: r.badge for k, r in cards.items()} == {
        "a": "STALE", "b": "LIVE", "c": "LIVE", "d": "UNAVAILABLE", "e": "UNAVAILABLE", "fortnite": "LIVE", "z": "UNAVAILABLE",
    }


def test_countdowns(cards):
    assert cards["a"].countdown_text == "2d 14h"
    assert cards["b"].countdown_text == "3d 21h"
    assert cards["c"].countdown_text == "Updating..."
    assert cards["z"].countdown_text == "Data unavailable"
    assert (cards["c"].page_label, cards["c"].page_value) == ("Status", "Updating...")
    assert cards["b"].page_label == "Time Since Event"


def test_notes_and_checked(cards):
    assert cards["a"].page_notes == "⚠ Using cached data: Crashed: HTTP 503"
    assert cards["b"].page_notes == "⚠ Using cached data"
    assert cards["d"].page_notes == "Crashed: x"
    assert cards["fortnite"].page_notes == "Next season: Not officially announced (Likely March 6, 2026)\nmore"
    assert cards["fortnite"].source_label == "Label"
    assert cards["a"].checked_text == "Checked 2 hours ago"
    assert (cards["z"].checked_text, cards["z"].page_checked) == ("--", "Never")


def test_board_many_skips_blank_events(spark):
    rows = [live_row("a", "next-patch", "fresh", "2026-02-07"), live_row("d", "status", "unavailable", None)]
    out = board_many(spark.createDataFrame(rows, LIVE), [NOW, "2026-02-08"]).orderBy("as_of").collect()
    assert [r.countdown_text for r in out] == ["2d 03h", "Updating..."]


def test_card_text_is_never_empty(spark):
    df = spark.range(-3000, 3000).select(bt.duration_card(F.col("id") * 987_654).alias("t"))
    assert df.filter(F.col("t").isNull() | (F.length("t") < 3)).count() == 0


def test_board_at_equals_the_range_condition(spark, sf_dir):
    log = run_log(table(spark, sf_dir, "events"))
    live = rs.resolve_history(log, tie="event_id", keep=["event_id"]).cache()
    instants = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2023-12-30', TIMESTAMP_NTZ'2024-03-02', INTERVAL 7 HOURS)) AS as_of")
    line = W.partitionBy("source_id", "event_type").orderBy("fetched_at", "event_id")
    spans = live.withColumn("until", F.lead("fetched_at").over(line))
    inside = (F.col("as_of") >= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("as_of") < F.col("until")))
    want = spans.crossJoin(instants).filter(inside).select("event_id", "as_of")
    for width in (3_600, 86_400, 10_000_000):
        got = bd.board_at(live, instants, "event_id", width)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        got = got.select("event_id", "as_of")
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert bd.board_at(live, instants.limit(0), "event_id").count() == 0
