"""The twelve rule sets on invented pages, their failure paths, and a new source without code."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventboard.plans import observe as observing
from eventboard.plans.observe import Kinds, observe
from eventboard.plans.rules import FAILURES, NO_LINK, SOURCES, URLS, register, registry, rule, rules_table
from eventboard.schemas import SNAPSHOTS

NOW = datetime(2026, 2, 4, 21, 0)
MINECRAFT, GENSHIN, PUBG = "https://feedback.minecraft.net/hc/articles/1", "https://genshin.hoyoverse.com/en/news/9", "https://pubg.com/en/news/9690"
RDR, EA = "red-dead-redemption-2", "ea-sports-fc"


def snapshots(spark, *pages):
    """Pages as (source, url, body, mode, status)."""
    rows = []
    for i, page in enumerate(pages):
        source, url, body, mode, status = (*page, *["http", 200][len(page) - 3 :])
        rows.append((i, "r1", source, url, None, NOW, status, mode, None, body))
    return spark.createDataFrame(rows, SNAPSHOTS)


def run(spark, *pages, rules=None):
    out = observe(snapshots(spark, *pages), rules if rules is not None else rules_table(spark)).collect()
    return {r.source_id: r for r in out}


@pytest.fixture(scope="module")
def good(spark):
    return run(
        spark,
        ("fortnite", URLS["fortnite"], "<html><p>Season <b>Ends on March 5, 2026</b> ET</p></html>"),
        ("lol", URLS["lol"], "<table><tr><td>26.2</td><td>Wednesday, Jan 21, 2026</td></tr><tr><td>26.4</td><td>Feb 19, 2026</td></tr>"
         "<tr><td>26.3</td><td>Feb 4, 2026</td></tr></table>"),
        ("valorant", URLS["valorant"], "<article><h2>P1</h2>January 20, 2026</article><article><time datetime='2026-02-03T14:00:00.000Z'>"
         "x</time><h3> P2 </h3></article>"),
        ("cs2", URLS["cs2"], "<p>Release Notes January 29, 2026</p>", "browser"),
        ("cs2", URLS["cs2-feed"], "<rss><channel><item><title>Update</title><pubDate>Thu, 1 Jan 2026 22:00:00 +0000</pubDate></item><item/></channel></rss>"),
        ("minecraft", URLS["minecraft"], "<li class='blocks-item'><a href='#x'>Changelog</a></li><li class='blocks-item'><a href='/hc/articles/1'>"
         "Minecraft 1.21.4</a></li>"),
        ("minecraft", MINECRAFT, "<h1>Minecraft 1.21.4</h1><time datetime='2026-01-20T10:00:00Z'>x</time>"),
        ("roblox", URLS["roblox"], '{"result":{"status_overall":{"status":"Operational","updated":"2026-01-31T21:55:58.697Z"}}}'),
        ("warzone", URLS["warzone"], "<div class='card'>Mobile 1/9/2026</div><a href='/x'><h3>Warzone notes</h3> 1/7/2026</a>"),
        ("genshin", URLS["genshin"], "<ul class='news-list'><li>Hello</li><li><h3>Event Wish</h3><a href='/en/news/9'>more</a></li></ul>"),
        ("genshin", GENSHIN, "<main>from 2026/01/01 10:00:00, Event End Time: 2026/03/01 14:59:59</main>", "browser", 201),
        ("pubg", URLS["pubg"], "<div><div><a href='/en/news/9690?x=1'>Notes</a><span>2026.02.01</span></div></div>"),
        ("pubg", PUBG, "<header><h1>Patch 40.1</h1><span class='date'>PATCH NOTES February 3</span></header>", "browser", 201),
        (RDR, URLS[RDR], "<p>nothing</p>"),
        (RDR, URLS[RDR], "<a href='/newswire/article/1'>GTA January 1, 2026</a><a href='/newswire/article/2'><span>Red Dead Online</span>"
         "<span>February 3, 2026</span><h3>Crime</h3></a>", "browser"),
        (EA, URLS[EA], "<ul><li><p><a href='/b/1'>Title Update 1.2</a></p> by x <i>2 weeks ago</i></li></ul>"),
    )


@pytest.mark.parametrize(
    ("source", "event_at", "url", "notes", "confidence", "status", "mode"),
    [
        ("fortnite", "2026-03-05", URLS["fortnite"], None, "high", 200, "http"),
        ("lol", "2026-02-04", URLS["lol"], "Patch 26.3", "high", 200, "http"),
        ("valorant", "2026-02-03 14:00", URLS["valorant"], "P2", "medium", 200, "http"),
        ("cs2", "2026-01-29", URLS["cs2"], "Counter-Strike 2 Update", "high", 200, "browser"),
        ("minecraft", "2026-01-20 10:00", MINECRAFT, "Minecraft 1.21.4", "high", 200, "http"),
        ("roblox", "2026-01-31 21:55:58.697", URLS["roblox-public"], "Current status: Operational", "high", 200, "http"),
        ("warzone", "2026-01-07", URLS["warzone"], "Warzone notes", "medium", 200, "http"),
        # The listing's load is reported for the first, the article's for the second.
        ("genshin", "2026-03-01 14:59:59", GENSHIN, "Event Wish", "medium", 200, "http"),
        ("pubg", "2026-02-03", PUBG, "Patch 40.1", "high", 201, "browser"),
        (RDR, "2026-02-03", "https://www.rockstargames.com/newswire/article/2", "Crime", "high", 200, "browser"),
        (EA, "2026-01-21 21:00", "https://forums.ea.com/b/1", "Title Update 1.2", "medium", 200, "http"),
    ],
)
def test_good_pages(good, source, event_at, url, notes, confidence, status, mode):
    row = good[source]
    assert (row.ok, row.event_at) == (True, datetime.fromisoformat(event_at))
    assert (row.source_url, row.notes, row.confidence, row.http_status, row.fetch_mode) == (url, notes, confidence, status, mode)
    assert row.failure_type is None and row.explanation is None


def test_season_extras(good):
    extras = good["fortnite"].extras
    assert extras["currentSeasonEnds"] == "2026-03-05" and extras["timezone"] == "America/New_York"
    assert extras["nextSeasonEstimateFriendly"] == "March 6, 2026" and extras["nextSeasonStart"] is None


def test_failures_are_rows(spark):
    wall = "<html><head><title>Just a moment</title></head><body><h1>Security check</h1><p>Ray 1234</p></body></html>"
    out = run(
        spark,
        ("fortnite", URLS["fortnite"], wall),
        ("lol", URLS["lol"], None, "http", 429),
        ("valorant", URLS["valorant"], "", "http", 503),
        ("roblox", URLS["roblox"], "{broken"),
        ("pubg", URLS["pubg"], "<p>no link</p>"),
        ("genshin", URLS["genshin"], "<article>Update <a href='/en/news/9'>x</a></article>"),
        ("warzone", URLS["warzone"], None),
    )
    assert {k: (r.ok, r.failure_type) for k, r in out.items()} == {
        "fortnite": (False, "parse_failed"), "lol": (False, "blocked"), "valorant": (False, "unavailable"),
        "roblox": (False, "parse_failed"), "pubg": (False, "parse_failed"), "genshin": (False, "unavailable"),
        "warzone": (False, "parse_failed"),
    }
    assert out["fortnite"].explanation == f"Crashed: {FAILURES['fortnite']}"
    assert out["lol"].explanation == "Crashed: HTTP 429"
    assert out["pubg"].explanation == f"Crashed: {NO_LINK}"
    assert out["genshin"].explanation == f"Crashed: Article fetch failed: {GENSHIN} (0)"


def test_bad_header_time_goes_to_the_listing_date(spark):
    listing = "<div><div><a href='/en/news/9690'>Notes</a><span>2026.02.01</span></div></div>"
    article = "<header><h1>P</h1><time>soon</time></header><time datetime='2026-02-02'></time><p>January 5, 2026</p>"
    row = run(spark, ("pubg", URLS["pubg"], listing), ("pubg", PUBG, article))["pubg"]
    assert (row.event_at, row.notes) == (datetime(2026, 2, 1), None)


def test_article_tiers_after_an_implausible_time(spark):
    listing = "<article><a href='/hc/articles/1'>Patch</a></article>"
    data = "<script type='application/ld+json'>{\"uploadDate\":\"2026-01-09\"}</script>"
    old = "<time datetime='1999-01-01'></time>"
    pages = [("minecraft", URLS["minecraft"], listing), ("minecraft", MINECRAFT, data + old + "<p>Sept 3, 2025</p>")]
    assert run(spark, *pages)["minecraft"].event_at == datetime(2026, 1, 9)
    pages[1] = ("minecraft", MINECRAFT, old + "<p>Sept 3, 2025</p>")
    assert run(spark, *pages)["minecraft"].event_at == datetime(2025, 9, 3)
    # The rendered channel trusts the mark as it is.
    browser = [("minecraft", URLS["minecraft"], listing, "browser"), ("minecraft", MINECRAFT, old, "browser")]
    assert run(spark, *browser)["minecraft"].event_at == datetime(1999, 1, 1)


def test_missing_article_falls_back_to_the_listing_where_allowed(spark):
    row = run(spark, ("minecraft", URLS["minecraft"], "<article><a href='/hc/articles/1'>Patch</a> Jan 3, 2026</article>"))["minecraft"]
    assert (row.ok, row.event_at, row.source_url) == (True, datetime(2026, 1, 3), URLS["minecraft"])


def test_every_card_of_a_listing_counts(spark):
    cards = "".join(f"<article>January {i}, 2026</article>" for i in range(1, 11))
    late = "<article><time datetime='2026-02-01'></time></article>"
    assert run(spark, ("valorant", URLS["valorant"], cards + late))["valorant"].event_at == datetime(2026, 2, 1)


def test_new_source_is_only_rows(spark):
    new = rule("chess", "next-round", "card", [("text", "month_loose", True)], url="https://chess.example/", cards=["li"],
               policy="next", keywords=["round"], keyword_in="text", source_tz="Europe/Oslo", confidence="low")
    rules, sources = register(rules_table(spark), registry(spark), [new], "Chess")
    body = "<ul><li>Round 1 Feb 1 2026</li><li>Round 2 Feb 9 2026</li><li>Party Feb 5 2026</li></ul>"
    row = run(spark, ("chess", "https://chess.example/", body), rules=rules)["chess"]
    assert (row.event_at, row.confidence, row.event_type) == (datetime(2026, 2, 8, 23), "low", "next-round")
    assert sources.count() == len(SOURCES) + 1


def test_plain_text_dates_use_fewer_headings(spark):
    plain = "<a href='/x'>Warzone <b class='title'>T</b> 1/7/2026</a>"
    assert run(spark, ("warzone", URLS["warzone"], plain))["warzone"].notes is None
    timed = plain.replace("1/7/2026", "<time datetime='2026-01-07'>x</time>")
    assert run(spark, ("warzone", URLS["warzone"], timed))["warzone"].notes == "T"


def test_one_item_is_no_feed(spark):
    feed = "<rss><channel><item><title>Update</title><pubDate>Thu, 1 Jan 2026 22:00:00 +0000</pubDate></item></channel></rss>"
    row = run(spark, ("cs2", URLS["cs2-feed"], feed))["cs2"]
    assert (row.ok, row.failure_type, row.explanation) == (False, "parse_failed", f"Crashed: {FAILURES['cs2-feed']}")


def test_rendered_listing_asks_for_time_elements_first(spark):
    listing = "<article><a href='/hc/articles/1'>Patch</a></article>"
    article = "<p class='date'>January 5, 2026</p><time title='2026-01-09'></time>"
    for mode, day in (("http", 5), ("browser", 9)):
        row = run(spark, ("minecraft", URLS["minecraft"], listing, mode), ("minecraft", MINECRAFT, article, mode))["minecraft"]
        assert row.event_at == datetime(2026, 1, day), mode


def test_parser_sees_one_article_per_run_and_source(spark, monkeypatch):
    """Of many loads of many articles, linked from both channels, bodies of the chosen ones alone are parsed."""
    parsed = spark.sparkContext.accumulator(0)
    plain = observing.outline.elements

    def counted(body, *rest):
        @F.udf("string")
        def tell(text):
            parsed.add(text is not None)
            return text

        return plain(tell(body), *rest)

    pages = []
    for i in range(6):
        listing = f"<div><a href='/en/news/{100 + i}'>Notes</a></div>"
        pages += [("pubg", URLS["pubg"], listing), ("pubg", URLS["pubg"], listing.replace("/1", "/2"), "browser")]
        pages += [("pubg", f"https://pubg.com/en/news/{k}00{i}", "<p>January 5, 2026</p>") for k in (1, 3, 4, 5)]
        pages += [("pubg", f"https://pubg.com/en/news/{h}0{i}", f"<header><time datetime='2026-01-0{h}'>x</time></header>") for h in (1, 2, 1)]
    rows = [(n, f"r{n // 9}", s, u, None, NOW, 200, (m or ["http"])[0], None, b) for n, (s, u, b, *m) in enumerate(pages)]
    monkeypatch.setattr(observing.outline, "elements", counted)
    snapshots = spark.createDataFrame(rows, SNAPSHOTS)
    out = observe(snapshots, rules_table(spark).filter("source_id = 'pubg'"))
    listings = parsed.value
    assert listings == 12  # both channels of six runs
    assert {(r.run_id, r.event_at, r.source_url) for r in out.collect()} == {
        (f"r{i}", datetime(2026, 1, 1), f"https://pubg.com/en/news/10{i}") for i in range(6)
    }
    assert parsed.value - listings == 6


def test_plans_hold_only_what_the_rules_use(spark):
    rules = rules_table(spark)
    assert Kinds.of(rules.filter("source_id = 'warzone'")) == Kinds(
        frozenset(["card"]), frozenset(["time_attr", "text"]), frozenset(["any_date", "slash_or_month"]), frozenset(["latest"]), False, False
    )
    page = snapshots(spark, ("roblox", URLS["roblox"], "{}"))
    plan = observe(page, rules.filter("source_id = 'roblox'"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "Bloom" not in plan
