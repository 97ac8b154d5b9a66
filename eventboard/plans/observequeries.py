"""Registered queries of the twelve sources, each over pages that Spark prints from the orders table.

An order is a run: its date is what the page announces, the page is fetched 20 days later. Every
tenth run has a page without a date and every tenth a blocked one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.operators import resolve as rs
from eventboard.plans.observe import observe
from eventboard.plans.rules import FAILURES, NO_LINK, URLS, register, registry, rule, rules_table
from eventboard.plans.tables import spread, table
from eventboard.schemas import SNAPSHOTS, columns

OUT = ["run_id", "ok", "event_at", "source_url", "notes", "confidence", "http_status", "failure_type", "explanation"]


def _n() -> Column:
    return F.col("o_orderkey")


def _day(days: int = 0) -> Column:
    return F.col("o_orderdate") + F.make_dt_interval(days=F.lit(days))


def _print(pattern: str, days: int = 0) -> Column:
    return F.date_format(_day(days), pattern)


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _key() -> Column:
    return _n().cast("string")


def _snapshots(orders: DataFrame, source: str, body: Column, url: Column | str, mode: str = "http", number: int = 0, final: Column | None = None) -> DataFrame:
    """One snapshot per order; ``number`` tells several pages of one run apart, ``final`` is where a redirect led."""
    fields = {
        "snapshot_id": _n() * 4 + number,
        "run_id": _key(),
        "source_id": F.lit(source),
        "requested_url": F.lit(url) if isinstance(url, str) else url,
        "final_url": final if final is not None else F.lit(None).cast("string"),
        "fetched_at": _day(20),
        "http_status": F.when(_n() % 10 == 9, 403).otherwise(200),
        "fetch_mode": F.lit(mode),
        "error": F.lit(None).cast("string"),
        "body": F.when(_n() % 10 == 8, "<html><body><p>Nothing to see</p></body></html>").otherwise(body),
    }
    return orders.select(*[fields[c].alias(c) for c in columns(SNAPSHOTS)])


def _fortnite(o: DataFrame) -> DataFrame:
    body = _cat("<html><style>p{}</style><body><p>Season <b>Ends on ", _print("MMMM d, yyyy"), "</b> ET</p></body></html>")
    return _snapshots(o, "fortnite", body, URLS["fortnite"])


def _lol(o: DataFrame) -> DataFrame:
    def row(name: Column, days: int) -> Column:
        return _cat("<tr><td>", name, "</td><td> ", _print("EEEE, MMM d, yyyy", days), " </td></tr>")

    body = _cat("<html><table><tr><th>Patch</th><th>Date</th></tr>", row(F.lit("old"), -30),
                row(F.lit("far"), 50), row(_cat("26.", _key()), 25), "</table></html>")
    return _snapshots(o, "lol", body, URLS["lol"], final=F.when(_n() % 2 == 1, URLS["lol"] + "?from=schedule"))


def _valorant(o: DataFrame) -> DataFrame:
    timed = _cat("<article><h2>Timed ", _key(), "</h2><time datetime='", _print("yyyy-MM-dd'T'14:00:00.000'Z'"), "'>x</time></article>")
    worded = _cat("<article><p>posted ", _print("MMM d, yyyy", 5), "</p><h3> Worded </h3></article>")
    body = F.when(_n() % 2 == 0, _cat(worded, timed)).otherwise(_cat(timed, worded))
    return _snapshots(o, "valorant", _cat("<html><body>", body, "</body></html>"), URLS["valorant"])


def _cs2(o: DataFrame) -> DataFrame:
    post = _cat("<div class='blog_post'><div class='title'>Notes ", _key(), "</div><div class='date'>", _print("MMMM d, yyyy"),
                "</div><a href='/news/entry/", _key(), "'>more</a></div>")
    loose = _cat("<p>Release notes for ", _print("MMMM d, yyyy", 1), "</p>")
    body = F.when(_n() % 3 == 0, post).when(_n() % 3 == 1, loose).otherwise("<p>empty</p>")
    # Every sixth feed has a single item, which is no list.
    event = "<item><title>Event</title><pubDate>Thu, 1 Jan 1970 00:00:00 +0000</pubDate></item>"
    feed = _cat("<rss><channel>", F.when(_n() % 6 == 5, "").otherwise(event), "<item><title>Update ",
                _key(), "</title><pubDate>", _print("EEE, dd MMM yyyy 22:00:00", 2), " +0000</pubDate><link>https://feed.example/",
                _key(), "</link></item></channel></rss>")
    page = _snapshots(o, "cs2", _cat("<html><body>", body, "</body></html>"), URLS["cs2"], "browser")
    return page.unionByName(_snapshots(o, "cs2", feed, URLS["cs2-feed"], number=1))


def _elsewhere(url: Column) -> Column:
    """Every third article was moved: its page is there, but not where the listing says."""
    return F.when(_n() % 3 == 2, _cat(url, "/moved")).otherwise(url)


def _minecraft(o: DataFrame) -> DataFrame:
    listing = _cat("<html><body><ul><li class='blocks-item'><a href='#top'>Changelog</a></li><li class='blocks-item'><a href='/hc/articles/",
                   _key(), "'>Version 1.", _key(), "</a></li></ul><p>Listed ", _print("MMMM d, yyyy", 3), "</p></body></html>")
    # Every third article has an impossible mark, its structured data tells the date.
    marked = _cat("<time datetime='", _print("yyyy-MM-dd"), "'>x</time>")
    data = _cat('<script type="application/ld+json">{"datePublished":"', _print("yyyy-MM-dd"), '"}</script><time datetime="1990-01-01">x</time>')
    article = _cat("<html><body><h1>Minecraft 1.", _key(), "</h1>", F.when(_n() % 3 == 1, data).otherwise(marked), "</body></html>")
    url = _cat("https://feedback.minecraft.net/hc/articles/", _key())
    pages = _snapshots(o, "minecraft", listing, URLS["minecraft"])
    return pages.unionByName(_snapshots(o, "minecraft", article, _elsewhere(url), number=1))


def _roblox(o: DataFrame) -> DataFrame:
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    body = _cat('{"result":{"status_overall":{"status":"S', _key(), '","updated":', seconds, "}}}")
    return _snapshots(o, "roblox", body, URLS["roblox"])


def _warzone(o: DataFrame) -> DataFrame:
    body = _cat("<html><body><div class='card'>Mobile ", _print("M/d/yyyy", 9), "</div><a href='/x'><h3>Warzone ", _key(), "</h3> on ",
                _print("M/d/yyyy"), "</a></body></html>")
    return _snapshots(o, "warzone", body, URLS["warzone"])


def _genshin(o: DataFrame) -> DataFrame:
    listing = _cat("<html><ul class='news-list'><li>Hello</li><li><h3>Event Wish ", _key(), "</h3><a href='/en/news/", _key(), "'>more</a></li></ul></html>")
    article = _cat("<html><main>Start ", _print("yyyy/MM/dd 10:00:00"), " End Time: ", _print("yyyy/MM/dd 14:59:59", 40), "</main></html>")
    url = _cat("https://genshin.hoyoverse.com/en/news/", _key())
    pages = _snapshots(o, "genshin", listing, URLS["genshin"])
    return pages.unionByName(_snapshots(o, "genshin", article, _elsewhere(url), number=1))


def _pubg(o: DataFrame) -> DataFrame:
    listing = _cat("<html><div class='all'><div><a href='/en/news/", _key(), "?c=1'>Notes</a><b>", _print("yyyy.MM.dd", 1), "</b></div></div></html>")
    mark = F.when(_n() % 3 == 0, _cat("PATCH NOTES ", _print("MMMM d"))).when(_n() % 3 == 1, "sometime").otherwise(_print("yyyy-MM-dd"))
    article = _cat("<html><header><h1>Patch ", _key(), "</h1><span class='date'>", mark, "</span></header></html>")
    url = _cat("https://pubg.com/en/news/", _key())
    pages = _snapshots(o, "pubg", listing, URLS["pubg"])
    return pages.unionByName(_snapshots(o, "pubg", article, url, number=1))


def _rdr2(o: DataFrame) -> DataFrame:
    def article(n: str, name: str, days: int) -> Column:
        return _cat(f"<a href='/newswire/article/{n}/", _key(), f"'><span>{name}</span><span>", _print("MMMM d, yyyy", days), "</span><h3>Crime ", _key(), "</h3></a>")

    other, wanted = article("1", "GTA", 4), article("2", "Red Dead Online", 0)
    plain = F.when(_n() % 2 == 0, _cat(other, wanted)).otherwise(other)
    url = URLS["red-dead-redemption-2"]
    pages = _snapshots(o, "red-dead-redemption-2", _cat("<html>", plain, "</html>"), url)
    return pages.unionByName(_snapshots(o, "red-dead-redemption-2", _cat("<html>", wanted, "</html>"), url, "browser", 1))


def _eafc(o: DataFrame) -> DataFrame:
    when = F.when(_n() % 3 == 0, _print("MMMM d, yyyy")).when(_n() % 3 == 1, "<time>").otherwise(_cat(" posted ", (_n() % 5 + 1).cast("string"), " weeks ago"))
    close = F.when(_n() % 3 == 1, _cat(_print("MM/dd/yyyy", 2), "</time>")).otherwise("")
    body = _cat("<html><ul><li><a href='/b/0'>Other</a></li><li><p><a href='/b/", _key(), "'>Title Update v", _key(), "</a></p> <i>by x</i> ", when, close, "</li></ul></html>")
    return _snapshots(o, "ea-sports-fc", body, URLS["ea-sports-fc"])


PAGES = {
    "fortnite": _fortnite, "lol": _lol, "valorant": _valorant, "cs2": _cs2, "minecraft": _minecraft, "roblox": _roblox,
    "warzone": _warzone, "genshin": _genshin, "pubg": _pubg, "red-dead-redemption-2": _rdr2, "ea-sports-fc": _eafc,
}


def observe_source(source: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = PAGES[source](spread(table(spark, sf_dir, "orders")))
    rules = rules_table(spark).filter(F.col("source_id") == source)
    return observe(pages, rules).select(*OUT)


def observe_gta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"))
    pages = _fortnite(orders)
    runs = pages.select("run_id", F.col("fetched_at").alias("started_at"))
    rules = rules_table(spark).filter(F.col("source_id").isin("fortnite", "gta"))
    return observe(pages, rules, runs).select("source_id", "event_type", *OUT)


def observe_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is only a registry row and rule rows: two weekly slots and a page of its own, beside a known one."""
    orders = spread(table(spark, sf_dir, "orders"))
    items = _cat("<html><ul><li>Party ", _print("MMM d, yyyy", 21), "</li><li>Round ", _key(), " on ", _print("MMM d, yyyy", 23),
                 "</li><li>Round late ", _print("MMM d, yyyy", 30), "</li></ul></html>")
    pages = _snapshots(orders, "chess", items, "https://chess.example/").unionByName(_fortnite(orders))
    rows = [
        rule("chess", "next-round", "card", [("text", "month_loose", True)], url="https://chess.example/", cards=["li"], policy="next",
             keywords=["round"], keyword_in="text", confidence="low", failure_text="no round is announced"),
        rule("club", "meeting", "weekly", [], url="https://club.example/", slot_dow=1, slot_time="18:30", slot_note="every Monday evening"),
    ]
    rules, sources = rules_table(spark).filter("source_id = 'fortnite'"), registry(spark)
    for row in rows:
        rules, sources = register(rules, sources, [row], row["source_id"].title())
    runs = pages.filter("source_id = 'chess'").select("run_id", F.col("fetched_at").alias("started_at"))
    obs = observe(pages, rules, runs)
    return obs.join(sources.select("source_id", "name"), "source_id").select("source_id", "name", "event_type", *OUT)


def refresh_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three sources to observations, resolved history and health per year of runs."""
    orders = spread(table(spark, sf_dir, "orders"))
    pages = _fortnite(orders).unionByName(_warzone(orders)).unionByName(_roblox(orders))
    obs = observe(pages, rules_table(spark)).withColumn("seq", F.col("run_id").cast("long"))
    named = obs.join(registry(spark).select("source_id", "event_type", "name"), ["source_id", "event_type"], "left")
    live = rs.resolve_history(named, tie="seq").withColumn("year", F.year("fetched_at"))
    return rs.health_gate(live, keys=["source_id", "year"])


_D = "o_orderdate"
_K = "CAST(o_orderkey AS VARCHAR)"


def _expect(source: str, at: str, url: str, notes: str, confidence: str, missing: str, extra: str = "", lost: str = "false", lost_text: str = "NULL", lost_status: str = "200", bare: str = "false") -> str:
    """Expected rows: ``lost`` marks runs whose article is absent although the listing was fine, ``bare`` more without a date."""
    blocked = "o_orderkey % 10 = 9"
    return f"""WITH e AS (SELECT o_orderkey, {_K} AS run_id, {at} AS made, {url} AS url, {notes} AS notes, {confidence} AS conf,
  CASE WHEN {blocked} THEN 'blocked' WHEN o_orderkey % 10 = 8 OR {bare} THEN 'parse_failed' WHEN {lost} THEN 'unavailable' END AS failure,
  CASE WHEN {blocked} THEN 'HTTP 403' WHEN o_orderkey % 10 = 8 OR {bare} THEN {missing} WHEN {lost} THEN {lost_text} END AS text
  FROM orders{extra})
SELECT run_id, failure IS NULL AS ok, CASE WHEN failure IS NULL THEN CAST(made AS TIMESTAMP) END AS event_at,
  CASE WHEN failure IS NULL THEN url END AS source_url, CASE WHEN failure IS NULL THEN notes END AS notes,
  CASE WHEN failure IS NULL THEN conf END AS confidence,
  CAST(CASE WHEN failure = 'blocked' THEN 403 ELSE {lost_status} END AS INTEGER) AS http_status,
  failure AS failure_type, 'Crashed: ' || text AS explanation FROM e"""


def _missing(source: str) -> str:
    """The rule's own failure text as a SQL literal."""
    text = FAILURES[source].replace("{url}", URLS.get(source, ""))
    return f"'{text}'"


_MC = "https://feedback.minecraft.net/hc/articles/"

QUERIES = {
    **{f"observe_{s.replace('-', '_')}": partial(observe_source, s) for s in PAGES},
    "observe_gta": observe_gta,
    "observe_registered": observe_registered,
    "refresh_health": refresh_health,
}

_FORTNITE_SQL = _expect("fortnite", _D, f"'{URLS['fortnite']}'", "CAST(NULL AS VARCHAR)", "'high'", _missing("fortnite"))

ORACLES = {
    "observe_fortnite": _FORTNITE_SQL,
    "observe_lol": _expect(
        "lol", f"{_D} + INTERVAL 25 DAY", f"'{URLS['lol']}' || CASE WHEN o_orderkey % 2 = 1 THEN '?from=schedule' ELSE '' END", f"'Patch 26.' || {_K}", "'high'",
        _missing("lol"),
    ),
    "observe_valorant": _expect(
        "valorant", f"CASE WHEN o_orderkey % 2 = 0 THEN {_D} + INTERVAL 5 DAY ELSE {_D} + INTERVAL 14 HOUR END",
        f"'{URLS['valorant']}'", f"CASE WHEN o_orderkey % 2 = 0 THEN 'Worded' ELSE 'Timed ' || {_K} END", "'medium'",
        _missing("valorant"),
    ),
    "observe_cs2": _expect(
        "cs2", f"CASE o_orderkey % 3 WHEN 0 THEN {_D} WHEN 1 THEN {_D} + INTERVAL 1 DAY ELSE {_D} + INTERVAL 70 HOUR END",
        f"CASE o_orderkey % 3 WHEN 0 THEN '/news/entry/' || {_K} WHEN 1 THEN '{URLS['cs2']}' ELSE 'https://feed.example/' || {_K} END",
        f"CASE o_orderkey % 3 WHEN 0 THEN 'Notes ' || {_K} WHEN 1 THEN 'Counter-Strike 2 Update' ELSE 'Update ' || {_K} END",
        "'high'", _missing("cs2-feed"), bare="o_orderkey % 6 = 5",
    ),
    "observe_minecraft": _expect(
        "minecraft", f"CASE WHEN o_orderkey % 3 = 2 THEN {_D} + INTERVAL 3 DAY ELSE {_D} END",
        f"CASE WHEN o_orderkey % 3 = 2 THEN '{URLS['minecraft']}' ELSE '{_MC}' || {_K} END",
        f"CASE WHEN o_orderkey % 3 = 0 THEN 'Minecraft 1.' || {_K} END", "'high'",
        _missing("minecraft"),
    ),
    "observe_roblox": _expect(
        "roblox", _D, f"'{URLS['roblox-public']}'", f"'Current status: S' || {_K}", "'high'",
        _missing("roblox"),
    ),
    "observe_warzone": _expect(
        "warzone", _D, f"'{URLS['warzone']}'", f"'Warzone ' || {_K}", "'medium'",
        _missing("warzone"),
    ),
    "observe_genshin": _expect(
        "genshin", f"{_D} + to_seconds(40 * 86400 + 53999)",
        f"'https://genshin.hoyoverse.com/en/news/' || {_K}", f"'Event Wish ' || {_K}", "'medium'",
        _missing("genshin"),
        lost="o_orderkey % 3 = 2", lost_text=f"'Article fetch failed: https://genshin.hoyoverse.com/en/news/' || {_K} || ' (0)'",
    ),
    "observe_pubg": _expect(
        "pubg", f"CASE o_orderkey % 3 WHEN 0 THEN make_timestamp(year({_D} + INTERVAL 20 DAY), month({_D}), day({_D}), 0, 0, 0) "
        f"WHEN 1 THEN {_D} + INTERVAL 1 DAY ELSE {_D} END",
        f"'https://pubg.com/en/news/' || {_K}", f"CASE o_orderkey % 3 WHEN 1 THEN NULL ELSE 'Patch ' || {_K} END", "'high'",
        f"'{NO_LINK}'",
    ),
    "observe_red_dead_redemption_2": _expect(
        "rdr2", _D, f"'https://www.rockstargames.com/newswire/article/2/' || {_K}", f"'Crime ' || {_K}",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'medium' ELSE 'high' END",
        _missing("red-dead-redemption-2"),
    ),
    "observe_ea_sports_fc": _expect(
        "eafc", f"CASE o_orderkey % 3 WHEN 0 THEN {_D} WHEN 1 THEN {_D} + INTERVAL 2 DAY "
        f"ELSE {_D} + INTERVAL 20 DAY - to_weeks(CAST(o_orderkey % 5 + 1 AS INTEGER)) END",
        f"'https://forums.ea.com/b/' || {_K}", f"'Title Update v' || {_K}", "'medium'",
        _missing("ea-sports-fc"),
    ),
    "observe_gta": f"""SELECT 'fortnite' AS source_id, 'next-season' AS event_type, * FROM ({_FORTNITE_SQL})
UNION ALL SELECT 'gta', 'weekly-reset', {_K}, true,
  CASE WHEN date_trunc('week', t) + INTERVAL 82 HOUR > t THEN date_trunc('week', t) + INTERVAL 82 HOUR
       ELSE date_trunc('week', t) + INTERVAL 250 HOUR END,
  '{URLS['gta']}', 'new week every Thursday, 10:00 UTC', 'high', NULL, NULL, NULL
FROM (SELECT *, {_D} + INTERVAL 20 DAY AS t FROM orders)""",
    "observe_registered": f"""SELECT 'fortnite' AS source_id, 'Fortnite' AS name, 'next-season' AS event_type, * FROM ({_FORTNITE_SQL})
UNION ALL SELECT 'chess', 'Chess', 'next-round', * FROM ({_expect(
        "chess", f"{_D} + INTERVAL 23 DAY", "'https://chess.example/'", f"'Round ' || {_K} || ' on ' || strftime({_D} + INTERVAL 23 DAY, '%b %-d, %Y')",
        "'low'", "'no round is announced'",
    )})
UNION ALL SELECT 'club', 'Club', 'meeting', {_K}, true,
  CASE WHEN date_trunc('week', t) + to_seconds(66600) > t THEN date_trunc('week', t) + to_seconds(66600) ELSE date_trunc('week', t) + to_seconds(671400) END,
  'https://club.example/', 'every Monday evening', 'high', NULL, NULL, NULL
FROM (SELECT *, {_D} + INTERVAL 20 DAY AS t FROM orders)""",
    "refresh_health": f"""WITH runs AS (SELECT o_orderkey, {_D} + INTERVAL 20 DAY AS t, o_orderkey % 10 < 8 AS ok FROM orders),
resolved AS (SELECT t, CASE WHEN ok THEN 'fresh' WHEN max(CASE WHEN ok THEN 1 END) OVER (
    ORDER BY t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN 'stale' ELSE 'unavailable' END AS status FROM runs),
n AS (SELECT year(t) AS year, count(*) AS total, count(*) FILTER (WHERE status = 'fresh') AS fresh,
  count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'unavailable') AS unavailable FROM resolved GROUP BY 1)
SELECT s AS source_id, n.*, CAST(unavailable AS DOUBLE) / total AS failure_ratio, CAST(unavailable AS DOUBLE) / total > 0.5 AS failed
FROM n, (VALUES ('fortnite'), ('warzone'), ('roblox')) v(s)""",
}
