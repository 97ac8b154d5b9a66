"""Registered queries over documents built from the given tables: records, feeds, tables, time marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions.dates import rfc822
from eventboard.functions.predicates import matches_any
from eventboard.operators import pages as pg
from eventboard.operators import pick
from eventboard.operators import resolve as rs
from eventboard.operators.follow import follow_links
from eventboard.plans.tables import HISTORY_SQL, run_log, spread, table
from eventboard.sources import feeds, results, snapshots

PAGE_STATUS = [200, 403, 404, 503, 204]
FEED_WORDS = ["update", "patch", "release notes"]


def status_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status documents with the change time as seconds, as text, as zero or missing."""
    kind = F.col("event_id") % 4
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    text = F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    updated = F.when(kind == 0, seconds).when(kind == 1, text).when(kind == 2, "0").otherwise("null")
    word = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    json = F.concat(
        F.lit('{"result":{"status_overall":{"status":"'), word, F.lit('","updated":'), updated, F.lit("}}}")
    )
    docs = spread(table(spark, sf_dir, "events")).select("event_id", json.alias("doc"))
    return feeds.status_docs(docs, "doc", ["event_id"])


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed document per order with a news item, an update item (not always) and an older item."""

    def item(title, days: int):
        at = F.date_format(F.col("o_orderdate") - F.make_dt_interval(days=F.lit(days)), "EEE, d MMM yyyy HH:mm:ss")
        link = F.concat(F.lit("https://example.org/n/"), F.col("o_orderkey").cast("string"), F.lit(f"/{days}"))
        return F.concat(
            F.lit("<item><title>"), title, F.lit("</title><pubDate>"), at, F.lit(" +0000</pubDate><link>"), link,
            F.lit("</link></item>"),
        )

    second = F.when(F.col("o_orderkey") % 3 == 0, "Community event").otherwise("Big Update")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>News</title>'),
        item(F.lit("Weekend event"), 0), item(second, 3), item(F.lit("Old patch"), 9),
        F.lit("</channel></rss>"),
    )
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", xml.alias("doc"))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_items(_feeds(spark, sf_dir), "doc", ["o_orderkey"]).drop("pub_date")


def feed_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's first matching item, picked inside the document's row."""

    def placed(item, pos):
        return F.struct(pos.alias("pos"), item["title"].alias("title"), item["link"].alias("link"), item["pubDate"].alias("pub_date"))

    docs = _feeds(spark, sf_dir).select("o_orderkey", F.transform(feeds.items_of(F.col("doc")), placed).alias("items"))
    best = pick.match_or_first_in(F.col("items"), lambda i: matches_any(i["title"], FEED_WORDS))
    # As rows of an array of one or none: a filter on the pick would read the document again.
    picked = docs.select("o_orderkey", F.inline(F.array_compact(F.array(best))))
    return picked.select("o_orderkey", "pos", "title", "link", rfc822(F.col("pub_date")).alias("event_at"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in PAGE_STATUS]), (F.col("page_id") % 5 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("snapshot_id"),
        F.concat(F.lit("s"), (F.col("page_id") % 12).cast("string")).alias("source_id"),
        F.col("url").alias("requested_url"),
        status.alias("http_status"),
        (F.lit("2026-02-04 21:35:06.572").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("page_id"))).alias("fetched_at"),
        F.col("html").alias("body"),
    )
    return snapshots.quarantine(pages)


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = rs.resolve_history(run_log(table(spark, sf_dir, "events")), tie="event_id")
    return results.to_result_json(live)


def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written in the old shape, the new shape, with extras, and broken ones."""
    kind = F.col("event_id") % 4
    user, at = F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    head = F.concat(F.lit('{"game":"g'), user, F.lit('","type":"next-patch","title":"T'), user, F.lit('",'))
    old = F.concat(
        head, F.lit('"status":"fallback","nextEventUtc":null,"lastUpdatedUtc":"'), at,
        F.lit('","source":{"name":"Old site","url":"https://old.example/"}}'),
    )
    new = F.concat(
        head, F.lit('"status":"fresh","nextEventUtc":"'), at, F.lit('","fetched_at_utc":"'), at,
        F.lit('","source_url":"https://new.example/","confidence":"high","http_status":200}'),
    )
    extra = F.concat(
        head, F.lit('"status":"fresh","nextEventUtc":"'), at, F.lit('","fetched_at_utc":"'), at,
        F.lit('","source_url":"","sourceName":"Label","nextSeasonStart":null}'),
    )
    text = F.when(kind == 0, old).when(kind == 1, new).when(kind == 2, extra).otherwise(F.concat(head, F.lit('"status":')))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("value"))
    parsed = results.parse_results(rows)
    keyed = results.normalize_results(parsed.withColumn("title", F.when(F.col("event_id") % 8 < 4, F.col("title"))))
    return keyed.select(
        "source_id", "title", "status", "event_at", "source_url", "confidence", "http_status", "fetched_at",
        "source_label", F.map_contains_key("extras", F.lit("nextSeasonStart")).alias("has_season_start"),
    )


def schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a schedule table; header rows and rows without a name or a date are not candidates."""

    def row(name, days: int):
        when = F.date_format(F.col("o_orderdate") + F.make_dt_interval(days=F.lit(days)), "EEEE, MMM d, yyyy")
        return F.concat(F.lit("<tr><td> "), name, F.lit(" </td><td><b>"), when, F.lit("</b></td></tr>\n"))

    html = F.concat(
        F.lit("<html><body><table class='x'><tr><th>Patch</th><th>Date</th></tr>"),
        row(F.lit("1.1"), 0), row(F.lit(""), 7), row(F.concat(F.lit("1."), F.col("o_custkey").cast("string")), 14),
        F.lit("<tr><td>only one</td></tr></table><table><tr><td>9</td><td>x</td></tr></table></body></html>"),
    )
    pages = table(spark, sf_dir, "orders").select("o_orderkey", html.alias("body"))
    rows = pg.table_rows(pages, keys=["o_orderkey"])
    return rows.select("o_orderkey", "row", F.get("cells", F.lit(0)).alias("name"), F.get("cells", F.lit(1)).alias("day"))


def _marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a time element, a meta date, time text only or structured data, by order number."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'10:30:00'Z'")
    long = F.date_format("o_orderdate", "MMMM d, yyyy")
    kind = F.col("o_orderkey") % 4
    mark = (
        F.when(kind == 0, F.concat(F.lit('<time class="t" datetime="'), iso, F.lit('">soon</time>')))
        .when(kind == 1, F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('">')))
        .when(kind == 2, F.concat(F.lit("<time> "), long, F.lit(" </time>")))
        .otherwise(F.lit("<p>no mark</p>"))
    )
    data = F.concat(
        F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"dateModified":"'),
        iso, F.lit('","datePublished":""}</script>'),
    )
    html = F.concat(F.lit("<html><head>"), data, F.lit("</head><body><h1>Order "), F.col("o_orderkey").cast("string"),
                    F.lit("</h1>"), mark, F.lit("<time datetime='1990-01-01'>later</time></body></html>"))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", html.alias("body"))


def time_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.time_elements(_marked_pages(spark, sf_dir), keys=["o_orderkey"])


def structured_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.jsonld_dates(_marked_pages(spark, sf_dir), keys=["o_orderkey"])


def followed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's newest order is the link; large order lines are its article page, others are drafts under another url."""
    orders = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("https://example.org/o/"), F.col("o_orderkey").cast("string"))
    links = pick.pick_latest(
        orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("pos"),
                      F.col("o_orderdate").alias("event_at"), url.alias("url")),
        keys=["source"],
    )
    lines = table(spark, sf_dir, "lineitem")
    page = F.concat(F.lit("https://example.org/o/"), F.col("l_orderkey").cast("string"))
    pages = lines.select(
        F.when(F.col("l_quantity") > 30, page).otherwise(F.concat(page, F.lit("/draft"))).alias("requested_url"),
        F.col("l_linenumber").alias("snapshot_id"),
        F.col("l_shipdate").alias("fetched_at"),
    )
    return follow_links(links, pages, on_missing="use_listing")


_WORD = "CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END"
_STAMP = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _item_sql(pos: int, title: str, days: int) -> str:
    return f"""SELECT o_orderkey, {pos} AS pos, {title} AS title,
  'https://example.org/n/' || CAST(o_orderkey AS VARCHAR) || '/{days}' AS link,
  o_orderdate - INTERVAL {days} DAY AS event_at FROM orders"""


_ITEMS_SQL = "\nUNION ALL ".join(
    [
        _item_sql(0, "'Weekend event'", 0),
        _item_sql(1, "CASE WHEN o_orderkey % 3 = 0 THEN 'Community event' ELSE 'Big Update' END", 3),
        _item_sql(2, "'Old patch'", 9),
    ]
)

_EVENT, _FETCHED, _SUCCESS = (_STAMP.format(c=c) for c in ("event_at", "fetched_at", "last_success_at"))

QUERIES = {
    "status_json": status_json,
    "feed_items": feed_items,
    "feed_pick": feed_pick,
    "quarantine": quarantine,
    "result_json": result_json,
    "normalized_records": normalized_records,
    "schedule_rows": schedule_rows,
    "time_marks": time_marks,
    "structured_dates": structured_dates,
    "followed_links": followed_links,
}

ORACLES = {
    "status_json": f"""SELECT event_id, {_WORD} AS status_word, CASE event_id % 4
  WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) END AS event_at FROM events""",
    "feed_items": _ITEMS_SQL,
    "feed_pick": f"""SELECT * FROM ({_ITEMS_SQL}) QUALIFY row_number() OVER (PARTITION BY o_orderkey
  ORDER BY CASE WHEN regexp_matches(title, '(?i)update|patch|release notes') THEN 0 ELSE 1 END, pos) = 1""",
    "quarantine": """WITH p AS (SELECT page_id AS snapshot_id, 's' || CAST(page_id % 12 AS VARCHAR) AS source_id, url AS requested_url,
  CAST(([200,403,404,503,204])[page_id % 5 + 1] AS INTEGER) AS http_status,
  TIMESTAMP '2026-02-04 21:35:06.572' + to_seconds(page_id) AS fetched_at, html AS body FROM pages)
SELECT *, source_id || '.' || replace(replace(strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%gZ'), ':', '-'), '.', '-') || '.html' AS name
FROM p WHERE http_status NOT BETWEEN 200 AND 299""",
    "result_json": f"""{HISTORY_SQL}, head AS (
  SELECT *, '{{"provider_id":"' || source_id || '","game":"' || source_id || '","type":"' || event_type || '","title":"' || title
    || '","status":"' || status || '",' AS h, CAST(http_status AS VARCHAR) AS code FROM history)
SELECT source_id || '.' || event_type || '.json' AS path, CASE status
  WHEN 'unavailable' THEN h || '"fetched_at_utc":"' || {_FETCHED} || '","failure_type":"' || failure_type || '","explanation":"'
    || explanation || '","http_status":' || code || ',"fetch_mode":"http","nextEventUtc":null}}'
  ELSE h || '"nextEventUtc":"' || {_EVENT} || '","fetched_at_utc":"' || {_FETCHED} || '","last_success_at_utc":"' || {_SUCCESS}
    || '","source_url":"' || source_url || '","confidence":"' || confidence || '","notes":"' || notes || '",'
    || CASE WHEN status = 'stale' THEN '"reason":"' || reason || '",' ELSE '' END
    || '"http_status":' || code || ',"fetch_mode":"http"}}' END AS json FROM head""",
    "normalized_records": """WITH t AS (SELECT *, event_id % 4 AS kind, date_trunc('millisecond', ts) AS w,
    CAST(user_id AS VARCHAR) AS u FROM events WHERE event_id % 4 < 3)
SELECT 'g' || u AS source_id, CASE WHEN event_id % 8 < 4 THEN 'T' || u END AS title,
  CASE kind WHEN 0 THEN 'fallback' ELSE 'fresh' END AS status, CASE WHEN kind > 0 THEN w END AS event_at,
  CASE kind WHEN 0 THEN 'https://old.example/' WHEN 1 THEN 'https://new.example/' END AS source_url,
  CASE WHEN kind = 1 THEN 'high' END AS confidence, CASE WHEN kind = 1 THEN 200 END AS http_status, w AS fetched_at,
  CASE WHEN kind = 2 THEN 'Label' WHEN event_id % 8 < 4 THEN 'T' || u WHEN kind = 0 THEN 'Old site'
       ELSE 'Official Source' END AS source_label,
  kind = 2 AS has_season_start FROM t""",
    "schedule_rows": """SELECT o_orderkey, 0 AS row, '1.1' AS name, strftime(o_orderdate, '%A, %b %-d, %Y') AS day FROM orders
UNION ALL SELECT o_orderkey, 2, '1.' || CAST(o_custkey AS VARCHAR), strftime(o_orderdate + INTERVAL 14 DAY, '%A, %b %-d, %Y') FROM orders""",
    "time_marks": """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 3 THEN '1990-01-01'
  ELSE strftime(o_orderdate, '%Y-%m-%dT10:30:00Z') END AS value, CASE o_orderkey % 4 WHEN 2 THEN o_orderdate
  WHEN 3 THEN TIMESTAMP '1990-01-01' ELSE o_orderdate + INTERVAL 630 MINUTE END AS event_at FROM orders)
SELECT * FROM t""",
    "structured_dates": """SELECT o_orderkey, 0 AS pos, CAST(NULL AS VARCHAR) AS raw, CAST(NULL AS TIMESTAMP) AS event_at FROM orders
UNION ALL SELECT o_orderkey, 1, strftime(o_orderdate, '%Y-%m-%dT10:30:00Z'), o_orderdate + INTERVAL 630 MINUTE FROM orders""",
    "followed_links": """WITH links AS (
  SELECT o_custkey AS source, o_orderkey AS pos, o_orderdate AS event_at, 'https://example.org/o/' || CAST(o_orderkey AS VARCHAR) AS url
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1
), articles AS (
  SELECT 'https://example.org/o/' || CAST(l_orderkey AS VARCHAR) || CASE WHEN l_quantity > 30 THEN '' ELSE '/draft' END AS url,
    l_linenumber AS article_snapshot_id, l_shipdate AS article_fetched_at
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_quantity > 30 ORDER BY l_shipdate DESC, l_linenumber DESC) = 1)
SELECT l.*, a.article_snapshot_id, a.article_fetched_at, a.url IS NOT NULL AS found, a.url IS NULL AS use_listing
FROM links l LEFT JOIN articles a ON a.url = l.url""",
}
