"""Pages to rows: links, elements, cards, table rows, time marks, structured data, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventboard.functions import text as tx
from eventboard.functions.dates import any_date, once
from eventboard.operators import outline

# The shapes of tables, time marks and structured-data blocks.
TABLE = r"(?is)<table\b[^>]*>(.*?)</table>"
ROW = r"(?is)<tr\b[^>]*>.*?</tr>"
CELL = r"(?is)<td\b[^>]*>.*?</td>"
TIME_MARK = (
    r"(?is)<time\b[^>]*>.*?</time>"
    r"|<meta\b[^>]*\b(?:property|name)\s*=\s*[\"']?(?:article:published_time|publish-date)\b[^>]*>"
)
JSONLD = r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"
JSONLD_FIELDS = ["datePublished", "dateModified", "uploadDate"]


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def links_of(body: Column) -> Column:
    """The anchors of a page in document order, as an array (pos, href, text) inside the page's own row."""

    def link(anchor: Column, pos: Column) -> Column:
        opening = F.regexp_extract(anchor, tx.OPENING_TAG, 0)
        return F.struct(
            pos.alias("pos"),
            tx.attribute(opening, "href").alias("href"),
            tx.strip(tx.html_to_text(anchor, sep="")).alias("text"),
        )

    return F.transform(all_matches(body, tx.ANCHOR), link)


def extract_links(df: DataFrame, body: str = "body", keys: list[str] | None = None) -> DataFrame:
    """(keys, pos, href, text) per anchor in document order; the body is not carried along."""
    keys = keys or ["snapshot_id"]
    found = df.select(*keys, F.posexplode(all_matches(F.col(body), tx.ANCHOR)).alias("pos", "anchor"))
    opening = F.regexp_extract("anchor", tx.OPENING_TAG, 0)
    return found.select(
        *keys,
        "pos",
        tx.attribute(opening, "href").alias("href"),
        tx.strip(tx.html_to_text(F.col("anchor"), sep="")).alias("text"),
    )


def parse_elements(
    df: DataFrame,
    selectors: list[str],
    body: str = "body",
    closest: list[str] | None = None,
    drop_noscript: bool = True,
) -> DataFrame:
    """``df`` with the page's selected elements as an array column instead of its body."""
    near = outline.selectors_column(closest) if closest else None
    column = outline.elements(F.col(body), outline.selectors_column(selectors), near, F.lit(drop_noscript))
    return df.select(*[c for c in df.columns if c != body], column.alias("elements"))


def extract_elements(df: DataFrame, selectors: list[str], body: str = "body", keys: list[str] | None = None) -> DataFrame:
    """One row per selected element: (keys, pos, parent_pos, tag, classes, attrs, text)."""
    keys = keys or ["snapshot_id"]
    parsed = parse_elements(df.select(*keys, body), selectors, body)
    return parsed.select(*keys, F.explode("elements").alias("e")).select(
        *keys, *[f"e.{c}" for c in ("pos", "parent_pos", "tag", "classes", "attrs", "text")]
    )


def context_text(elements: Column, element: Column, limit: int = 200) -> Column:
    """Parent's text, plus the grandparent's when the parent's is shorter than ``limit``."""
    parent = F.coalesce(F.get(elements, element["parent_at"])["text"], F.lit(""))
    grand = F.coalesce(F.get(elements, element["grand_at"])["text"], F.lit(""))
    return F.when(F.length(parent) < limit, F.concat(parent, F.lit(" "), grand)).otherwise(parent)


def with_context(
    df: DataFrame, selectors: list[str], closest: list[str], body: str = "body", keys: list[str] | None = None
) -> DataFrame:
    """Selected elements with the text around them and the text of their closest enclosing card.

    Enclosing elements sit in the same row's array, so the lookup is an index and not a join.
    """
    keys = keys or ["snapshot_id"]
    parsed = parse_elements(df.select(*keys, body), selectors, body, closest)
    every = F.col("elements")
    rows = F.transform(
        F.filter(every, lambda e: e["kept"]),
        lambda e: F.struct(
            e["pos"].alias("pos"),
            e["tag"].alias("tag"),
            e["href"].alias("href"),
            e["text"].alias("text"),
            context_text(every, e).alias("context"),
            F.get(every, e["card_at"])["text"].alias("card_text"),
        ),
    )
    return parsed.select(*keys, F.inline(rows))


def first_n(df: DataFrame, n: int = 10, keys: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """First ``n`` rows per page. Spark prunes each map task to n rows per key before the shuffle."""
    keys = keys or ["snapshot_id"]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(pos))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def table_cells(body: Column) -> Column:
    """Rows (arrays of cell text) of the first table that have at least two cells."""
    rows = all_matches(F.regexp_extract(body, TABLE, 1), ROW)
    cells = F.transform(
        rows,
        lambda r: F.transform(all_matches(r, CELL), lambda c: tx.strip(tx.html_to_text(c, sep=""))),
    )
    return F.filter(cells, lambda r: F.size(r) >= 2)


def table_rows(df: DataFrame, body: str = "body", keys: list[str] | None = None) -> DataFrame:
    """(keys, row, cells) of the first table whose name and date cells are both filled."""
    keys = keys or ["snapshot_id"]
    out = df.select(*keys, F.posexplode(table_cells(F.col(body))).alias("row", "cells"))
    return out.filter((F.get("cells", F.lit(0)) != "") & (F.get("cells", F.lit(1)) != ""))


def time_value(body: Column) -> Column:
    """Value of the first time mark in document order: datetime, else content, else its text."""

    def value(mark: Column) -> Column:
        def told(opening: Column) -> Column:
            return F.coalesce(
                tx.attribute(opening, "datetime"),
                tx.attribute(opening, "content"),
                tx.blank_to_null(tx.html_to_text(mark, sep="")),
                tx.attribute(opening, "title"),
            )

        return once(F.regexp_extract(mark, tx.OPENING_TAG, 0), told)

    return once(F.regexp_extract(body, TIME_MARK, 0), value)


def time_elements(df: DataFrame, body: str = "body", keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["snapshot_id"]
    return df.select(*keys, time_value(F.col(body)).alias("value")).withColumn("event_at", any_date(F.col("value")))


def jsonld_date(body: Column, fields: list[str] | None = None, tz: str = "UTC") -> Column:
    """First parseable date of the page's structured-data blocks; broken blocks are skipped."""
    fields = fields or JSONLD_FIELDS
    dates = F.transform(
        all_matches(body, JSONLD, 1),
        lambda b: any_date(
            F.coalesce(*[F.nullif(F.get_json_object(b, f"$.{f}"), F.lit("")) for f in fields]), tz
        ),
    )
    return F.get(F.filter(dates, lambda d: d.isNotNull()), 0)


def jsonld_dates(df: DataFrame, body: str = "body", keys: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """(keys, pos, raw, event_at) per structured-data block of the untouched body."""
    keys = keys or ["snapshot_id"]
    fields = fields or JSONLD_FIELDS
    blocks = df.select(*keys, F.posexplode(all_matches(F.col(body), JSONLD, 1)).alias("pos", "block"))
    raw = F.coalesce(*[F.nullif(F.get_json_object("block", f"$.{f}"), F.lit("")) for f in fields])
    return blocks.select(*keys, "pos", raw.alias("raw")).withColumn("event_at", any_date(F.col("raw")))


def first_title(df: DataFrame, body: str = "body", keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["snapshot_id"]
    return df.select(*keys, tx.first_heading(F.col(body)).alias("title"))
