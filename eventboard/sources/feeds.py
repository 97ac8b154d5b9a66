"""Feeds and JSON status documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions.dates import epoch_or_string, rfc822

ITEM = "title string, pubDate string, link string"
FEED = f"channel struct<item: array<struct<{ITEM.replace(' string', ': string')}>>>"
STATUS_PATH = "$.result.status_overall"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of feed files, one row each."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    return items.withColumn("event_at", rfc822(F.col("pubDate")))


def items_of(xml: Column) -> Column:
    """Array of a feed document's items in document order; NULL for anything that is not a feed."""
    return F.from_xml(xml, FEED)["channel"]["item"]


def feed_items(df: DataFrame, xml_col: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["snapshot_id"]
    rows = df.select(*keys, F.posexplode(items_of(F.col(xml_col))).alias("pos", "item"))
    flat = rows.select(*keys, "pos", "item.title", F.col("item.pubDate").alias("pub_date"), "item.link")
    return flat.withColumn("event_at", rfc822(F.col("pub_date")))


def status_of(json: Column) -> tuple[Column, Column]:
    """(status word, instant of its last change) of a status document; NULLs if it is unreadable."""
    doc = F.try_parse_json(json)
    updated = F.try_variant_get(doc, f"{STATUS_PATH}.updated", "variant")
    is_text = F.schema_of_variant(updated) == "STRING"
    number = F.when(~is_text, F.try_variant_get(updated, "$", "double"))
    text = F.when(is_text, F.try_variant_get(updated, "$", "string"))
    word = F.nullif(F.try_variant_get(doc, f"{STATUS_PATH}.status", "string"), F.lit(""))
    return F.coalesce(word, F.lit("unknown")), epoch_or_string(number, text)


def status_docs(df: DataFrame, json_col: str, keys: list[str] | None = None) -> DataFrame:
    word, at = status_of(F.col(json_col))
    return df.select(*(keys or ["snapshot_id"]), word.alias("status_word"), at.alias("event_at"))
