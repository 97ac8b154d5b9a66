"""Result records: JSON in both shapes on the way in, live and last-known-good tables on the way out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions.dates import any_date, iso_out
from eventboard.operators.resolve import newest_per_key
from eventboard.schemas import KEY, LIVE, columns
from eventboard.sources import versions as vs

# The fields of a result record; every other field is an extra.
RECORD = (
    "provider_id string, game string, type string, title string, status string, nextEventUtc string,"
    " fetched_at_utc string, last_success_at_utc string, source_url string, confidence string, notes string,"
    " reason string, failure_type string, explanation string, http_status int, fetch_mode string,"
    " lastUpdatedUtc string, source struct<name:string, url:string>"
)
FIELDS = [
    "provider_id", "game", "type", "title", "status", "nextEventUtc", "fetched_at_utc", "last_success_at_utc",
    "source_url", "confidence", "notes", "reason", "failure_type", "explanation", "http_status", "fetch_mode",
    "lastUpdatedUtc", "source",
]
BUCKETS = 64


def parse_results(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Records of a JSON text column; unreadable ones and those without a status leave no row."""
    record, every = F.from_json(json_col, RECORD), F.from_json(json_col, "map<string,string>")
    extras = F.map_filter(every, lambda k, v: ~k.isin(FIELDS))
    rest = [c for c in df.columns if c != json_col]
    parsed = df.select(*rest, record.alias("r"), extras.alias("extras"))
    return parsed.filter(F.col("r.status").isNotNull()).select(*rest, "r.*", "extras")


def read_results(spark: SparkSession, path: str, lines: bool = False, nested: bool = False) -> DataFrame:
    """Records from JSON files (one each, or one per line); a missing path reads as no records.

    ``nested`` looks into folders, as ``write_documents`` leaves them.
    """
    try:
        text = spark.read.text(path, wholetext=not lines, recursiveFileLookup=nested)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        text = spark.createDataFrame([], "value string")
    return parse_results(text)


def _filled(*choices: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def normalize_results(df: DataFrame) -> DataFrame:
    """Old and new record shapes in the columns of the live table, plus the source's label."""
    fields = {
        "run_id": F.lit(None).cast("string"),
        "source_id": _filled(F.col("game"), F.col("provider_id")),
        "event_type": F.col("type"),
        "title": F.col("title"),
        "status": F.col("status"),
        "event_at": any_date(F.col("nextEventUtc")),
        "source_url": _filled(F.col("source_url"), F.col("source.url")),
        "confidence": F.col("confidence"),
        "notes": F.col("notes"),
        "http_status": F.col("http_status"),
        "fetch_mode": F.col("fetch_mode"),
        "failure_type": F.col("failure_type"),
        "explanation": F.col("explanation"),
        "fetched_at": any_date(_filled(F.col("fetched_at_utc"), F.col("lastUpdatedUtc"))),
        "last_success_at": any_date(F.col("last_success_at_utc")),
        "reason": F.col("reason"),
        "extras": F.col("extras"),
    }
    label = F.coalesce(
        _filled(F.try_element_at("extras", F.lit("sourceName")), F.col("title"), F.col("source.name")),
        F.lit("Official Source"),
    )
    return df.select(*[fields[c].alias(c) for c in columns(LIVE)], label.alias("source_label"))


def to_result_json(live: DataFrame) -> DataFrame:
    """(path, json) per live row: absent optional fields are left out, explicit nulls stay."""
    event = F.when(F.col("status") != "unavailable", iso_out(F.col("event_at")))
    stale, down = F.col("status") == "stale", F.col("status") == "unavailable"
    body = F.to_json(
        F.struct(
            F.col("source_id").alias("provider_id"),
            F.col("source_id").alias("game"),
            F.col("event_type").alias("type"),
            "title",
            "status",
            event.alias("nextEventUtc"),
            iso_out(F.col("fetched_at")).alias("fetched_at_utc"),
            F.when(~down, iso_out(F.col("last_success_at"))).alias("last_success_at_utc"),
            F.when(~down, F.col("source_url")).alias("source_url"),
            F.when(~down, F.col("confidence")).alias("confidence"),
            F.when(~down, F.col("notes")).alias("notes"),
            F.when(stale, F.col("reason")).alias("reason"),
            F.when(down, F.col("failure_type")).alias("failure_type"),
            F.when(down, F.col("explanation")).alias("explanation"),
            "http_status",
            "fetch_mode",
        ),
        {"ignoreNullFields": "true"},
    )
    null_event = F.create_map(F.lit("nextEventUtc"), F.lit(None).cast("string"))
    open_fields = F.when(down, null_event).when(F.size("extras") > 0, F.col("extras"))
    tail = F.to_json(open_fields, {"ignoreNullFields": "false"})
    joined = F.concat(F.regexp_replace(body, r"\}$", ","), F.regexp_replace(tail, r"^\{", ""))
    return live.select(
        F.concat_ws(".", "source_id", "event_type", F.lit("json")).alias("path"),
        F.coalesce(joined, body).alias("json"),
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")


def read_records(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table written by ``write_live`` / ``write_lkg``, as it is now or was at a version; empty if it does not exist.

    The rows stay those of that version, however often the table is written meanwhile.
    """
    return vs.read(spark, path, LIVE, vs.manifest(spark, path, version))


#: How often a write starts again because another one was published first.
ATTEMPTS = 5


def _replace(df: DataFrame, path: str, buckets: int | None, newest: bool) -> None:
    """Put one record per key in place of the key's old one; other keys survive.

    ``newest`` keeps the stored record where it is newer than the given one. Keys are hashed into a
    fixed number of buckets, so millions of sources do not become millions of directories. The number
    belongs to the table, and another one is refused, since a key would then have two places. Each
    touched bucket is written anew with its untouched keys, as the next version of the table.
    """
    spark = df.sparkSession
    given = newest_per_key(df.select(*columns(LIVE)))
    for attempt in range(1, ATTEMPTS + 1):
        of = vs.manifest(spark, path)
        if of.buckets and buckets not in (None, of.buckets):
            raise ValueError(f"{path} has {of.buckets} buckets, not {buckets}")
        number = of.buckets or buckets or BUCKETS
        new = given.withColumn("bucket", _bucket(number))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # the table's number of buckets at most
        if not touched:
            return
        kept = vs.read(spark, path, LIVE, of, touched)
        if newest:
            both = kept.withColumn("given", F.lit(0)).unionByName(new.withColumn("given", F.lit(1)))
            records = newest_per_key(both, tie=["run_id", "given"]).drop("given")
        else:
            records = kept.join(new.select(*KEY), KEY, "left_anti").unionByName(new)
        try:
            vs.write(records, path, of, number, touched)
            return
        except vs.VersionConflict:
            if attempt == ATTEMPTS:
                raise


def write_live(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """The live table: the newest record of every key in ``df``, whatever its status."""
    _replace(df, path, buckets, newest=False)


def write_lkg(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """The last-known-good table: only fresh records are accepted, and an older one never replaces a newer one."""
    _replace(df.filter(F.col("status") == "fresh"), path, buckets, newest=True)


def write_history(df: DataFrame, path: str) -> None:
    """All live rows by run; writing a run again replaces that run only."""
    writer = df.select(*columns(LIVE)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def write_json(live: DataFrame, path: str) -> None:
    """The records as JSON lines, each with the ``path`` of its own document as first field."""
    key = F.regexp_replace(F.to_json(F.struct("path")), r"\}$", ",")
    lines = to_result_json(live).select(F.concat(key, F.substring("json", 2, 1 << 30)).alias("value"))
    lines.write.mode("overwrite").text(path)
