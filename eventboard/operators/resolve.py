"""Freshness: every source in every run is fresh, stale (last good record carried) or unavailable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.functions.predicates import failure_type, fetch_ok
from eventboard.operators.carry import carry_forward
from eventboard.schemas import CARRIED, KEY, LIVE, columns

# Explanations of a failed run.
CRASHED = "Crashed: "
NO_RESULT = "Provider returned invalid/empty result"
UNKNOWN = "Unknown failure"


def classify_fetch(df: DataFrame) -> DataFrame:
    """Add ``ok`` and ``failure_type`` to page loads."""
    return df.withColumns(
        {
            "ok": fetch_ok(F.col("http_status")),
            "failure_type": failure_type(F.col("http_status"), F.col("fetch_mode")),
        }
    )


def newest_per_key(
    df: DataFrame, keys: list[str] | None = None, at: str = "fetched_at", tie: list[str] | None = None
) -> DataFrame:
    """One row per key, combined on the map side; equal times are decided by ``tie`` (run id)."""
    keys = keys or KEY
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(at, *(tie or [c for c in ("run_id",) if c in df.columns]))
    best = F.max_by(F.struct(*rest), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def every_source(registry: DataFrame, obs: DataFrame, run_id: str | None = None, run_at=None) -> DataFrame:
    """One row per registry entry of one run; an entry without an observation becomes a failure.

    ``run_id`` and ``run_at`` fill the rows of entries that reported nothing.
    """
    joined = registry.select(*KEY, "name", "ord").join(newest_per_key(obs), KEY, "left")
    at = F.lit(str(run_at) if run_at else None).cast("timestamp_ntz")
    return _with_missing(joined.withColumn("run_id", F.coalesce("run_id", F.lit(run_id))), at)


def every_run(registry: DataFrame, obs: DataFrame, runs: DataFrame | None = None, tie: str = "run_id") -> DataFrame:
    """One row per run and registry entry, so a source that stops reporting stays visible in every later run.

    ``runs(run_id, run_at)`` are the runs that were due; without it, those that left any observation, at the
    instant of their last one. A run's newest observation of an entry counts. The result has as many rows as
    runs times entries, which is what is asked for; observations are combined before they meet them.
    """
    if runs is None:
        runs = obs.groupBy("run_id").agg(F.max("fetched_at").alias("run_at"))
    due = runs.select("run_id", "run_at").crossJoin(registry.select(*KEY, "name", "ord"))
    keys = ["run_id", *KEY]
    joined = due.join(newest_per_key(obs, keys, tie=[tie]), keys, "left")
    return _with_missing(joined, F.col("run_at")).drop("run_at")


def _with_missing(joined: DataFrame, at: Column) -> DataFrame:
    """Registry entries with their observation; those without one become failures at ``at``."""
    missing = F.col("ok").isNull()
    return joined.withColumns(
        {
            "title": F.coalesce("title", "name"),
            "fetched_at": F.coalesce("fetched_at", at),
            "failure_type": F.when(missing, "unavailable").otherwise(F.col("failure_type")),
            "explanation": F.when(missing, CRASHED + NO_RESULT).otherwise(F.col("explanation")),
            "ok": F.coalesce("ok", F.lit(False)),
        }
    )


def good_record(source: str = "") -> Column:
    """What a later failed run inherits: the carried fields and the time of the success."""
    prefix = f"{source}." if source else ""
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in [*CARRIED, "fetched_at"]])


def attach_lkg(obs: DataFrame, lkg: DataFrame) -> DataFrame:
    """Left join each row's last known good record as a struct; only fresh records count."""
    fresh = lkg.filter(F.col("status") == "fresh").select(*KEY, good_record().alias("lkg"))
    return obs.join(fresh, KEY, "left")


def settle(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Decide the status of rows that carry ``lkg`` and (optionally) the registry's ``name``."""
    ok, has = F.col("ok"), F.col("lkg").isNotNull()
    name = F.coalesce("name", "title") if "name" in df.columns else F.col("title")
    out = {c: F.when(ok, F.col(c)).when(has, F.col(f"lkg.{c}")) for c in CARRIED}
    # A failed load still reports how it was made.
    for c in ("http_status", "fetch_mode"):
        out[c] = F.when(~ok & has, F.col(f"lkg.{c}")).otherwise(F.col(c))
    out |= {
        "status": F.when(ok, "fresh").when(has, "stale").otherwise("unavailable"),
        "title": F.when(ok, F.col("title")).otherwise(name),
        "failure_type": F.when(~ok, F.coalesce("failure_type", F.lit("unavailable"))),
        "explanation": F.when(~ok, F.coalesce("explanation", F.lit(UNKNOWN))),
        "last_success_at": F.when(ok, F.col("fetched_at")).when(has, F.col("lkg.fetched_at")),
        "reason": F.when(~ok & has, F.coalesce("explanation", F.lit(UNKNOWN))),
    }
    return df.select(*(keep or []), *[out[c].alias(c) if c in out else F.col(c) for c in columns(LIVE)])


def resolve(obs: DataFrame, lkg: DataFrame, registry: DataFrame, run_id: str | None = None, run_at=None) -> DataFrame:
    """One run: registry-complete live rows."""
    return settle(attach_lkg(every_source(registry, obs, run_id, run_at), lkg), keep=["ord"])


def resolve_history(
    obs: DataFrame,
    lkg: DataFrame | None = None,
    tie: str = "run_id",
    keep: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Every run of every source at once: the last good record before each failed run is carried.

    ``lkg`` gives records from before the first run; ``keep`` names extra columns to pass through.
    """
    rows = obs if lkg is None else _with_seeds(obs, lkg)
    carried = carry_forward(rows, KEY, "fetched_at", tie, F.col("ok"), good_record(), "lkg", slices)
    return settle(carried if lkg is None else carried.filter(~F.col("_seed")), keep)


def _with_seeds(obs: DataFrame, lkg: DataFrame) -> DataFrame:
    """Earlier good records put into the timeline at their own time, marked ``_seed``.

    Being rows like all others, they need no join on a possibly hot source, and a late row cannot
    inherit from its own future.
    """
    known = columns(LIVE)
    fields = {
        c: F.col(c) if c in known else F.lit(None).cast(obs.schema[c].dataType) for c in obs.columns
    } | {"ok": F.lit(True)}
    seeds = lkg.filter(F.col("status") == "fresh").select(*[fields[c].alias(c) for c in obs.columns])
    return obs.withColumn("_seed", F.lit(False)).unionByName(seeds.withColumn("_seed", F.lit(True)))


def resolve_latest(obs: DataFrame, tie: str = "run_id", keep: list[str] | None = None) -> DataFrame:
    """Where every source stands now: the last row of its history without computing the history.

    Newest observation and newest good record are both aggregates, so one pass with map-side
    combination replaces the window.
    """
    order = F.struct("fetched_at", tie)
    rest = [c for c in obs.columns if c not in KEY]
    newest = obs.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), order).alias("_now"),
        F.max_by(good_record(), F.when(F.col("ok"), order)).alias("lkg"),
    )
    return settle(newest.select(*KEY, "_now.*", "lkg"), keep)


def lkg_as_of(obs: DataFrame, tie: str = "run_id", slices: int | None = None) -> DataFrame:
    """Observations with the record that was last known good when each of them was made."""
    return carry_forward(obs, KEY, "fetched_at", tie, F.col("ok"), good_record(), "lkg", slices)


def fresh_records(obs: DataFrame) -> DataFrame:
    """Successful observations in the shape of the last-known-good table."""
    return settle(obs.filter("ok").withColumn("lkg", F.lit(None).cast(_good_type(obs))))


def _good_type(obs: DataFrame) -> str:
    fields = [f"{c}:{obs.schema[c].dataType.simpleString()}" for c in [*CARRIED, "fetched_at"]]
    return f"struct<{','.join(fields)}>"


def update_lkg(lkg: DataFrame, live: DataFrame) -> DataFrame:
    """Newest fresh record per key; stale rows never get in and nothing expires."""
    fresh = live.filter(F.col("status") == "fresh").select(*columns(LIVE))
    return newest_per_key(lkg.select(*columns(LIVE)).unionByName(fresh))


def status_counts() -> list[Column]:
    """Rows of a run, all and by status."""
    status = F.col("status")
    by = [F.count_if(status == s).alias(s) for s in ("fresh", "stale", "unavailable")]
    return [F.count(F.lit(1)).alias("total"), *by]


def with_verdict(summary: DataFrame, limit: float) -> DataFrame:
    ratio = F.coalesce(F.try_divide(F.col("unavailable"), F.col("total")), F.lit(0.0))
    return summary.withColumn("failure_ratio", ratio).withColumn("failed", F.col("failure_ratio") > limit)


def run_summary(live: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return live.groupBy(*(keys or ["run_id"])).agg(*status_counts())


def health_gate(live: DataFrame, limit: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Run summary with the failure ratio and verdict; ``keys=[]`` judges the table as one run."""
    keys = ["run_id"] if keys is None else keys
    return with_verdict(run_summary(live, keys) if keys else live.agg(*status_counts()), limit)


def unavailable_list(live: DataFrame, registry: DataFrame) -> DataFrame:
    """Unavailable sources with their explanation, in registry order."""
    down = live.filter(F.col("status") == "unavailable").select("run_id", *KEY, "title", "explanation")
    return down.join(registry.select(*KEY, "ord"), KEY).orderBy("run_id", "ord")
