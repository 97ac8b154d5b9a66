"""Code and tables that executors share: the package travels with the job, long lineages are cut by stored tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import eventboard
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, for workers that cannot import it themselves."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(eventboard.__file__).parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="eventboard-code-")), "eventboard.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


#: Rows of an Arrow batch. Rows here hold whole texts or shingle sets, so the default of 10,000 is too many.
BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` of a function that uses this package, in batches of at most ``BATCH_ROWS`` rows."""
    spark = df.sparkSession
    ship(spark)
    if not 0 < int(spark.conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``; only a local session may be without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="eventboard-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: lost executors cost only the reading task."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
