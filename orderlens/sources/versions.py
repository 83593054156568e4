"""Versions of a folder of tables: all tables of a build are written to a folder of their own,
and one appended row makes them the current ones.

Readers take the folder of the newest published row. Until that row is there they read the
version before, whole; a build that fails leaves a folder that nobody reads. Both the tables and
the row are written by Spark, so any store that Spark can write to will do.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "published"
SCHEMA = "number long, folder string, published_at timestamp"


def new_folder(path: str) -> str:
    """Where a build writes; it is not read before it is published."""
    return f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"


def published(spark: SparkSession, path: str) -> DataFrame:
    """The versions in order: number, folder, published_at."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/{PUBLISHED}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows.orderBy("number", "published_at", "folder")


def current(spark: SparkSession, path: str) -> str:
    """Folder of the newest published version."""
    last = published(spark, path).orderBy(F.desc("number"), F.desc("published_at"), F.desc("folder")).first()
    if last is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return f"{path.rstrip('/')}/{last.folder}"


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Make ``folder`` the current version: one row in one file, which appears at once."""
    last = published(spark, path).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    row = spark.range(1).select(
        F.lit(last + 1).cast("long").alias("number"),
        F.lit(folder.rstrip("/").rsplit("/", 1)[1]).alias("folder"),
        F.current_timestamp().alias("published_at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{PUBLISHED}")
