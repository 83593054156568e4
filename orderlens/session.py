"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on. A hot product, customer or order key is split by
# AQE even where the split costs one more shuffle behind the join.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# What a task reads of a shuffle at most. Rows take about ten times their compressed size in sorts
# and hash tables, several of which a task holds at once: Spark's 64 MB would be a gigabyte.
TASK_INPUT = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SPARKS_TASK_INPUT, OUR_TASK_INPUT = "67108864b", "16m"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def small_tasks(spark: SparkSession) -> SparkSession:
    """Tasks of 16 MB, unless the session names a size of its own."""
    if spark.conf.get(TASK_INPUT) == SPARKS_TASK_INPUT:
        spark.conf.set(TASK_INPUT, OUR_TASK_INPUT)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one spark-submit gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orderlens")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def staging_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A session that names none, such as a local one, stages below
    its warehouse, which all its executors reach as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that later steps neither recompute it nor see
    other values after an executor is lost. Spark deletes the files once nothing refers to
    them, if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(staging_dir(df.sparkSession))
    return df.checkpoint()
