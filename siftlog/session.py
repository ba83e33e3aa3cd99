"""Session settings, the shared folder and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_drops: dict[str, int] = {}


def build_session(app_name: str = "siftlog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the one SQL option that results depend on: times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, from `spark.checkpoint.dir`.

    A temporary folder stands in for it in local mode only, where driver and
    executors are one process.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="siftlog-")
    return _local_dirs[context.applicationId]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/siftlog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder, one folder per value of `folders`, and read it back.

    Cuts the lineage: what follows survives a lost executor without repeating
    the work before it.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove all tables that this application has staged; results that were not read or written yet go with them."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siftlog/{context.applicationId}")
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    _drops[context.applicationId] = times_dropped(spark) + 1


def times_dropped(spark: SparkSession) -> int:
    """How often the staged tables were removed: what is kept across calls goes by it."""
    return _drops.get(spark.sparkContext.applicationId, 0)


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a part of a plain scan that has fewer parts than there are cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
