"""Sessions, table loading and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "tesselite", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` adds or overrides settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that setting is empty and all runs on this machine (tests, a laptop) is a folder of it made and used;
    on a cluster the executors could not share it, so an empty setting is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            at = current.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            at = "file://" + tempfile.mkdtemp(prefix="tesselite-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Remove a path; of no account if the session is over."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is gone already
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tesselite/{name}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` into the shared folder and read it back: the lineage ends there, and the table outlives any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
