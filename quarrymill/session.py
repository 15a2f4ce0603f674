"""Session settings, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None


def get_spark(app: str = "quarrymill", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; columns and filters of the caller are pushed into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset and Spark runs in this process
    (tests), a folder of this machine. On a cluster without the setting this is an error."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quarrymill-")
    return f"file://{_own_dir}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        _delete(spark, path)
    if _own_dir:
        import shutil

        shutil.rmtree(_own_dir, ignore_errors=True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and lost executors cost nothing that was done before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrymill/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut made and nothing reads any more."""
    _delete(df.sparkSession, df._cut_path)
    _made.remove((df.sparkSession, df._cut_path))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended: its cleaner follows the driver's garbage collection.

    The query that ended last stays referenced until another job has run."""
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()
