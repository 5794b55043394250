"""Session helpers shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, app: str = "tickloom") -> SparkSession:
    """A local session with the settings the operators are tested with (UTC, adaptive execution)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, whatever folder the driver was started in. On a cluster
    the package is shipped, and a path that isn't there does no harm."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; only Spark's reader touches the path."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Where that is unset, a temporary one if all executors
    are on this machine (tests); on a cluster executors would each write to a disk of their own, so that's an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(spark, "_tickloom_dir", None)
        if not path:
            path = spark._tickloom_dir = tempfile.mkdtemp(prefix="tickloom-")
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df`: write it as a table in the shared folder and read it back.

    Parquet rather than an RDD checkpoint, so later scans still prune columns and push filters down. A lost
    executor costs nothing: the files are in the shared folder, not in an executor. They go when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folder(spark, path, lambda fs, folder: fs.deleteOnExit(folder))
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str, use) -> None:
    """`use` of the file system of a path, and the path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    use(folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by `cut` before the session ends (used between iterations)."""
    for file in df.inputFiles()[:1]:
        _folder(spark, file.rsplit("/", 1)[0], lambda fs, folder: fs.delete(folder, True))
