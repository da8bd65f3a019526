"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "fundlens", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster passes in its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_fundlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="fundlens-code-"), "fundlens")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "fundlens"))
    sc._fundlens_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on a stored table of few file splits.

    A large table has more splits than the cluster has cores and is returned as it is; only a table
    of fewer splits, which is small for that cluster, is redistributed. For plain scans only: the
    plan must have no shuffle, since asking for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without that setting falls back to a temporary folder; on a cluster the
    setting is required because executors do not share the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = os.environ.get("FUNDLENS_LOCAL_SCRATCH") or tempfile.mkdtemp(prefix="fundlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_dir(spark: SparkSession) -> str:
    """The application's own folder inside the shared folder."""
    return f"{shared_dir(spark)}/fundlens-{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def close_run(spark: SparkSession) -> None:
    """Delete what this application has written with ``materialize``."""
    fs, path = file_system(spark, run_dir(spark))
    fs.delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back.

    The files survive the loss of executors, and later jobs read only the columns they need.
    """
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
