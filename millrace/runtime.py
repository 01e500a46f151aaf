"""Session-level helpers: reading tables, cutting lineage in shared storage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}  # the folders live as long as the driver


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; Spark's file server hands it out."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED[sc.applicationId] = d = tempfile.TemporaryDirectory()
    src = os.path.join(d.name, "src")
    shutil.copytree(os.path.dirname(os.path.abspath(__file__)), os.path.join(src, "millrace"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(d.name, "millrace"), "zip", src))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a single machine) a local folder is made, and refused on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "millrace-checkpoints")
        os.makedirs(named, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Unlike a local checkpoint the result survives the loss of any executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
