"""Sessions and plan inspection."""

from __future__ import annotations

import contextlib
import io
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", partitions: int = 8, memory: str = "8g", name: str = "meristem") -> SparkSession:
    """A local session with the settings that tests and benchmarks share. On a cluster, use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, wherever they run."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        top = os.path.join(folder, "top")
        shutil.copytree(package, os.path.join(top, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "meristem"), "zip", top))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage: in the checkpoint folder where one is set, else kept in memory and on disk."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def uses(df: DataFrame, node: str) -> bool:
    return node in plan_text(df)
