"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Clusters that install it, or name it on ``PYTHONPATH``, find the same code.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def shared(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. Only a local master may do without ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder by columns, and read from there: its plan is cut, and readers take only the columns they need."""
    folder = f"{shared(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def near(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A written frame, broadcast in joins where it has at most this many rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= most else df
