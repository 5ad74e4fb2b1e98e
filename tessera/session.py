"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster, the cluster's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the folder named by spark.checkpoint.dir, which all
    executors share, so the rows survive the loss of an executor. Where a session names none, a
    local one (as in tests) gets a temporary folder; on a cluster this is an error."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut, but by Parquet files in that folder. A checkpoint keeps the plan's estimate of its size,
    which joins multiply, so that after some 20 rounds of joins with itself planning does not end."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python need not find it by itself."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(name)
    context._tessera_shipped = True
