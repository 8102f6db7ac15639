"""Session helpers: a local session for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "audira", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, no web page)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only a local session may go without: it gets a temporary folder. Elsewhere a folder of one machine would lose data.
    """
    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if folder is None and sc.getCheckpointDir() is None and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="audira-checkpoint-"))
    return folder or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder once, so that every later reader sees the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store_rows(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder as compressed columns: computed once, but not kept in their partitions."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/audira-rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
