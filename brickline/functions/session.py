"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's checkpoint folder.

    It cuts the lineage for recovery and keeps the optimiser from copying large
    expressions into every place that refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table of the shared folder and read from there: for rows that several
    joins take other columns of, each of which would compute and shuffle them anew."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df's rows, dealt evenly to a few tasks a core.  A table of short rows is one file, or one row
    group, and so one task, whatever its rows cost."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local master
    (a laptop, tests) may name none: a folder of this machine is made then."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="brickline-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")
