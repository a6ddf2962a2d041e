"""Cutting lineage: tables in the shared checkpoint folder that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    It is the session's ``spark.checkpoint.dir``. Only where none is set, in local runs and
    tests, is a scratch folder taken; on a cluster that raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tallyhouse-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the checkpoint folder.

    They survive lost executors, and the plan behind them is not run again.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a table of their own in the checkpoint folder, of known size.

    After ``cut`` Spark goes on with the size it guessed for the plan behind the rows. For a
    join that is the product of both sides, so in a loop of joins the number itself grows until
    it fills the driver. Tables stay until the folder's owner clears them: for small ones.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
