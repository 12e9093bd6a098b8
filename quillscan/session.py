"""Small helpers around the session: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without the setting gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillscan-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


SMALL_PART = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of texts over all cores, where the input is too small to come in enough parts of its own.

    An input of more than ``SMALL_PART`` bytes a core stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_PART else df
