"""Readers of fact tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder that the cluster names; a local one only where none is set and the master is local."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="trivium-checkpoints-")
        context.setCheckpointDir(folder)
