"""Cutting the lineage of iterative plans in storage that survives lost executors.

``cut`` writes plain Parquet.  ``dealt`` writes a table in buckets of some
columns: whoever joins or groups by them reads it without a shuffle, and a join
with another table moves that table only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a session whose executors run on this machine gets a local folder
    where none is named; any other fails.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pathloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """Buckets of a dealt table: as many as a shuffle has partitions, so that both meet."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str, spread: bool = True) -> DataFrame:
    """``df`` written once in buckets of ``keys`` and read back.

    The files lie in the shared folder, the session's catalog has their bucket
    numbers.  ``spread`` shuffles by the keys before; False where rows come
    spread like that, as out of a group by them.
    """
    spark = df.sparkSession
    n, name = buckets(spark), f"dealt_{uuid.uuid4().hex}"
    rows = df.repartition(n, *keys) if spread else df
    rows.write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, *keys).saveAsTable(name)
    return spark.table(name)
