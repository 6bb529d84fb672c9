"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset, as in
local tests, one is made on this machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """A new, unused path in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/termloom/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back: lineage ends there, and the
    table survives the loss of any executor."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``df`` with the rank of each row in its group from 1, ties in any order; a group is sorted by many tasks."""
    rows = stored(df.orderBy(group, order).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    runs = rows.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))  # a row for each group and task
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    runs = runs.select(group, "_part", "_first", before.alias("_before"))
    return rows.join(F.broadcast(runs), [group, "_part"]).withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1).drop("_id", "_part", "_first", "_before")
