"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, as in
local tests, a temporary folder of this machine is used; a master other than local
has no such default.  ``release`` deletes tables that nothing reads any more; what a
result still reads lies there until the owner of the folder clears it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from termloom.shipping import ship


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
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``stored``; only for those that no result reads any more."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the workers first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
