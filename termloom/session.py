"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Adaptive execution, UTC and Kryo; on a cluster leave ``shuffle_partitions`` high and
    let adaptive execution merge small partitions."""
    b = SparkSession.builder.master(master).appName("termloom")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
