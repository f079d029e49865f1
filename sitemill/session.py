"""The session that tests, the bench and local work use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with adaptive execution and UTC. On a cluster the
    submitter's own settings are used and this is not called."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("sitemill").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
