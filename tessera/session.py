"""Sessions with the settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: AQE resizes partitions, splits skewed ones and turns joins into broadcasts where a side's measured size allows it.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tessera", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=DEFAULTS | conf).getOrCreate()
