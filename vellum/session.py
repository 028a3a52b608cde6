"""Settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Chains of a whole corpus have more rows than the recursion's default limit."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark
