"""Small helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stage  # noqa: F401


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out before heavy work per row, where a table comes in fewer parts than there are cores."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text stays null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
