"""First or sampled rows of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_k_per_group(df: DataFrame, k: int, group: str = "year", order: str = "path_original") -> DataFrame:
    w = W.partitionBy(group).orderBy(F.asc_nulls_last(order))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def sample_k_per_group(df: DataFrame, k: int, seed: int = 42, group: str = "year", key: str = "id") -> DataFrame:
    """k rows of each group, all where there are fewer; the same ones for the same seed and keys."""
    w = W.partitionBy(group).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
