"""Base score and per-row gradient statistics of the logistic loss."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import CLAMP, clamp, logit
from tessera.operators.encoders import rate, weighted_rate
from tessera.sources.frame import LABEL, WEIGHT


def base_score_table(df: DataFrame) -> DataFrame:
    """One row: p0, the clamped rate of label 1, and s0, its log-odds."""
    one = df.agg(clamp(rate(df), CLAMP, 1 - CLAMP).alias("p0"))
    return one.select("p0", logit(F.col("p0")).alias("s0"))


def base_score(df: DataFrame) -> tuple[float, float]:
    p0 = min(max(weighted_rate(df), CLAMP), 1 - CLAMP)
    return math.log(p0 / (1 - p0)), p0


def with_gradients(df: DataFrame, p0: float) -> DataFrame:
    """df with g and h at the base score; they stay fixed while the tree grows."""
    return df.withColumn("g", F.col(WEIGHT) * (F.lit(p0) - F.col(LABEL))).withColumn("h", F.col(WEIGHT) * (p0 * (1 - p0)))
