"""Decisions of the model-bound detectors from counts that a model elsewhere has produced. The models themselves are not part of the engine."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z >= z) of the standard normal distribution."""
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)) if pd.notna(v) else None)


def kgw_verdict(counts: DataFrame, green: str = "green", scored: str = "scored", gamma: float = C.KGW_GAMMA) -> DataFrame:
    """Adds z_score, p_value, confidence and status to rows of green and scored token counts."""
    n = F.col(scored)
    z = (F.col(green) - gamma * n) / F.sqrt(n * gamma * (1 - gamma))
    out = counts.withColumn("z_score", F.when(n > 0, z)).withColumn("p_value", normal_tail("z_score"))
    status = F.when(F.col("z_score").isNull() | (n < C.KGW_MIN_TOKENS), "uncertain").when(F.col("z_score") >= C.KGW_Z_DETECTED, "detected").when(F.col("z_score") < C.KGW_Z_CLEAN, "clean").otherwise("uncertain")
    return out.withColumn("confidence", 1 - F.col("p_value")).withColumn("status", status)


def synthid_verdict(scores: DataFrame, thresholds: dict[int, float], posterior: str = "posterior", scored: str = "scored") -> DataFrame:
    """Adds bucket, threshold and status: the threshold of the largest evaluated length not above the scored one (or the smallest length)."""
    sizes = sorted(thresholds)
    bucket: Column = F.lit(sizes[0])
    limit: Column = F.lit(float(thresholds[sizes[0]]))
    for n in sizes[1:]:
        bucket = F.when(F.col(scored) >= n, F.lit(n)).otherwise(bucket)
        limit = F.when(F.col(scored) >= n, F.lit(float(thresholds[n]))).otherwise(limit)
    p = F.col(posterior)
    # later, larger lengths come first in the chain
    status = F.when(F.col(scored) < C.SYNTHID_MIN_TOKENS, "uncertain").when(p >= F.col("threshold"), "detected").when(p < C.SYNTHID_CLEAN_BELOW, "clean").otherwise("uncertain")
    return scores.withColumn("bucket", bucket).withColumn("threshold", limit).withColumn("status", status)
