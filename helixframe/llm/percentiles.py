"""Percentiles with a guaranteed relative error, from mergeable logarithmic bucket counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ALPHA = 0.01


def sketch(df: DataFrame, keys: Sequence[str], value: Column, alpha: float = ALPHA) -> DataFrame:
    """Bucket counts: keys, sign (-1, 0, 1), bucket, n.

    A value v falls into bucket ceil(log_g |v|) of its sign with g = (1 + alpha) / (1 - alpha). The
    number of buckets depends on the range of values only: 32-bit integers have at most 2 * 1075 at
    alpha = 0.01. Counts are summed before they are sent, so hot keys cost no more than others.
    Null, NaN and infinite values are left out; null keys are keys; an empty table gives no rows.
    """
    v = value.cast("double")
    d = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    a = F.abs("__v")
    bucket = F.when(a > 0, F.ceil(F.ln(a) / F.lit(math.log((1 + alpha) / (1 - alpha))))).otherwise(0)
    return d.groupBy(*keys, F.signum("__v").cast("int").alias("sign"), bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def combine(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the matching buckets of sketches of one alpha: over partitions, days or any set of them."""
    return sketches.groupBy(*keys, "sign", "bucket").agg(F.sum("n").cast("bigint").alias("n"))


def percentiles(sketches: DataFrame, keys: Sequence[str], permille: Sequence[int], alpha: float = ALPHA) -> DataFrame:
    """For each key: n, one column p<permille> each, and relative_error (alpha).

    The percentile q of n values is the ceil(q * n)-th smallest (at least the first). The estimate is
    2 g^b / (g + 1) of its bucket b and differs from the exact value by at most alpha times that value.
    """
    g = (1 + alpha) / (1 - alpha)
    rank = F.col("sign") * (F.col("bucket") + (1 << 40))  # ascending by value: large negatives first
    w = W.partitionBy(*keys).orderBy("__o").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    s = sketches.withColumn("__o", rank).withColumn("__c", F.sum("n").over(w)).withColumn("__n", F.sum("n").over(whole))
    est = F.col("sign") * F.lit(2.0) * F.pow(F.lit(g), F.col("bucket")) / F.lit(g + 1)
    cols = []
    for p in permille:
        want = F.greatest(F.lit(1), F.floor((F.col("__n") * p + 999) / 1000))
        cols.append(F.min_by(est, F.when(F.col("__c") >= want, F.col("__c"))).alias(f"p{p}"))
    return s.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"), *cols).withColumn("relative_error", F.lit(alpha))
