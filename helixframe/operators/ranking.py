"""Exact ranks and carries over groups of any size, without putting a group into one task.

Each helper works in two levels: a window inside a bounded bucket of a group, and a prefix
over the bucket totals, which are few. No task ever sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def prefix_over_buckets(totals: DataFrame, group: Sequence[str], bucket: str, sums: Sequence[str]) -> DataFrame:
    """For each (group, bucket) the sums over all earlier buckets of the group, as `before_<sum>`.

    `totals` holds one row per (group, bucket), so a group has as many rows as it has buckets.
    """
    w = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*group, bucket, *(F.coalesce(F.sum(s).over(w), F.lit(0).cast("bigint")).alias(f"before_{s}") for s in sums))


def key_layout(counts: DataFrame, keys: Sequence[str], block: str, n: str = "n", buckets: int = 4096) -> DataFrame:
    """Start offset of every (key, block) when rows lie key after key, block after block.

    Keys are spread over a fixed number of hash buckets; each bucket is laid out by a window and
    the buckets follow one another by a prefix over `buckets` totals (a fixed, small table).
    Gives keys, block, `start` (0-based) and `n`.
    """
    c = counts.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    totals = c.groupBy("__b").agg(F.sum(n).cast("bigint").alias("__t")).withColumn("__g", F.lit(0))
    base = prefix_over_buckets(totals, ["__g"], "__b", ["__t"]).select("__b", "before___t")
    w = W.partitionBy("__b").orderBy(*keys, block).rowsBetween(W.unboundedPreceding, -1)
    inner = c.withColumn("__i", F.coalesce(F.sum(n).over(w), F.lit(0)))
    # at most `buckets` rows of two longs: the bound makes this broadcast safe at any input size
    return inner.join(F.broadcast(base), "__b").select(*keys, block, (F.col("__i") + F.col("before___t")).cast("bigint").alias("start"), F.col(n).cast("bigint").alias("n"))


def null_safe(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the columns in `on` come out once (from the left)."""
    r = b.select(*(F.col(c).alias(f"__r_{c}") for c in on), *(c for c in b.columns if c not in on))
    cond = None
    for c in on:
        e = a[c].eqNullSafe(r[f"__r_{c}"])
        cond = e if cond is None else cond & e
    return a.join(r, cond, how).drop(*(f"__r_{c}" for c in on))


def last_known(df: DataFrame, group: Sequence[str], order: str, value: Column, out: str, span: int = 1 << 16) -> DataFrame:
    """`out`: the latest non-null `value` at or before each row of its group, by the integer `order`.

    Rows are taken in buckets of `span` order values; the last value of each bucket is carried
    into the following ones by a window over the bucket table only. A null order sorts first.
    """
    b = df.withColumn("__v", value).withColumn("__b", F.floor(F.col(order) / span).cast("bigint"))
    w = W.partitionBy(*group, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    inner = b.withColumn("__in", F.last("__v", ignorenulls=True).over(w))
    lasts = b.groupBy(*group, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__last"))
    wb = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carry = lasts.select(*group, "__b", F.last("__last", ignorenulls=True).over(wb).alias("__carry"))
    j = null_safe(inner, carry, [*group, "__b"], "left")
    return j.withColumn(out, F.coalesce("__in", "__carry")).drop("__v", "__b", "__in", "__carry")


def ordinal_in_key(df: DataFrame, keys: Sequence[str], block: Column, at: str, out: str = "ordinal") -> DataFrame:
    """`out`: 0-based exact position of each row within its key, by block and then by `at`.

    Counts per (key, block) are prefix-summed per key and rows are numbered within (key, block), so a
    key of any size is spread over its blocks. `at` must be unique within a block for a stable result.
    """
    d = df.withColumn("__k", block)
    counts = d.groupBy(*keys, "__k").agg(F.count(F.lit(1)).alias("n"))
    starts = prefix_over_buckets(counts, keys, "__k", ["n"])
    local = d.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "__k").orderBy(at)) - 1)
    return null_safe(local, starts, [*keys, "__k"]).withColumn(out, F.col("before_n") + F.col("__rn")).drop("__k", "__rn", "before_n")
