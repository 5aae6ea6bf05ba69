"""Top N rows of every group, with groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, alike: Sequence[str] = (), heavy_rows: int = 1 << 16, max_heavy: int = 1 << 14, ranges: int = 64) -> DataFrame:
    """The first n rows of each group by score (highest first), then by tie (lowest first).

    Exact group counts split hot from cold. Cold groups take an ordinary window. Hot groups are cut
    into score ranges; ranges that can't reach the first n are set aside by exact counts, the others are
    salted so that a sort holds about `heavy_rows` rows, and the firsts of the salts are sorted again.
    A group is hot beyond max(heavy_rows, rows / max_heavy) rows, so there are fewer than max_heavy hot
    groups whatever the input: that bound is what makes broadcasting their counts safe.

    With `alike`, of rows equal in group, score and those columns (null equals null) only the one
    with the smallest tie takes part. Result: group, score, tie and rank (1..n).
    Defined cases: rows with a null group or score are left out, a null tie sorts last; equal scores go
    by tie; fewer than n rows give all of them; an empty table gives none; other columns are ignored.
    """
    d = df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).select(F.col(group).alias("g"), F.col(score).alias("s"), F.col(tie).alias("t"), *(F.col(c).alias(f"a{i}") for i, c in enumerate(alike)))
    if alike:
        d = d.groupBy("g", "s", *(f"a{i}" for i in range(len(alike)))).agg(F.min("t").alias("t")).select("g", "s", "t")
    order = [F.col("s").desc(), F.col("t").asc_nulls_last()]
    counts = d.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi")).withColumn("one", F.lit(1))
    total = counts.groupBy("one").agg(F.sum("c").alias("rows"))  # one row
    hot = counts.join(F.broadcast(total), "one").where(F.col("c") > F.greatest(F.lit(heavy_rows), F.col("rows") / max_heavy)).select("g", "c", "lo", "hi")
    hot = F.broadcast(hot)  # fewer than max_heavy rows, see above
    cold = d.join(hot.select("g"), "g", "left_anti")
    firsts = cold.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    # hot: range 0 holds the highest scores
    width = (F.col("hi") - F.col("lo")).cast("double")
    rng = F.when(width > 0, F.least(F.floor((F.col("hi") - F.col("s")).cast("double") * ranges / width), F.lit(ranges - 1))).otherwise(0).cast("int")
    h = d.join(hot, "g").select("g", "s", "t", rng.alias("r"))
    per = h.groupBy("g", "r").agg(F.count(F.lit(1)).alias("k"))
    ahead = F.coalesce(F.sum("k").over(W.partitionBy("g").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    need = F.broadcast(per.withColumn("ahead", ahead).where(F.col("ahead") < n).select("g", "r", F.ceil(F.col("k") / heavy_rows).alias("salts")))  # at most ranges * max_heavy rows
    h = h.join(need, ["g", "r"]).withColumn("salt", F.pmod(F.xxhash64("t"), F.col("salts")))
    h = h.withColumn("local", F.row_number().over(W.partitionBy("g", "r", "salt").orderBy(*order))).where(F.col("local") <= n)
    h = h.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    out = firsts.select("g", "s", "t", "rank").unionByName(h.select("g", "s", "t", "rank"))
    return out.select(F.col("g").alias(group), F.col("s").alias(score), F.col("t").alias(tie), "rank")
