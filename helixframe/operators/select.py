"""Choosing among the hits of a read: overlap suppression, top-k, duplicates, strata and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def suppress_overlaps(windows: DataFrame, overlap_pct: int = 90) -> DataFrame:
    """Rows that pass and don't overlap the last passing window of their read, strand and contig too much.

    Needs read_id, st, cn, g_off, w_len, passes. Every decision depends on the one before, hence an ordered
    fold; its groups are the windows of one read and strand, which the cut-off of heavy keys bounds.
    """
    order = [c for c in ("cn", "g_off", "x", "y") if c in windows.columns]
    rest = [c for c in windows.columns if c not in (*order, "read_id", "st")]
    rows = windows.groupBy("read_id", "st").agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("__w"))
    item = rows.schema["__w"].dataType.elementType.simpleString()
    start = F.struct(F.array().cast(f"array<{item}>").alias("kept"), F.lit(None).cast(item).alias("last"))

    def fold(acc: Column, w: Column) -> Column:
        last = acc["last"]
        near = last.isNotNull() & (last["cn"] == w["cn"]) & (w["g_off"] + F.floor(w["w_len"] * overlap_pct / 100) <= last["g_off"] + w["w_len"])
        take = w["passes"] & ~F.coalesce(near, F.lit(False))
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(w))).otherwise(acc["kept"]).alias("kept"), F.when(take, w).otherwise(last).alias("last"))

    kept = F.aggregate("__w", start, fold, lambda acc: acc["kept"])
    return rows.select("read_id", "st", F.inline(kept)).select(*windows.columns)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def top_with_ties(df: DataFrame, group: Sequence[str], score: Column, k: int, out: str = "rank") -> DataFrame:
    """The first k and whatever ties with the k-th."""
    return df.withColumn(out, F.rank().over(W.partitionBy(*group).orderBy(score))).where(F.col(out) <= k)


def strata(df: DataFrame, group: Sequence[str], score: Column) -> DataFrame:
    """Rows tied with the best of their group."""
    return top_with_ties(df, group, score, 1, "__r").drop("__r")


def capped(df: DataFrame, group: Sequence[str], most: int) -> DataFrame:
    """Groups of at most `most` rows; larger ones are left out whole. Counts join back, as a window would
    bring a large group into one task."""
    small = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= most).drop("__n")
    return df.join(small, list(group), "left_semi")


def dominant(df: DataFrame, group: Sequence[str], start: str, end: str, order: Sequence[Column]) -> DataFrame:
    """The best row of each start, then of those the best of each end."""
    a = top_k(df, [*group, start], order, 1, "__r").drop("__r")
    return top_k(a, [*group, end], order, 1, "__r").drop("__r")
