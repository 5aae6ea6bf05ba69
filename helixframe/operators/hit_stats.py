"""Hit probabilities, event rates and mapping statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from helixframe.functions import probability as P


def mapping_stats(hits: DataFrame, read: str, score: str) -> DataFrame:
    """One row: reads, hits, reads with one hit, reads with one best hit, hits a read.

    Three levels, each combined before it is sent: per read and score, per read, over all."""
    s = hits.where(F.col(read).isNotNull()).groupBy(read, score).agg(F.count(F.lit(1)).alias("n"))
    r = s.groupBy(read).agg(F.sum("n").alias("n"), F.max(F.struct(F.col(score), F.col("n"))).alias("top"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = r.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.coalesce(one(F.col("n") == 1), F.lit(0)).alias("unique_hit"), F.coalesce(one(F.col("top.n") == 1), F.lit(0)).alias("unique_top_hit"))
    return a.withColumn("hits_per_read", F.round(F.col("hits") / F.col("reads"), 2))


EVENTS = ("matches", "mismatches", "insertions", "deletions", "crossovers")


def rate_partials(hits: DataFrame, read: str, score: str, tie: str, keep: Column | None = None) -> DataFrame:
    """One row of counts over the best hit of each read (the smallest tie): what a partial rates file holds."""
    h = hits.where(F.col(read).isNotNull() & F.col(score).isNotNull())
    best = h.groupBy(read).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("t"), *EVENTS, *(c for c in ("pchance",) if c in hits.columns))).alias("b")).select("b.*")
    if keep is not None:
        best = best.where(keep)
    return best.agg(F.count(F.lit(1)).alias("samples"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in EVENTS))


def rates(parts: DataFrame) -> DataFrame:
    """Error, substitution, indel and match rates from any number of partial counts; a zero becomes tiny."""
    t = parts.agg(*(F.sum(c).cast("bigint").alias(c) for c in ("samples", *EVENTS)))
    n = F.col("matches") + F.col("mismatches")
    rate = lambda c: F.round(F.when(c > 0, c / n).otherwise(P.ALMOST_ZERO), 12)
    return t.select("samples", *EVENTS, rate(F.col("crossovers")).alias("erate"), rate(F.col("mismatches")).alias("srate"), rate(F.col("insertions") + F.col("deletions")).alias("irate"), rate(F.col("matches")).alias("mrate"))


def normalised_odds(hits: DataFrame, read: str, pgenome: str, pchance: str) -> DataFrame:
    """Adds odds_share: pgenome / pchance over its sum for the read. Sums join back (no window over a read)."""
    h = hits.where(F.col(read).isNotNull() & F.col(pgenome).isNotNull() & (F.col(pchance) > 0)).withColumn("__o", F.col(pgenome) / F.col(pchance))
    s = h.groupBy(read).agg(F.sum("__o").alias("__s"))
    return h.join(s, read).withColumn("odds_share", F.col("__o") / F.col("__s")).drop("__o", "__s")


def genome_probability(erate: float, srate: float, irate: float):
    """Arrow function of (matches, mismatches, indels, crossovers): likelihood of as many events or more."""

    @F.pandas_udf(T.DoubleType())
    def run(matches: pd.Series, mismatches: pd.Series, indels: pd.Series, crossovers: pd.Series) -> pd.Series:
        k = matches + mismatches
        t = P.lgamma_table(int(k.max(skipna=True) or 0) + 2) if len(k) else None
        seen: dict = {}

        def one(n, s, i, e):
            if pd.isna(n) or pd.isna(s) or pd.isna(i) or pd.isna(e) or n < 2:
                return None
            key = (int(n), int(s), int(i), int(e))
            if key not in seen:
                seen[key] = P.genome_probability(key[0], key[3], erate, key[1], srate, key[2], irate, t)
            return seen[key]

        return pd.Series([one(*x) for x in zip(k, mismatches, indels, crossovers)], dtype="float64")

    return run


def chance_probability(genome_length: int):
    """Arrow function of (matches, mismatches, crossovers, read_length, ins_sizes, del_sizes)."""

    @F.pandas_udf(T.DoubleType())
    def run(matches: pd.Series, mismatches: pd.Series, crossovers: pd.Series, read_length: pd.Series, ins: pd.Series, dels: pd.Series) -> pd.Series:
        # tables up to the largest value of the batch: words of k letters, and as many deletions among them
        most = max((sum(map(int, v)) for c in (ins, dels) for v in c if v is not None), default=0)
        letters = int((matches.fillna(0) + mismatches.fillna(0)).max()) if len(matches) else 0
        t, parts, seen, out = P.lgamma_table(letters + 2 * most + 2), P.partitions_table(most), {}, []
        for m, s, x, n, i, d in zip(matches, mismatches, crossovers, read_length, ins, dels):
            if pd.isna(m) or pd.isna(s) or pd.isna(x) or pd.isna(n) or i is None or d is None:
                out.append(None)
                continue
            i, d = [int(v) for v in i], [int(v) for v in d]
            key = (int(m), int(s), int(x), int(n), tuple(i), tuple(d))
            if key not in seen:
                seen[key] = P.chance_probability(genome_length, key[0] + key[1] + sum(i), key[1], key[2], key[3], i, d, t, parts)
            out.append(seen[key])
        return pd.Series(out, dtype="float64")

    return run
