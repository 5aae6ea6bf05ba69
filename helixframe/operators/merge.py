"""Merging hits of the same reads from several files or genome chunks, with qualities worked out anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from helixframe.functions import probability as P


def partials(hits: DataFrame, read: str, file: str, score: str, read_len: str, m: P.Model | None = None) -> DataFrame:
    """Each hit with z0 (its posterior) and z1 (their sum over its read and file): what a file carries."""
    m = m or P.letter_model()
    h = hits.withColumn("z0", P.posterior(F.col(score), F.col(read_len), m))
    z = h.groupBy(read, file).agg(F.sum("z0").alias("z1"))
    return h.join(z, [read, file])


def merge_single(parts: DataFrame, read: str, file: str, hit: str, score: str, most: int = 10, strata: bool = False, floor: int = 4) -> DataFrame:
    """The best `most` hits of a read over all files (its best only with strata) with merged mapq.

    z1 of a file counts once, however many rows carry it. Sums are combined before they are sent; a read's
    best come from partial top lists, so a read with very many hits never lies in one task whole.
    """
    once = parts.groupBy(read, file).agg(F.max("z1").alias("z1"))
    z = once.groupBy(read).agg(F.sum("z1").alias("z1_all"))
    w = W.partitionBy(read).orderBy(F.desc(score), hit)
    best = parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    if strata:
        top = parts.groupBy(read).agg(F.max(score).alias("__t"))
        best = best.join(top, read).where(F.col(score) == F.col("__t")).drop("__t")
    q = P.quality_from_error(1 - F.col("z0") / F.col("z1_all"))
    return best.join(z, read).withColumn("mapq", F.when(q < floor, 0).otherwise(q)).drop("z1", "z1_all")


def weak_legs(pairs: DataFrame, q0: str, q1: str, least: int) -> DataFrame:
    """Pairs of which a leg reaches the least quality; the other leg, if it doesn't, becomes unmapped (null)."""
    return pairs.where((F.col(q0) >= least) | (F.col(q1) >= least)).withColumn("weak0", F.col(q0) < least).withColumn("weak1", F.col(q1) < least)


def best_pair_per_file(pairs: DataFrame, pair: str, file: str, mapq: str, score: str, key: str, most: int = 1) -> DataFrame:
    """Top pairs by summed quality, then by summed score, then by key."""
    w = W.partitionBy(pair, file).orderBy(F.desc(mapq), F.desc(score), key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def union_same_contigs(a: DataFrame, b: DataFrame, a_headers: DataFrame, b_headers: DataFrame) -> DataFrame:
    """Hits of different reads on the same contigs: an error where the headers (program lines aside) differ."""
    x, y = (h.where("not line like '@PG%'").select("line").distinct() for h in (a_headers, b_headers))
    odd = x.exceptAll(y).unionByName(y.exceptAll(x)).limit(1).collect()
    if odd:
        raise ValueError(f"headers differ: {odd[0]['line']}")
    return a.unionByName(b)


def genome_chunks(contigs: list[tuple[str, int]], target: int) -> list[list[str]]:
    """Contigs as chunks of at most `target` bases: first-fit decreasing gives their number, and the least target for
    which it needs no more evens them out. For a genome's list of contigs, which a driver holds.

    A contig above the target is an error; one of length 0 goes with the first chunk; no contigs give no chunks.
    """
    order = sorted(contigs, key=lambda c: (-c[1], c[0]))
    if order and order[0][1] > target:
        raise ValueError(f"{order[0][0]} has more than {target} bases")

    def packed(most: int) -> list[list[str]]:
        free: list[int] = []
        chunks: list[list[str]] = []
        for name, n in order:
            at = next((i for i, f in enumerate(free) if f >= n), len(free))
            if at == len(free):
                free.append(most)
                chunks.append([])
            free[at] -= n
            chunks[at].append(name)
        return chunks

    best = packed(target)
    lo, hi = order[0][1] if order else 0, target
    while lo < hi:
        mid = (lo + hi) // 2
        even = packed(mid)
        if len(even) <= len(best):
            best, hi = even, mid
        else:
            lo = mid + 1
    return best


def pairedness(rows: DataFrame, name: str, flags: str) -> DataFrame:
    """One row: rows, paired rows, and whether the alignments are of pairs throughout, of single reads, or mixed."""
    r = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((F.col(flags).bitwiseAND(1) != 0).cast("int")), F.lit(0)).alias("paired"))
    return r.withColumn("kind", F.when(F.col("paired") == 0, "single").when(F.col("paired") == F.col("rows"), "paired").otherwise("mixed"))


def collapse_pairs(rows: DataFrame, key: str, nip: str, line: str) -> DataFrame:
    """Two lines of a pair as one row: key, first, second."""
    return rows.groupBy(key).agg(F.max(F.when(F.col(nip) == 0, F.col(line))).alias("first"), F.max(F.when(F.col(nip) == 1, F.col(line))).alias("second"))


def expand_pairs(pairs: DataFrame, key: str) -> DataFrame:
    both = F.array(*(F.struct(F.lit(n).alias("nip"), F.col(c).alias("line")) for n, c in enumerate(("first", "second"))))
    return pairs.select(key, F.inline(both)).where("line is not null")
