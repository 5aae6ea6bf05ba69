"""Pairing of mates: bounds by orientation, interval join, insert sizes, dominant legs and paired qualities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.functions import probability as P

MODES = ("opp-in", "opp-out", "col-fw", "col-bw")


def bounds(mode: str, st: Column, w1: Column, l1: Column, w2: Column, l2: Column, least: int, most: int) -> tuple[Column, Column]:
    """Least and most of (window start of mate 2 - that of mate 1), by strand of mate 1.

    The other modes are the inward one with shifted ends: both reads, the second or the first turned round.
    """
    if mode not in MODES:
        raise ValueError(mode)
    shift = {"opp-in": F.lit(0), "opp-out": l1 + l2, "col-fw": l2, "col-bw": l1}[mode]
    lo = F.when(st == 0, F.lit(least) - w2 + shift).otherwise(F.lit(-most) + l1 + (l2 - w2) - shift)
    hi = F.when(st == 0, F.lit(most) + (w1 - l1) - l2 + shift).otherwise(F.lit(-least) + w1 - shift)
    return lo, hi


def pair_hits(first: DataFrame, second: DataFrame, mode: str = "opp-in", least: int = 0, most: int = 1000) -> DataFrame:
    """Pairs of mates' hits on opposite strands of a contig within the bounds of the mode.

    Both have pair_id, hit, cn, st, g_off, w_len, read_len, score. An equi-join on pair, contig and strand with
    a range on the offsets; as many candidates as the pass-1 limit lets a read keep. Result: pair_id, hit0,
    hit1, cn, delta, score.
    """
    names = ("hit", "st", "g_off", "w_len", "read_len", "score")
    a = first.select("pair_id", "cn", *(F.col(c).alias(f"{c}0") for c in names)).withColumn("side", F.col("st0"))
    b = second.select("pair_id", "cn", *(F.col(c).alias(f"{c}1") for c in names)).withColumn("side", 1 - F.col("st1"))
    lo, hi = bounds(mode, F.col("st0"), *(F.col(c) for c in ("w_len0", "read_len0", "w_len1", "read_len1")), least, most)
    delta = F.col("g_off1") - F.col("g_off0")
    j = a.join(b, ["pair_id", "cn", "side"]).where((delta >= lo) & (delta <= hi))
    return j.select("pair_id", "hit0", "hit1", "cn", F.col("side").alias("st"), delta.alias("delta"), (F.col("score0") + F.col("score1")).alias("score"))


def top_pairs(pairs: DataFrame, most: int, least_score: int = 0) -> DataFrame:
    """The best `most` pairs of each read pair with a score of at least `least_score`: highest score first, then the
    smallest hits; adds rank. Partial top lists are cut before the shuffle, so a pair id may have any number of pairs."""
    w = W.partitionBy("pair_id").orderBy(F.desc("score"), "hit0", "hit1")
    return pairs.where(F.col("score") >= least_score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def best_mates(pairs: DataFrame, qualities: DataFrame) -> DataFrame:
    """For each first hit of a pair the mate hit of the highest quality among its pairs (the smallest hit on ties):
    pair_id, hit0, hit1, mapq. qualities has hit and mapq; hits without a quality are no mates."""
    q = qualities.where("mapq is not null").select(F.col("hit").alias("hit1"), "mapq")
    best = F.max_by(F.struct("hit1", "mapq"), F.struct(F.col("mapq"), -F.col("hit1")))
    return pairs.select("pair_id", "hit0", "hit1").join(q, "hit1").groupBy("pair_id", "hit0").agg(best.alias("b")).select("pair_id", "hit0", "b.hit1", "b.mapq")


def size_histogram(df: DataFrame, size: str, least: int = 0, most: int = 1000, buckets: int = 100) -> DataFrame:
    """Pairs by insert size in equal buckets; sizes outside go to the first or last. With each one's share."""
    width = (most - least) / buckets
    b = F.least(F.greatest(F.floor((F.col(size) - least) / width), F.lit(0)), F.lit(buckets - 1)).cast("int")
    h = df.where(F.col(size).isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("bucket", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 9).alias("share"))  # at most `buckets` rows


def dominant_legs(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """Pairs with each leg replaced by the best hit that shares its start, then its end; equal pairs once.

    pairs: pair_id, hit0, hit1; hits: pair_id, hit, cn, st, start, end, score. Four projections in turn; a pair
    is never dropped but for becoming equal to another.
    """
    out = pairs.select("pair_id", "hit0", "hit1")
    for at in ("start", "end"):
        for leg in ("hit0", "hit1"):
            h = hits.select("pair_id", F.col("hit").alias(leg), "cn", "st", at, "score")
            used = out.select("pair_id", leg).distinct().join(h, ["pair_id", leg])
            w = W.partitionBy("pair_id", "cn", "st", at).orderBy(F.desc("score"), leg)
            best = used.select("pair_id", leg, F.first(leg).over(w).alias("__b"))
            out = out.join(best, ["pair_id", leg]).withColumn(leg, F.col("__b")).drop("__b")
    return out.select("pair_id", "hit0", "hit1").distinct()


def paired_quality(single: DataFrame, pairs: DataFrame, genome_size: int, m: P.Model | None = None, mean: float = 200.0, sd: float = 100.0, floor: int = 4) -> DataFrame:
    """Qualities of single and paired hits of each read pair, with the chance of every class taken into account.

    single: pair_id, nip (0, 1), hit, score, read_len; pairs: pair_id, hit0, hit1, score0, score1, len0, len1, size.
    Result: pair_id, kind ('single', 'pair'), nip, hit, mapq. A class is chosen against the probability that the
    best hits of the other classes are random; single hits also need that the mate was missed.
    """
    m = m or P.letter_model()
    s = single.withColumn("z0", P.posterior(F.col("score"), F.col("read_len"), m))
    z1 = s.groupBy("pair_id", "nip").agg(F.sum("z0").alias("z1"), F.max(F.struct("z0", "score", "read_len")).alias("top"))
    z1 = z1.select("pair_id", "nip", "z1", F.least(P.chance_of_score(F.col("top.score"), F.col("top.read_len"), m) * genome_size, F.lit(1.0)).alias("r"), P.missed_mate(F.col("top.read_len")).alias("own_missed"))
    e = pairs.withColumn("ins", P.insert_probability(F.col("size").cast("double"), mean, sd))
    legs = [e.select("pair_id", F.lit(n).alias("nip"), F.col(f"hit{n}").alias("hit"), P.posterior(F.col(f"score{n}"), F.col(f"len{n}"), m).alias("own"), (F.col("ins") * P.posterior(F.col(f"score{1 - n}"), F.col(f"len{1 - n}"), m)).alias("mate")) for n in (0, 1)]
    z2 = legs[0].unionByName(legs[1]).groupBy("pair_id", "nip", "hit").agg(F.greatest(F.max("own") * F.sum("mate"), F.lit(P.FLOOR)).alias("z2"))
    z3 = z2.where("nip = 0").groupBy("pair_id").agg(F.sum("z2").alias("z3"))
    both = P.chance_of_score(F.col("score0"), F.col("len0"), m) * P.chance_of_score(F.col("score1"), F.col("len1"), m) * 1000
    rp = e.withColumn("c", both).groupBy("pair_id").agg(F.least(F.least(F.min("c"), F.lit(1.0)) * genome_size, F.lit(1.0)).alias("rp"))
    side = [z1.where(f"nip = {n}").select("pair_id", F.col("z1").alias(f"z1_{n}"), F.col("r").alias(f"r{n}"), F.col("own_missed").alias(f"m{n}")) for n in (0, 1)]
    k = side[0].join(side[1], "pair_id", "full").join(rp, "pair_id", "full").join(z3, "pair_id", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    r0, r1, rpair = one("r0"), one("r1"), one("rp")
    # the mate of a read that has no single hit is as long as can't be known here: the shortest class holds
    miss = [F.coalesce(F.col(f"m{1 - n}"), F.lit(P.MISSED[0][1])) for n in (0, 1)]
    weight = [r1 * rpair * miss[0], r0 * rpair * miss[1], r0 * r1]
    has = [F.col("z1_0").isNotNull(), F.col("z1_1").isNotNull(), F.col("rp").isNotNull()]
    denom = sum((F.when(h, w).otherwise(0.0) for h, w in zip(has, weight)), F.lit(0.0))
    k = k.select("pair_id", "z1_0", "z1_1", "z3", *((w / denom).alias(f"k{n}") for n, w in enumerate(weight)))
    q = lambda p: F.when(P.quality_from_error(1 - p) < floor, 0).otherwise(P.quality_from_error(1 - p))
    a = s.join(k, "pair_id").select("pair_id", F.lit("single").alias("kind"), "nip", "hit", q(F.when(F.col("nip") == 0, F.col("k0") * F.col("z0") / F.col("z1_0")).otherwise(F.col("k1") * F.col("z0") / F.col("z1_1"))).alias("mapq"))
    b = z2.join(k, "pair_id").select("pair_id", F.lit("pair").alias("kind"), "nip", "hit", q(F.col("k2") * F.col("z2") / F.col("z3")).alias("mapq"))
    return a.unionByName(b)


def best_of_class(qualities: DataFrame) -> DataFrame:
    """The hit of the highest quality in each class of a pair: the smallest hit on ties."""
    w = W.partitionBy("pair_id", "kind", "nip").orderBy(F.desc("mapq"), "hit")
    return qualities.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def improper(qualities: DataFrame, least: int = 10) -> DataFrame:
    """Pairs of the best single hits of both mates, on whichever contigs, if both reach `least`."""
    b = best_of_class(qualities.where("kind = 'single'")).where(F.col("mapq") >= least)
    a, c = (b.where(f"nip = {n}").select("pair_id", F.col("hit").alias(f"hit{n}"), F.col("mapq").alias(f"mapq{n}")) for n in (0, 1))
    return a.join(c, "pair_id")


def concordant(fwd: DataFrame, rev: DataFrame, root: str, most: int, contig: str = "genome") -> DataFrame:
    """Combinations of the two reads of a root on one contig and strand, in order and nearer than `most`:
    root, contig, fwd, rev, dist. Both sides must be cut to their top hits before."""
    names = ("hit", "strand", "start", "end")
    a, b = (x.select(root, contig, *(F.col(c).alias(f"{p}_{c}") for c in names)) for x, p in ((fwd, "f"), (rev, "r")))
    first = F.col("f_start") < F.col("r_start")
    cf, cr = F.when(first, F.col("f_start")).otherwise(F.col("f_end")), F.when(first, F.col("r_end")).otherwise(F.col("r_start"))
    j = a.join(b, [root, contig]).withColumn("dist", F.abs(cf - cr)).where("f_strand = r_strand")
    ok = (F.col("dist") < most) & (F.col("dist") > 0) & (((F.col("f_strand") == "+") & (cr < cf)) | ((F.col("f_strand") == "-") & (cf < cr)))
    return j.where(ok).select(root, contig, F.col("f_hit").alias("fwd"), F.col("r_hit").alias("rev"), "dist")


def distance_stats(pairs: DataFrame, root: str) -> DataFrame:
    """One row over the roots with exactly one combination: n, mean and deviation of the distance."""
    one = pairs.groupBy(root).agg(F.count(F.lit(1)).alias("c"), F.min("dist").alias("dist")).where("c = 1")
    return one.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 6).alias("mean"), F.round(F.stddev_pop("dist"), 6).alias("deviation"))


def cumulative_from_mean(distances: DataFrame, most: int, bins: int = 2000) -> DataFrame:
    """bin, n, above: the share of distances farther from the mean than each number of bins, both ways.

    The mean of one row joins on a constant; the histogram has at most `bins` rows.
    """
    d = distances.select("dist", F.lit(1).alias("one"))
    m = d.groupBy("one").agg(F.avg("dist").alias("mean"), F.count(F.lit(1)).alias("all"))
    cell = lambda c: F.floor(c / most * bins).cast("int")
    h = d.groupBy("one", cell(F.col("dist")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    off = h.join(F.broadcast(m), "one").groupBy("one", "all", F.abs(F.col("b") - cell(F.col("mean"))).alias("bin")).agg(F.sum("n").alias("n"))
    inside = F.sum("n").over(W.partitionBy("one").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return off.select("bin", "n", F.round(F.greatest(1 - inside / F.col("all"), F.lit(0.0)), 9).alias("above"))


def adjacent_mates(df: DataFrame, name: str, order: str, first: str, second: str) -> DataFrame:
    """Mates as rows of one read name: the k-th first with the k-th second by order; leftovers have null."""
    w = W.partitionBy(name, "side").orderBy(order)
    s = df.withColumn("side", F.when(F.col(first), 0).when(F.col(second), 1)).where("side is not null").withColumn("k", F.row_number().over(w))
    a, b = (s.where(f"side = {n}").select(name, "k", F.col(order).alias(f"row{n}")) for n in (0, 1))
    return a.join(b, [name, "k"], "full").select(name, "row0", "row1")


def suffix_pairs(names: DataFrame, name: str, suffixes: Sequence[str]) -> DataFrame:
    """root, first, second: reads whose names differ only in the suffix; an unpaired one has null beside it."""
    a, b = (names.where(F.col(name).endswith(s)).select(F.expr(f"left({name}, length({name}) - {len(s)})").alias("root"), F.col(name).alias(c)).distinct() for s, c in zip(suffixes, ("first", "second")))
    return a.join(b, "root", "full")
