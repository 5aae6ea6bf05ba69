"""Anchors of reads on contigs: seed join, region support, diagonal islands, candidate windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from helixframe.functions.alphabet import reverse_complement
from helixframe.operators.seeds import Seed, kmers, tiles

REGION_BITS, REGION_OVERLAP, BIG_GAP = 11, 50, 1024


def both_strands(reads: DataFrame, read_id: str = "read_id", seq: str = "seq", strands: str = "both") -> DataFrame:
    """read_id, st (0 as given, 1 reverse complement), seq; `strands` may be 'both', 'positive', 'negative'."""
    ways = {"positive": [0], "negative": [1], "both": [0, 1]}[strands]
    pair = [F.struct(F.lit(w).alias("st"), (reverse_complement(F.col(seq)) if w else F.col(seq)).alias("seq")) for w in ways]
    return reads.select(read_id, F.inline(F.array(*pair)))


def seed_anchors(stranded: DataFrame, index: DataFrame, seeds: Sequence[Seed]) -> DataFrame:
    """read_id, st, cn, x (contig position), y (read position), sn: equal keys of reads and contigs.

    An equi-join on (sn, key); heavy keys are to be cut from the index first, which bounds the rows that a
    key of a read can give."""
    k = kmers(stranded, ["read_id", "st"], "seq", seeds).withColumnRenamed("pos", "y")
    return k.join(index.withColumnRenamed("pos", "x"), ["sn", "key"]).select("read_id", "st", "cn", "x", F.col("y").cast("int").alias("y"), "sn")


def region_counts(anchors: DataFrame, bits: int = REGION_BITS, overlap: int = REGION_OVERLAP) -> DataFrame:
    """read_id, st, cn, region, n: incidences; those in the first `overlap` positions count for the region before too."""
    r = F.shiftright("x", bits)
    near = (F.col("x") % (1 << bits) < overlap) & (r > 0)
    both = F.filter(F.array(r, F.when(near, r - 1)), lambda x: x.isNotNull())
    return anchors.select("read_id", "st", "cn", F.explode(both).alias("region")).groupBy("read_id", "st", "cn", "region").agg(F.count(F.lit(1)).alias("n"))


def supported(anchors: DataFrame, least: int = 2, bits: int = REGION_BITS, overlap: int = REGION_OVERLAP) -> DataFrame:
    """Anchors in a region with at least `least` incidences, or at its edge next to one."""
    ok = region_counts(anchors, bits, overlap).where(F.col("n") >= least).select("read_id", "st", "cn", "region")
    r = F.shiftright("x", bits)
    near = F.col("x") % (1 << bits) < overlap
    a = anchors.withColumn("regions", F.filter(F.array(r, F.when(near, r - 1)), lambda x: x.isNotNull()))
    keys = ["read_id", "st", "cn", "x", "y", "sn"]
    flat = a.select(*keys, F.explode("regions").alias("region"))
    return flat.join(ok, ["read_id", "st", "cn", "region"], "left_semi").select(*keys).distinct()


def mate_supported(anchors: DataFrame, mates: DataFrame, mode: int, reach: int = 1000, bits: int = REGION_BITS) -> DataFrame:
    """Anchors kept by the regions of the read and of its mate within `reach`: both strong (mode 1), either strong
    (2), or the mate there at all and three incidences together (3); 0 keeps all.

    Both have pair_id besides the anchor columns; mates lie on the other strand. Region counts meet in an
    equi-join on neighbouring regions, which are as many as `reach` spans."""
    if mode not in (0, 1, 2, 3):
        raise ValueError("mode is 0 to 3")
    if not mode:
        return anchors
    span = (reach >> bits) + 1

    def counts(a: DataFrame) -> DataFrame:
        return a.groupBy("pair_id", "st", "cn", F.shiftright("x", bits).alias("region")).agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("n"))

    near = counts(mates).select("pair_id", (1 - F.col("st")).alias("st"), "cn", F.explode(F.sequence(F.col("region") - span, F.col("region") + span)).alias("region"), F.col("n").alias("m"))
    near = near.groupBy("pair_id", "st", "cn", "region").agg(F.max("m").alias("m"))
    own = counts(anchors).join(near, ["pair_id", "st", "cn", "region"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    keep = {1: (F.col("n") >= 2) & (F.col("m") >= 2), 2: (F.col("n") >= 2) | (F.col("m") >= 2), 3: (F.col("m") >= 1) & (F.col("n") + F.col("m") >= 3)}[mode]
    ok = own.where(keep).select("pair_id", "st", "cn", "region")
    return anchors.withColumn("region", F.shiftright("x", bits)).join(ok, ["pair_id", "st", "cn", "region"], "left_semi").drop("region")


def diagonal_islands(anchors: DataFrame, read_len: str, span: int) -> DataFrame:
    """Successive anchors of one diagonal as one: read_id, st, cn, x, y, length, weight (how many), big_gap
    (whether the next anchor of the read lies far off).

    Anchors of a read compete for the slot of their diagonal modulo the read length, in order of position;
    another diagonal in the slot ends the run.
    """
    slot = F.pmod(F.col("x") + F.col(read_len) - F.col("y"), F.col(read_len))
    w = W.partitionBy("read_id", "st", "slot").orderBy("cn", "x", "y")
    d = anchors.withColumn("slot", slot).withColumn("diag", F.col("x") - F.col("y"))
    fresh = ~((F.lag("cn").over(w) == F.col("cn")) & (F.lag("diag").over(w) == F.col("diag")))
    d = d.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = d.groupBy("read_id", "st", "slot", "island").agg(F.first("cn").alias("cn"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") + span - F.min("x")).cast("int").alias("length"), F.count(F.lit(1)).cast("int").alias("weight"))
    return with_big_gap(g.drop("slot", "island"))


def with_big_gap(islands: DataFrame) -> DataFrame:
    """Adds big_gap: whether the next island of the read on its contig lies far off."""
    nxt = F.lead("x").over(W.partitionBy("read_id", "st", "cn").orderBy("x", "y"))
    return islands.withColumn("big_gap", F.coalesce(nxt - F.col("x") >= BIG_GAP, F.lit(False)))


def candidate_windows(islands: DataFrame, read_len: str, contig_len: str, match: int, gap_open: int, gap_ext: int, window_pct: int = 140, threshold_pct: int = 55) -> DataFrame:
    """Windows of one or two anchors whose optimistic score passes.

    Of the earlier anchors within reach the one with the best joint score extends an anchor, the nearest on
    ties; a single seed alone has no score. Gives read_id, st, cn, x, y, length, weight, score, w_len, g_off.
    """
    a = islands.withColumn("w", F.floor(F.col(read_len) * window_pct / 100).cast("int"))
    a = a.withColumn("gend", F.least(F.col("x") + F.col(read_len) - 1 - F.col("y"), F.col(contig_len) - 1)).withColumn("gstart", F.greatest(F.col("gend") - F.col("w"), F.lit(0)))
    own = F.when(F.col("weight") == 1, -1).otherwise(F.col("length") * match)
    # partners lie within one window before: an equi-join on buckets of positions, of which two can hold them
    span = 1 << 10
    b = a.select("read_id", "st", "cn", F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("weight").alias("wj"), F.floor(F.col("x") / span).alias("bj"))
    keyed = a.withColumn("bj", F.explode(F.sequence(F.floor(F.col("gstart") / span), F.floor(F.col("x") / span))))
    j = keyed.join(b, ["read_id", "st", "cn", "bj"]).where("xj >= gstart and yj < y and xj < x")
    dx, dy = F.col("x") - F.col("xj"), F.col("y") - F.col("yj")
    short, long = F.least(dx, dy) + F.col("length"), F.greatest(dx, dy) + F.col("length")
    joint = short * match + F.when(long > short, gap_open + (long - short) * gap_ext).otherwise(0)
    best = j.groupBy("read_id", "st", "cn", "x", "y").agg(F.max(F.struct(joint.alias("s"), F.col("xj"), F.col("yj"), F.col("wj"))).alias("p"))
    r = a.join(best, ["read_id", "st", "cn", "x", "y"], "left").withColumn("own", own)
    two = F.coalesce(F.col("p.s") > F.col("own"), F.lit(False))
    r = r.withColumn("score", F.when(two, F.col("p.s")).otherwise(F.col("own")).cast("int")).withColumn("xb", F.when(two, F.col("p.xj")).otherwise(F.col("x"))).withColumn("matches", F.col("weight") + F.when(two, F.col("p.wj")).otherwise(0))
    w_len = F.least(F.col("w"), F.col(contig_len)).cast("int")
    need = F.floor(F.lit(threshold_pct) * F.least(F.col(read_len), w_len) * match / 100)
    x_len = F.col("x") - F.col("xb") + F.col("length")
    g_off = F.least(F.greatest(F.col("xb") - F.floor((F.col("w") - x_len) / 2), F.lit(0)), F.col(contig_len) - w_len)
    return r.where(F.col("score") >= need).select("read_id", "st", "cn", "x", "y", "length", "weight", "matches", "score", w_len.alias("w_len"), g_off.cast("bigint").alias("g_off"))


def window_text(windows: DataFrame, contigs: DataFrame, most: int = 1536, tile: int = 4096) -> DataFrame:
    """Adds `text`: the contig's bases of a window of at most `most`, from tiles of the contigs by an equi-join.
    A longer window is an error, never cut short."""
    t = tiles(contigs, ["cn"], "seq", most, tile).select("cn", "tile", "start", F.col("text").alias("__t"))
    w = windows.withColumn("tile", F.floor(F.col("g_off") / tile).cast("bigint"))
    j = w.join(t, ["cn", "tile"]).withColumn("w_len", F.when(F.col("w_len") <= most, F.col("w_len")).otherwise(F.raise_error(F.lit(f"a window has more than {most} bases"))))
    return j.withColumn("text", F.substring("__t", (F.col("g_off") - F.col("start") + 1).cast("int"), F.col("w_len"))).drop("tile", "start", "__t")
