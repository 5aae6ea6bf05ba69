"""Continuous periods and gaps of interval sets, from independently ranked starts and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

BUCKET_BITS = 20
RANK_SPAN = 1 << 17


def ranked_positions(iv: DataFrame, at: str, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """e, p, n, upto, total: the distinct values of one column of an entity in their order, how many rows have
    each, how many have it or a lower one, and how many there are.

    Equal positions are counted before they are sent; counts per bucket of 2^bucket_bits positions are
    prefix-summed, so a task sorts no more than that many positions of an entity, however many rows it has.
    """
    # the joins below would filter one use of these rows only; filtered here, both uses share one exchange
    iv = iv.where(F.shiftright(at, bucket_bits).isNotNull())
    pts = iv.groupBy("e", F.col(at).alias("p")).agg(F.count(F.lit(1)).alias("n")).withColumn("bk", F.shiftright("p", bucket_bits))
    totals = pts.groupBy("e", "bk").agg(F.sum("n").alias("t"))
    of = W.partitionBy("e")
    earlier = F.sum("t").over(of.orderBy("bk").rowsBetween(W.unboundedPreceding, -1))
    base = totals.select("e", "bk", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("t").over(of).alias("total"))
    within = F.sum("n").over(W.partitionBy("e", "bk").orderBy("p").rowsBetween(W.unboundedPreceding, 0))
    return pts.withColumn("c", within).join(base, ["e", "bk"]).select("e", "p", "n", (F.col("before") + F.col("c")).alias("upto"), "total")


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, bucket_bits: int = BUCKET_BITS, rank_span: int = RANK_SPAN) -> DataFrame:
    """Merges the inclusive integer ranges of every entity; touching ranges continue each other.

    Starts and ends are sorted and ranked independently of each other. Between ranks i and i+1 the coverage
    breaks exactly if the (i+1)-th start exceeds the i-th end by more than one; a break's end and
    start bound the gap, and neighbouring breaks bound a period. The two meet in an equi-join on
    (entity, rank), which spreads an entity of any size. As the i-th end is never below the i-th start, only
    the first of equal starts and the last of equal ends can stand at a break: just these are joined.

    Result: entity, kind ('covered' or 'gap'), pos_from, pos_to (bigint, inclusive); one gap for each
    hole of any length between two periods.
    Defined cases: rows with a null entity or end are left out; ends in reverse order cover the same
    positions; repeated rows change nothing; an empty table gives no rows; other columns are ignored.
    """
    a, b = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    iv = df.where(F.col(entity).isNotNull() & a.isNotNull() & b.isNotNull()).select(F.col(entity).alias("e"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    # rank: how many starts lie before this one / how many ends up to and with this one
    starts = ranked_positions(iv, "lo", bucket_bits).select("e", (F.col("upto") - F.col("n")).alias("rank"), F.col("p").alias("next_start"))
    ends = ranked_positions(iv, "hi", bucket_bits).select("e", F.col("upto").alias("rank"), F.col("p").alias("prev_end"), (F.col("upto") == F.col("total")).alias("last"))
    # the start of rank 0 has no end before it, the last end no start after it: they bound the outer periods
    outer = (F.col("rank") == 0) | F.col("last")
    breaks = starts.join(ends, ["e", "rank"], "full").where(outer | (F.col("next_start") > F.col("prev_end") + 1)).withColumn("rb", F.floor(F.col("rank") / rank_span).cast("bigint")).where("e is not null and rb is not null")
    # the period that a break opens ends where the next break stands; the next may lie in a later span of ranks.
    # Whole structs are carried, so that both uses of the breaks need the same columns and share one exchange
    at_break = F.struct("next_start", "prev_end")
    by_rank = W.partitionBy("e", "rb").orderBy("rank")
    spans = breaks.withColumn("b", at_break).select("e", "rb", "rank", "b", F.lead("b").over(by_rank).alias("nb"), F.lag("rank").over(by_rank).alias("earlier"))
    firsts = spans.where("earlier is null").select("e", "rb", F.lead("b").over(W.partitionBy("e").orderBy("rb")).alias("fb"))
    done = spans.join(firsts, ["e", "rb"])
    opens, before = F.col("b.next_start"), F.col("b.prev_end")
    rows = F.array(
        F.when(opens.isNotNull(), F.struct(F.lit("covered").alias("kind"), opens.alias("pos_from"), F.coalesce("nb.prev_end", "fb.prev_end").alias("pos_to"))),
        F.when(opens.isNotNull() & before.isNotNull(), F.struct(F.lit("gap").alias("kind"), (before + 1).alias("pos_from"), (opens - 1).alias("pos_to"))),
    )
    return done.select(F.col("e").alias(entity), F.inline(F.filter(rows, lambda x: x.isNotNull())))
