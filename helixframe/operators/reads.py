"""Filters and lookups of reads and their alignment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators.anchors import window_text

LONGEST, LEAST_QUALITY = 1000, 10


def usable(reads: DataFrame, length: Column, quality: Column, longest: int = LONGEST, least: float = LEAST_QUALITY, pair: str | None = None) -> DataFrame:
    """Reads no longer than `longest` with an average quality of at least `least`; with `pair` one bad mate drops all
    rows of its pair. An unknown quality passes, an unknown length doesn't; rows with a null pair stand alone."""
    good = F.coalesce(length <= longest, F.lit(False)) & F.coalesce(quality >= least, F.lit(True))
    if pair is None:
        return reads.where(good)
    bad = reads.where(~good & F.col(pair).isNotNull()).select(pair).distinct()
    return reads.where(good).join(bad, pair, "left_anti")


def clipped(rows: DataFrame, cigar: str, marks: str = "H") -> DataFrame:
    """Alignment rows whose CIGAR holds one of the operations `marks`; a null one holds none."""
    return rows.where(F.col(cigar).rlike(f"[{marks}]"))


def plain_name(name: Column) -> Column:
    """A read's name without what follows the first space and without its mate number."""
    return F.regexp_replace(F.regexp_extract(name, r"^\S*", 0), r"[/:][12]$", "")


def rows_of_reads(reads: DataFrame, rows: DataFrame, name: str, row_name: str) -> DataFrame:
    """Alignment rows beside the reads that they are of, by plain name: reads' columns, then the rows'. An equi-join,
    whatever order the files are in; reads without a row have nulls, null names match nothing."""
    a, b = reads.withColumn("__n", plain_name(F.col(name))), rows.withColumn("__n", plain_name(F.col(row_name)))
    return a.join(b, "__n", "left").drop("__n")


def bases_of_hits(hits: DataFrame, contigs: DataFrame, contig: str, start: str, end: str, most: int = 1024) -> DataFrame:
    """Adds `bases`: the contig's bases of each hit of at most `most` bases, 1-based and inclusive, ends in either
    order. Long contigs are met by tiles, never sent whole to every hit; contigs has cn, name and seq. Hits on unknown
    contigs, outside of them or longer are left out."""
    lo, n = F.least(start, end), F.abs(F.col(end) - F.col(start)) + 1
    h = hits.join(contigs.select("cn", F.col("name").alias(contig), F.length("seq").alias("__len")), contig)
    h = h.where((lo >= 1) & (lo + n - 1 <= F.col("__len")) & (n <= most)).withColumn("g_off", (lo - 1).cast("bigint")).withColumn("w_len", n.cast("int"))
    return window_text(h, contigs.select("cn", "seq"), most).withColumnRenamed("text", "bases").drop("cn", "g_off", "w_len", "__len")


def split_at_skips(rows: DataFrame, start: str, cigar: str) -> DataFrame:
    """An alignment with skipped stretches (N) as one row for each part: adds part (from 0), part_start and
    part_cigar. Without N there is one part; a null CIGAR has none."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHPX=])"), F.lit(1))
    size = lambda o: F.substring(o, F.lit(1), F.length(o) - 1).cast("int")
    kind = lambda o: F.right(o, F.lit(1))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array(F.struct(F.lit(0).cast("bigint").alias("off"), F.lit("").alias("cigar"))).alias("parts"))

    def step(acc: Column, o: Column) -> Column:
        moved = acc["at"] + F.when(kind(o).isin("M", "D", "N", "X", "="), size(o)).otherwise(0)
        last = F.element_at(acc["parts"], -1)
        grown = F.concat(F.slice(acc["parts"], F.lit(1), F.size(acc["parts"]) - 1), F.array(F.struct(last["off"].alias("off"), F.concat(last["cigar"], o).alias("cigar"))))
        parts = F.when(kind(o) == "N", F.concat(acc["parts"], F.array(F.struct(moved.alias("off"), F.lit("").alias("cigar"))))).otherwise(grown)
        return F.struct(moved.alias("at"), parts.alias("parts"))

    found = rows.where(F.col(cigar).isNotNull()).select("*", F.posexplode(F.aggregate(ops, first, step)["parts"]).alias("part", "__p"))
    return found.select(*rows.columns, "part", (F.col(start) + F.col("__p.off")).alias("part_start"), F.col("__p.cigar").alias("part_cigar"))


def distance_counts(rows: DataFrame, read: str, distance: str) -> DataFrame:
    """Per read how many of its alignments have 0, 1 and 2 differences: h0, h1, h2. Null reads are left out."""
    return rows.where(F.col(read).isNotNull()).groupBy(read).agg(*(F.count_if(F.col(distance) == n).alias(f"h{n}") for n in range(3)))


def run_report(reads: DataFrame, hits: DataFrame, read: str) -> DataFrame:
    """One row: reads, matched and unmatched reads, hits, hits per matched read, and hit rows given more than once. A read
    counts once; hits of unknown reads count as hits only."""
    per = hits.groupBy(*hits.columns).agg(F.count(F.lit(1)).alias("__c")).groupBy(read).agg(F.sum("__c").alias("n"), F.sum(F.col("__c") - 1).alias("again"))
    r = reads.where(F.col(read).isNotNull()).select(read).distinct().withColumn("__r", F.lit(1))
    a = r.join(per, read, "full").agg(F.count("__r").alias("reads"), F.count_if(F.col("__r").isNotNull() & F.col("n").isNotNull()).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.coalesce(F.sum("again"), F.lit(0)).alias("repeated"), F.sum(F.when(F.col("__r").isNotNull(), F.col("n"))).alias("__m"))
    return a.select("reads", "matched", (F.col("reads") - F.col("matched")).alias("unmatched"), "hits", "repeated", F.round(F.try_divide("__m", "matched"), 6).alias("hits_per_read"))
