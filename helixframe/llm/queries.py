"""Queries of the training-data operators with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import leaks, mixing, packing, percentiles, pieces, subjects, top_n
from helixframe.session import table

CHUNK, PIECE, OVERLAP = 64_000, 20_000, 200
PERMILLE = (50, 500, 950, 990)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contig")
    return packing.pack(c, "name", F.coalesce(F.col("size"), F.length("seq")), "contig_id", CHUNK)


def p1_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).withColumnRenamed("item", "name")


def p1_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_chunks(spark, d), CHUNK)


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the chunks: all contigs and bases are there once, none is cut that fits, no chunk is overfull."""
    c = _chunks(spark, d).where("chunk is not null")
    items = c.groupBy("item").agg(F.count(F.lit(1)).alias("parts"), F.sum("part_size").alias("bases"), F.max("n_parts").alias("n"))
    a = items.agg(
        F.count(F.lit(1)).alias("contigs"), F.sum("parts").alias("parts"), F.sum("bases").cast("bigint").alias("bases"),
        F.count_if((F.col("parts") != F.col("n")) | ((F.col("n") > 1) & (F.col("bases") <= CHUNK))).alias("cut_wrong"),
    )
    b = c.groupBy("chunk").agg(F.sum("part_size").alias("used")).agg(F.count_if(F.col("used") > CHUNK).alias("overfull"))
    return a.join(b)  # one row each


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pretty").select("read_group", F.to_date("run_at").alias("day"), F.abs(F.col("isize").cast("bigint")).alias("v")).where("v > 0")
    return percentiles.sketch(p, ["read_group", "day"], F.col("v"))


def _rounded(p: DataFrame) -> DataFrame:
    names = {f"p{m}": f"p{m // 10}" for m in PERMILLE}
    return p.select(*(F.round(c, 3).alias(names[c]) if c in names else F.col(c) for c in p.columns))


def p2_by_day(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(percentiles.percentiles(_sizes(spark, d), ["read_group", "day"], PERMILLE))


def p2_all_days(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(percentiles.percentiles(percentiles.combine(_sizes(spark, d), ["read_group"]), ["read_group"], PERMILLE))


def p2_by_week(spark: SparkSession, d: str) -> DataFrame:
    """Sets of days: each week, named by its Monday, from the day sketches."""
    s = _sizes(spark, d).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    return _rounded(percentiles.percentiles(percentiles.combine(s, ["read_group", "week"]), ["read_group", "week"], PERMILLE))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(table(spark, d, "contig"), "name", "seq", PIECE, OVERLAP, tie="contig_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("longest_stretch") > PIECE, "forced").otherwise("boundary")
    return p6_pieces(spark, d).where("piece = 1").select("name", kind.alias("cut_kind"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits")
    return top_n.top_n(h, "read", "score", "hit_id", 5, ["genome", "strand", "genome_start", "genome_end", "edit"]).select("read", "hit_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.report(_leaks(spark, d), table(spark, d, "benchmark"), "item_id")


def p9_draws(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, d, t) for t in ("documents", "subject_labels", "subject_areas", "benchmark")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.corpus_shares(table(spark, d, "documents"), _subjects(spark, d), table(spark, d, "subject_areas"))


QUERIES = {f.__name__: f for f in (p1_chunks, p1_fill, p1_checks, p2_by_day, p2_all_days, p2_by_week, p6_found, p6_pieces, p7_found, p8_found, p8_items, p9_draws, p9_shares, p10_found, p10_shares)}

_G = (1 + percentiles.ALPHA) / (1 - percentiles.ALPHA)


def _percentile_sql(keys: str) -> str:
    rank = "greatest(1, floor((tot * {p} + 999) / 1000))"
    cols = ", ".join(f"round(min_by({2.0 / (_G + 1)!r} * pow({_G!r}, b), c) filter (c >= {rank.format(p=p)}), 3) p{p // 10}" for p in PERMILLE)
    return f"""with v as (select read_group, cast(run_at as date) as day, cast(date_trunc('week', run_at) as date) as week, abs(cast(isize as bigint)) x from pretty where isize <> 0),
 s as (select {keys}, cast(ceil(ln(x) / {math.log(_G)!r}) as integer) b, count(*) n from v group by all),
 w as (select *, sum(n) over (partition by {keys} order by b) c, sum(n) over (partition by {keys}) tot from s)
 select {keys}, cast(sum(n) as bigint) n, {cols}, cast({percentiles.ALPHA} as double) relative_error from w group by {keys}"""


SQL = {
    "p1_checks": f"""with c as (select name, max(coalesce(size, length(seq))) s from contig group by name)
 select count(*) contigs, cast(sum(greatest(1, ceil(s / {CHUNK}))) as bigint) parts, cast(sum(s) as bigint) bases, cast(0 as bigint) cut_wrong, cast(0 as bigint) overfull from c where s is not null""",
    "p2_by_day": _percentile_sql("read_group, day"),
    "p2_all_days": _percentile_sql("read_group"),
    "p2_by_week": _percentile_sql("read_group, week"),
    "p6_found": rf"""with c as (select name, min_by(seq, contig_id) seq from contig where length(seq) > {PIECE} group by name),
 s as (select name, unnest(string_split_regex(seq, '[NnXx.]{{10,}}')) x from c)
 select name, case when max(length(x)) > {PIECE} then 'forced' else 'boundary' end cut_kind from s group by name""",
    "p7_found": """with d as (select read, score, min(hit_id) hit_id from native_hits where read is not null and score is not null
 group by read, score, genome, strand, genome_start, genome_end, edit)
 select read, hit_id from d qualify row_number() over (partition by read order by score desc, hit_id) <= 5""",
}
