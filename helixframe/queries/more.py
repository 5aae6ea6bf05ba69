"""Queries on pairs of every orientation, filters of reads and rows, lookups and reports, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import alignments as A
from helixframe.operators import pairs as R, reads as D, seeds as X, skewed_keys
from helixframe.plans import paired as PP
from helixframe.queries import results as Q, views as V
from helixframe.queries.mapping import SEEDS, SQL as MAPPING
from helixframe.queries.scalars import SQL as SCALARS
from helixframe.session import shared_folder, table

BEST_PAIRS, LEAST_PAIR_SCORE = 2, 500


def _mode(spark: SparkSession, d: str, mode: str) -> DataFrame:
    g = Q._legs(spark, d)
    return R.pair_hits(g.where("nip = 0"), g.where("nip = 1"), mode)


def pairs_outward(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, "opp-out")


def pairs_forward(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, "col-fw")


def pairs_backward(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, "col-bw")


def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.top_pairs(Q._pairs(spark, d), BEST_PAIRS, LEAST_PAIR_SCORE).select("pair_id", "hit0", "hit1", "score", "rank")


def best_mates(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "pretty").where("mapq <> 255").select(F.col("aln_id").alias("hit"), "mapq")
    return R.best_mates(Q._pairs(spark, d), q)


def map_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Read pairs mapped end to end: reads of the contigs and their mates."""
    r = V.reads(spark, d)
    p = PP.map_pairs(r.select(F.col("read_id").alias("pair_id"), F.col("seq").alias("seq0"), F.when(F.col("st") == 1, F.col("mate_fw")).otherwise(F.col("mate")).alias("seq1")), V.contigs(spark, d), PP.PairOptions(seeds=SEEDS))
    return p.select("pair_id", "cn", "st", "start0", "start1", "size", "score", "rank")


def usable_reads(spark: SparkSession, d: str) -> DataFrame:
    """Hits' reads of at most 60 bases."""
    h = table(spark, d, "native_hits").where("read is not null")
    return D.usable(h, F.col("read_length"), F.lit(None).cast("double"), 60).select("read", "read_length").distinct()


def usable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Alignment rows of pairs without a row below the least quality, qualities of alignments taken for those of reads."""
    p = table(spark, d, "pretty").where("read_id is not null")
    return D.usable(p, F.lit(0), F.col("mapq"), pair="read_id").select("aln_id")


def clipped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hits of which an end isn't aligned."""
    h = table(spark, d, "native_hits").where("edit is not null and read_length is not null and read_start is not null and read_end is not null")
    c = h.select("hit_id", A.edit_to_cigar(F.col("edit"), F.col("read_start"), F.col("read_end"), F.col("read_length")).alias("cigar"))
    return D.clipped(c, "cigar", "HS")


def rows_of_reads(spark: SparkSession, d: str) -> DataFrame:
    """Names of the hits' reads with a mate number, beside the hits of their plain names."""
    h = table(spark, d, "native_hits").where("read is not null")
    names = h.select(F.concat("read", F.lit("/1 lane 3")).alias("name")).distinct()
    return D.rows_of_reads(names, h.select("read", "hit_id"), "name", "read").select("name", "hit_id")


def bases_of_hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("genome_start is not null and genome_end is not null").select("hit_id", "genome", "genome_start", "genome_end")
    return D.bases_of_hits(h, V.contigs(spark, d), "genome", "genome_start", "genome_end").select("hit_id", "bases")


def split_at_skips(spark: SparkSession, d: str) -> DataFrame:
    """Alignments as if each were followed by another one 100 bases on."""
    p = table(spark, d, "pretty").where("genome_start_unpadded is not null").withColumn("cigar", F.concat("cigar", F.lit("100N2S"), "cigar"))
    return D.split_at_skips(p.select("aln_id", "genome_start_unpadded", "cigar"), "genome_start_unpadded", "cigar").select("aln_id", "part", "part_start", "part_cigar")


def distance_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.distance_counts(table(spark, d, "pretty"), "read_name", "edit_distance")


def run_report(spark: SparkSession, d: str) -> DataFrame:
    """Hits of one score class against all reads that are known."""
    h = table(spark, d, "native_hits").select("read", "genome", "strand", "genome_start", "genome_end", "score", "edit")
    return D.run_report(h, h.where("score >= 300"), "read")


def grouped_integers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genome_contigs").select("cn", F.format_number("len", 0).alias("len"), F.format_number("g_offset", 0).alias("g_offset"))


def saved_index(spark: SparkSession, d: str) -> DataFrame:
    """An index written and one seed of it loaded again."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    X.save_index(X.kmers(V.contigs(spark, d), ["cn"], "seq", SEEDS, spread=True), path)
    return X.load_index(spark, path, [1]).groupBy("cn").agg(F.count(F.lit(1)).alias("postings"), F.sum("pos").alias("pos_sum"))


def p3_split_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold more than a chunk of SPLIT rows: the hottest ones are cut into several chunks and merged again."""
    h = table(spark, d, "native_hits").select("genome", "score", *skewed_keys.file_block(SPLIT))
    s = skewed_keys.key_statistics(h, ["genome"], "score", SPLIT)
    # a key of n rows lies in ceil(n / SPLIT) chunks, or in one more where it doesn't begin with one
    fits = (F.col("n_chunks") - F.ceil(F.col("n_hits") / SPLIT)).isin(0, 1)
    return s.where(F.col("n_hits") > SPLIT).select("genome", "n_hits", "best_score", fits.alias("cut_as_due"), (F.col("n_chunks") > 1).alias("is_split"))


SPLIT = 500
QUERIES = {
    f.__name__: f
    for f in (
        pairs_outward, pairs_forward, pairs_backward, top_pairs, best_mates, map_pairs, usable_reads, usable_pairs, clipped_rows, rows_of_reads, bases_of_hits,
        split_at_skips, distance_counts, run_report, grouped_integers, saved_index, p3_split_keys,
    )
}


def _pairs_sql(shift: str) -> str:
    return f"""with {Q._LEG} select a.pair_id, a.hit hit0, b.hit hit1, a.cn, a.st, b.g_off - a.g_off delta, a.score + b.score score from leg a join leg b on a.pair_id = b.pair_id and a.cn = b.cn and a.st = 1 - b.st and a.nip = 0 and b.nip = 1
 where b.g_off - a.g_off between case when a.st = 0 then 0 - b.n + {shift} else -1000 + a.n - {shift} end and case when a.st = 0 then 1000 - b.n + {shift} else a.n - {shift} end"""


_COLS = "read, genome, strand, genome_start, genome_end, score, edit"
SQL = {
    "pairs_outward": _pairs_sql("(a.n + b.n)"),
    "pairs_forward": _pairs_sql("b.n"),
    "pairs_backward": _pairs_sql("a.n"),
    "top_pairs": f"with {Q._PAIR} select pair_id, hit0, hit1, score, cast(row_number() over (partition by pair_id order by score desc, hit0, hit1) as integer) as rank from pr where score >= {LEAST_PAIR_SCORE} qualify row_number() over (partition by pair_id order by score desc, hit0, hit1) <= {BEST_PAIRS}",
    "best_mates": f"with {Q._PAIR} select pair_id, hit0, hit1, mapq from pr join pretty on aln_id = hit1 where mapq <> 255 qualify row_number() over (partition by pair_id, hit0 order by mapq desc, hit1) = 1",
    "usable_reads": "select distinct read, read_length from native_hits where read is not null and read_length <= 60",
    "usable_pairs": "select aln_id from pretty where read_id is not null qualify coalesce(min(mapq) over (partition by read_id), 10) >= 10",
    "clipped_rows": f"select * from ({SCALARS['edit_to_cigar']}) where cigar like '%S%' or cigar like '%H%'",
    "rows_of_reads": "select read || '/1 lane 3' name, hit_id from native_hits where read is not null",
    "bases_of_hits": f"with {V.CONTIGS} select hit_id, substr(seq, least(genome_start, genome_end), abs(genome_end - genome_start) + 1) bases from native_hits join contigs on genome = name where least(genome_start, genome_end) >= 1 and greatest(genome_start, genome_end) <= len and abs(genome_end - genome_start) < 1024",
    "split_at_skips": """with p as (select aln_id, genome_start_unpadded s, cigar, cast(regexp_extract(cigar, '^([0-9]+)M$', 1) as integer) n from pretty where genome_start_unpadded is not null and cigar is not null)
 select aln_id, cast(0 as integer) part, s part_start, cigar part_cigar from p union all select aln_id, 1, s + n + 100, '2S' || cigar from p""",
    "distance_counts": "select read_name, count(*) filter (edit_distance = 0) h0, count(*) filter (edit_distance = 1) h1, count(*) filter (edit_distance = 2) h2 from pretty where read_name is not null group by 1",
    "run_report": f"""with r as (select count(distinct read) reads from native_hits), h as (select * from native_hits where score >= 300), u as (select {_COLS}, count(*) c from h group by all),
 m as (select count(distinct read) matched, count(*) hits, count(read) named from h), a as (select cast(sum(c - 1) as bigint) repeated from u)
 select reads, matched, reads - matched unmatched, hits, repeated, round(named / matched, 6) hits_per_read from r, m, a""",
    "saved_index": f"select cn, postings, pos_sum from ({MAPPING['kmer_index']}) where sn = 1",
    "grouped_integers": "select cn, format('{:,}', len) len, format('{:,}', g_offset) g_offset from genome_contigs",
    "p3_split_keys": f"select genome, count(*) n_hits, max(cast(score as bigint)) best_score, true cut_as_due, true is_split from native_hits group by 1 having count(*) > {SPLIT}",
}
