"""Queries p3, p4 and p5 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.operators import intervals, row_parsing, skewed_keys
from helixframe.session import table


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "native_hits").select("read", "genome", "score", *skewed_keys.file_block())
    kinds = F.array(*(F.struct(F.lit(k).alias("key_kind"), F.col(k).alias("key_value")) for k in ("genome", "read")))
    return hits.select(F.inline(kinds), "score", "block", "at")


def _key_statistics(spark: SparkSession, d: str) -> DataFrame:
    return skewed_keys.key_statistics(_keyed(spark, d), ["key_kind", "key_value"], "score")


def p3_key_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _key_statistics(spark, d)
    return s.select("key_kind", "key_value", "n_hits", "n_scored", F.col("best_score").cast("int").alias("best_score"), F.round("mean_score", 6).alias("mean_score"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skewed_keys.heavy_keys(_key_statistics(spark, d), _keyed(spark, d), "key_kind", "key_value").select("key_kind", "key_value")


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_intervals(table(spark, d, "native_hits"), "genome", "genome_start", "genome_end")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_periods(spark, d).where("kind = 'covered' or pos_to - pos_from + 1 <= 5000")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return row_parsing.failures(table(spark, d, "raw_hits"))


def p5_native_hits(spark: SparkSession, d: str) -> DataFrame:
    return row_parsing.native_hits(table(spark, d, "raw_hits"))


QUERIES = {f.__name__: f for f in (p3_key_stats, p3_found, p4_periods, p4_found, p5_found, p5_native_hits)}

_KEYS = """select 'genome' key_kind, genome key_value, score from native_hits union all select 'read', read, score from native_hits"""
_PERIODS = """with iv as (select distinct genome, least(genome_start, genome_end) lo, greatest(genome_start, genome_end) hi from native_hits
 where genome is not null and genome_start is not null and genome_end is not null),
 m as (select genome, lo, hi, max(hi) over (partition by genome order by lo, hi rows between unbounded preceding and 1 preceding) before from iv),
 g as (select *, case when before is null or lo > before + 1 then 1 else 0 end fresh from m),
 k as (select *, sum(fresh) over (partition by genome order by lo, hi rows unbounded preceding) island from g),
 c as (select genome, island, min(lo) pos_from, max(hi) pos_to from k group by genome, island),
 n as (select genome, pos_to + 1 pos_from, lead(pos_from) over (partition by genome order by island) - 1 pos_to from c),
 r as (select genome, 'covered' kind, pos_from, pos_to from c union all select genome, 'gap', pos_from, pos_to from n where pos_to is not null)"""
_F = r"""("([^"]|"")*"|[^"\t]*)"""
_CLASSIFIED = rf"""with l as (select *, case when line like '#FORMAT:%' then string_split_regex(trim(line[9:]), '\s+') end h from raw_hits),
 f as (select *, last_value(h ignore nulls) over (partition by file_no order by line_no rows unbounded preceding) cols from l),
 b as (select line_id, cols, line[2:] body from f where line like '>%'),
 s as (select *, case when regexp_full_match(body, '{_F}(\t{_F})*', 's') then regexp_extract_all(chr(9) || body, '\t{_F}', 1) end raw from b),
 u as (select *, list_transform(raw, lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else x end) vals from s),
 v as (select *, trim(vals[list_position(cols, 'score')]) sc, trim(vals[list_position(cols, 'editstring')]) ed from u),
 w as (select *, case when raw is null then 'quoting' when len(raw) <> len(cols) then 'columns'
  when not (regexp_full_match(sc, '-?[0-9]+') and try_cast(sc as integer) is not null) then 'score'
  when not regexp_full_match(ed, '([0-9]|[ACGTN]|x|-|\([ACGTUMRWSYKVHDBNX]+\))+', 'i') then 'edit' end reason from v)"""
_TYPES = "".join(
    f", {'try_cast(' * (t != 'string')}trim(vals[list_position(cols, '{c}')]){f' as {t})' * (t != 'string')} as {c}" for c, t in row_parsing.NATIVE.items()
)

SQL = {
    "p3_key_stats": f"select key_kind, key_value, count(*) n_hits, count(score) n_scored, max(score) best_score, round(avg(score), 6) mean_score from ({_KEYS}) group by all",
    "p3_found": f"select key_kind, key_value from ({_KEYS}) where key_value is not null group by all having count(*) >= 0.03 * (select count(*) from native_hits)",
    "p4_periods": f"{_PERIODS} select * from r",
    "p4_found": f"{_PERIODS} select * from r where kind = 'covered' or pos_to - pos_from + 1 <= 5000",
    "p5_found": f"{_CLASSIFIED} select line_id, reason from w where reason is not null",
    "p5_native_hits": f"{_CLASSIFIED} select line_id{_TYPES} from w where reason is null",
}
