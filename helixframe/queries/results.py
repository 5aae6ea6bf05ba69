"""Queries on hits and alignments: selection, pairs, qualities, merging, statistics and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import alignments as A, probability as P
from helixframe.operators import hit_stats as H, merge as G, pairs as R, select as C
from helixframe.queries.scalars import SQL as SCALARS
from helixframe.sources import sam as S
from helixframe.streaming import events as E
from helixframe.session import table

M = P.letter_model()
GENOME = 3_000_000_000
BEST = 5


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "native_hits").where("read is not null and score is not null")


_H = "h as (select * from native_hits where read is not null and score is not null)"


def topk_hits(spark: SparkSession, d: str) -> DataFrame:
    return C.top_k(_hits(spark, d), ["read"], [F.desc("score"), F.asc("hit_id")], 3).select("read", "hit_id", "rank")


def strata_hits(spark: SparkSession, d: str) -> DataFrame:
    return C.strata(_hits(spark, d), ["read"], F.desc("score")).select("read", "hit_id", "score")


def ties_kept(spark: SparkSession, d: str) -> DataFrame:
    return C.top_with_ties(_hits(spark, d), ["read"], F.desc("score"), 2).select("read", "hit_id", "rank")


def capped_hits(spark: SparkSession, d: str) -> DataFrame:
    return C.capped(_hits(spark, d), ["read"], 10).select("read", "hit_id")


def dedup_start_end(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).where("genome is not null and genome_start is not null and genome_end is not null")
    return C.dominant(h, ["read", "genome", "strand"], "genome_start", "genome_end", [F.desc("score"), F.asc("hit_id")]).select("hit_id")


def _legs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pretty").where("read_id is not null and reference_name is not null and genome_start_unpadded is not null and cigar is not null and score is not null and flags is not null")
    parts = A.cigar_parts(F.col("cigar"))
    n = A.cigar_length(parts, "MIS=X")
    return p.select(
        F.col("read_id").alias("pair_id"), F.col("aln_id").alias("hit"), F.col("reference_name").alias("cn"), F.when(F.col("flags").bitwiseAND(16) != 0, 1).otherwise(0).alias("st"), F.when(F.col("flags").bitwiseAND(128) != 0, 1).otherwise(0).alias("nip"),
        (F.col("genome_start_unpadded") - 1).alias("g_off"), n.alias("w_len"), n.alias("read_len"), "score", F.col("genome_start_unpadded").alias("start"), A.genome_end(F.col("genome_start_unpadded"), parts).alias("end"),
    )


_LEG = """leg as (select read_id pair_id, aln_id hit, reference_name cn, case when flags & 16 <> 0 then 1 else 0 end st, case when flags & 128 <> 0 then 1 else 0 end nip, genome_start_unpadded - 1 g_off,
 cast(regexp_extract(cigar, '^([0-9]+)M$', 1) as integer) n, score, genome_start_unpadded s, genome_start_unpadded + cast(regexp_extract(cigar, '^([0-9]+)M$', 1) as integer) - 1 e
 from pretty where read_id is not null and reference_name is not null and genome_start_unpadded is not null and cigar is not null and score is not null and flags is not null)"""
_PAIR = f"""{_LEG}, pr as (select a.pair_id, a.hit hit0, b.hit hit1, a.cn, a.st, b.g_off - a.g_off delta, a.score + b.score score, a.score s0, b.score s1, a.n n0, b.n n1,
 (case when b.st = 1 then b.e else b.s - 1 end) - (case when a.st = 1 then a.e else a.s - 1 end) size from leg a join leg b on a.pair_id = b.pair_id and a.cn = b.cn and a.st = 1 - b.st and a.nip = 0 and b.nip = 1
 where b.g_off - a.g_off between case when a.st = 0 then 0 - b.n else -1000 + a.n end and case when a.st = 0 then 1000 - b.n else a.n end)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    g = _legs(spark, d)
    return R.pair_hits(g.where("nip = 0"), g.where("nip = 1"))


def pair_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    g = _legs(spark, d)
    ends = [g.where(f"nip = {n}").select(F.col("hit").alias(f"hit{n}"), F.col("start").alias(f"s{n}"), F.col("end").alias(f"e{n}"), (F.col("st") == 1).alias(f"r{n}"), F.col("score").alias(f"score{n}"), F.col("read_len").alias(f"len{n}")) for n in (0, 1)]
    j = _pairs(spark, d).drop("score").join(ends[0], "hit0").join(ends[1], "hit1")
    return j.withColumn("size", A.insert_size(*(F.col(c) for c in ("s0", "e0", "r0", "s1", "e1", "r1"))))


def insert_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _sized(spark, d).select("hit0", "hit1", "size")


def insert_size_hist(spark: SparkSession, d: str) -> DataFrame:
    return R.size_histogram(_sized(spark, d).select(F.abs("size").alias("size")), "size")


def dominant_legs(spark: SparkSession, d: str) -> DataFrame:
    return R.dominant_legs(_pairs(spark, d), _legs(spark, d))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    g = _legs(spark, d)
    return R.paired_quality(g.select("pair_id", "nip", "hit", "score", "read_len"), _sized(spark, d), GENOME)


def paired_mapq(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d)


def best_of_class(spark: SparkSession, d: str) -> DataFrame:
    return R.best_of_class(_paired(spark, d))


def improper_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Best single hits of both mates where single hits alone are weighed."""
    g = _legs(spark, d).withColumn("file", F.lit(0)).withColumn("leg", F.concat_ws(":", "pair_id", "nip"))
    q = G.merge_single(G.partials(g, "leg", "file", "score", "read_len", M), "leg", "file", "hit", "score", 10)
    return R.improper(q.select("pair_id", F.lit("single").alias("kind"), "nip", "hit", "mapq"))


_Q = "case when {p} > 0.99999999 then 0 when {p} < 1e-25 then 250 else cast(trunc(-10.0::double * ln({p}) / 2.302585092994046) as integer) end"
_POST = f"pow(2.0::double, (score - {{n}} * {2 * M.alpha + M.beta!r}::double) / {M.alpha!r}::double)"


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d).where("read_length is not null and genome is not null").select("hit_id", "read", "genome", "score", "read_length")
    return h.withColumn("chunk", F.crc32(F.col("genome")) % 4)


def unpaired_mapq(spark: SparkSession, d: str) -> DataFrame:
    h = _chunked(spark, d).withColumn("chunk", F.lit(0))
    return G.merge_single(G.partials(h, "read", "chunk", "score", "read_length"), "read", "chunk", "hit_id", "score", BEST).select("hit_id", "mapq")


def merge_chunks_mapq(spark: SparkSession, d: str) -> DataFrame:
    """Hits of four genome chunks with their partial sums, merged: the same as without chunks."""
    return G.merge_single(G.partials(_chunked(spark, d), "read", "chunk", "score", "read_length"), "read", "chunk", "hit_id", "score", BEST).select("hit_id", "mapq")


def merged_best_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pretty").where("read_id is not null and mapq is not null and mapq <> 255 and score is not null")
    a, b = (p.where(f"(flags & {bit}) <> 0").select("read_id", "fileno", F.col("aln_id").alias(f"hit{n}"), F.col("mapq").alias(f"q{n}"), F.col("score").alias(f"s{n}")) for n, bit in ((0, 64), (1, 128)))
    j = G.weak_legs(a.join(b, ["read_id", "fileno"]), "q0", "q1", 10)
    j = j.withColumn("q", F.col("q0") + F.col("q1")).withColumn("s", F.col("s0") + F.col("s1")).withColumn("key", F.struct("hit0", "hit1"))
    return G.best_pair_per_file(j, "read_id", "fileno", "q", "s", "key").select("read_id", "fileno", "hit0", "hit1", "q", "weak0", "weak1")


def _good(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = _hits(spark, d)
    return h.select("read").distinct(), h.where("score >= 10 * read_length").select("read")


def mapped_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with an exact hit."""
    r, good = _good(spark, d)
    return r.join(good, "read", "left_semi")


def unmapped_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads without one."""
    r, good = _good(spark, d)
    return r.join(good, "read", "left_anti")


def mapping_stats(spark: SparkSession, d: str) -> DataFrame:
    return H.mapping_stats(_hits(spark, d), "read", "score")


_COUNTED = " and ".join(f"{c} is not null" for c in H.EVENTS)


def event_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates from the partial counts of two sets of reads, as two rates files would give them."""
    h = _hits(spark, d).where(_COUNTED)
    parts = [H.rate_partials(h.where(F.crc32(F.col("read")) % 2 == n), "read", "score", "hit_id") for n in (0, 1)]
    return H.rates(parts[0].unionByName(parts[1]))


def normodds(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("pchance <= 0.001")
    return H.normalised_odds(h, "read", "pgenome", "pchance").select("hit_id", F.round("odds_share", 9).alias("odds_share"))


def top_matches(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("read is not null and pchance <= 0.001 and pgenome >= 0.5")
    return C.top_k(h, ["read"], [F.asc("pchance"), F.asc("hit_id")], 10).select("read", "hit_id", "rank")


def pgenome(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where(_COUNTED + " and matches + mismatches > 2")
    f = H.genome_probability(0.002, 0.01, 0.005)
    return h.select("hit_id", F.round(f("matches", "mismatches", F.col("insertions") + F.col("deletions"), "crossovers"), 6).alias("p"))


def pchance(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where(_COUNTED + " and edit is not null and read_length is not null")
    f = H.chance_probability(GENOME)
    return h.select("hit_id", F.round(f("matches", "mismatches", "crossovers", "read_length", A.indel_sizes(F.col("edit"), "("), A.indel_sizes(F.col("edit"), "-")), 12).alias("p"))


def _concordant(spark: SparkSession, d: str) -> DataFrame:
    """Mates as runs that read both of a pair from the same strand give them: the second turned round."""
    g = _legs(spark, d).withColumn("strand", F.when((F.col("st") == 1) != (F.col("nip") == 1), "-").otherwise("+"))
    t = g.select(F.col("pair_id").alias("root"), F.col("cn").alias("genome"), "hit", "strand", "start", "end", "nip")
    return R.concordant(t.where("nip = 0"), t.where("nip = 1"), "root", 1_000_000_000)


def concordant_mates(spark: SparkSession, d: str) -> DataFrame:
    return _concordant(spark, d).select("root", "fwd", "rev", "dist")


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return _sized(spark, d).select("pair_id", F.abs("size").alias("dist"))


def matepair_distance_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.distance_stats(_distances(spark, d), "pair_id")


def matepair_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return R.cumulative_from_mean(_distances(spark, d), 10_000)


def adjacent_mates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pretty").where("read_name is not null and flags is not null")
    p = p.withColumn("first", F.col("flags").bitwiseAND(64) != 0).withColumn("second", F.col("flags").bitwiseAND(128) != 0)
    return R.adjacent_mates(p, "read_name", "aln_id", "first", "second")


def suffix_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.suffix_pairs(table(spark, d, "native_hits").where("read is not null").select("read"), "read", ("_F3", "_R3"))


def _sam(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("read is not null and edit is not null and read_length is not null and read_start is not null and read_end is not null")
    fields = {"qname": F.col("read"), "flag": F.when(F.col("strand") == "-", 16).otherwise(0), "rname": F.col("genome"), "pos": F.least("genome_start", "genome_end"), "cigar": A.edit_to_cigar(F.col("edit"), F.col("read_start"), F.col("read_end"), F.col("read_length"))}
    return h.select("hit_id", S.render(fields, {"AS:i": F.col("score"), "NM:i": F.col("mismatches") + F.col("insertions") + F.col("deletions")}).alias("line"))


def sam_render(spark: SparkSession, d: str) -> DataFrame:
    return _sam(spark, d)


def sam_parse(spark: SparkSession, d: str) -> DataFrame:
    p = S.parse(_sam(spark, d))
    return p.select("hit_id", "qname", "flag", "rname", "pos", "mapq", "rnext", p.tags["AS"].cast("int").alias("score"), p.tags["NM"].cast("int").alias("nm"))


def sam_header_merge(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genome_contigs")
    return S.merge_headers(S.header(g.where("cn < 40")).withColumn("file_no", F.lit(0)).unionByName(S.header(g.where("cn >= 20")).withColumn("file_no", F.lit(1))))


def sam_genome_length(spark: SparkSession, d: str) -> DataFrame:
    return S.genome_length(sam_header_merge(spark, d))


def native_render(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("read is not null")
    names = {"readname": "read", "contigname": "genome", "strand": "strand", "contigstart": "genome_start", "contigend": "genome_end", "readstart": "read_start", "readend": "read_end", "readlength": "read_length", "score": "score", "editstring": "edit"}
    return h.select("hit_id", S.native_line({k: F.col(c) for k, c in names.items()}).alias("line"))


def pairedness(spark: SparkSession, d: str) -> DataFrame:
    return G.pairedness(table(spark, d, "pretty").where("flags is not null"), "read_name", "flags")


def collapse_expand_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two lines a pair to one row and back; of repeated lines of a mate the last by text stays."""
    p = table(spark, d, "pretty").where("read_id is not null and flags is not null").withColumn("nip", F.when(F.col("flags").bitwiseAND(128) != 0, 1).otherwise(0))
    p = p.withColumn("line", F.concat_ws(":", F.col("flags").cast("string"), F.coalesce("cigar", F.lit("*"))))
    return G.expand_pairs(G.collapse_pairs(p, "read_id", "nip", "line"), "read_id")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    s = E.stream_of(spark, f"{d}/events.parquet")
    return E.drain(E.tumbling(s, "ts", "event_type", "value"), "stream_windows")


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"), "ts", "user_id")


QUERIES = {
    f.__name__: f
    for f in (
        topk_hits, strata_hits, ties_kept, capped_hits, dedup_start_end, pair_interval_join, insert_sizes, insert_size_hist, dominant_legs, paired_mapq,
        best_of_class, improper_pairs, unpaired_mapq, merge_chunks_mapq, merged_best_pairs, mapped_reads, unmapped_reads, mapping_stats, event_rates,
        normodds, top_matches, pgenome, pchance, concordant_mates, matepair_distance_stats, matepair_cumulative, adjacent_mates, suffix_pairs, sam_render, sam_parse,
        sam_header_merge, sam_genome_length, native_render, pairedness, collapse_expand_pairs, stream_windows, session_counts,
    )
}

_MAPQ = f"""with h as (select hit_id, read, score, read_length n from native_hits where read is not null and score is not null and read_length is not null and genome is not null),
 z as (select *, {_POST.format(n='n')} z0 from h), s as (select read, sum(z0) z1 from z group by read),
 t as (select * from z qualify row_number() over (partition by read order by score desc, hit_id) <= {BEST}), q as (select hit_id, 1 - z0 / z1 p from t join s using (read)),
 r as (select hit_id, {_Q.format(p='p')} mapq from q) select hit_id, case when mapq < 4 then 0 else mapq end mapq from r"""
_SZ = f"with {_PAIR}"
_CONC = f"""with {_LEG}, t as (select *, case when (st = 1) <> (nip = 1) then '-' else '+' end strand from leg),
 j as (select a.pair_id root, a.hit fwd, b.hit rev, case when a.s < b.s then a.s else a.e end cf, case when a.s < b.s then b.e else b.s end cr, a.strand from t a join t b on a.pair_id = b.pair_id and a.cn = b.cn and a.strand = b.strand and a.nip = 0 and b.nip = 1),
 k as (select root, fwd, rev, abs(cf - cr) dist from j where abs(cf - cr) < 1000000000 and abs(cf - cr) > 0 and ((strand = '+' and cr < cf) or (strand = '-' and cf < cr)))"""


def _chance(score: str, n: str) -> str:
    e = f"ceil(({n} * {M.match} - {score}) / {float(abs(M.mismatch - M.match))}::double)"
    return f"(case when {score} > {n} * {M.match} then 1e-200::double else exp(case when {e} > {n} or {e} < 0 then 0 else lgamma({n} + 1) - lgamma({e} + 1) - lgamma({n} - {e} + 1) end + {e} * ln(3.0) - {n} * ln(4.0)) end)"


EDIT_TO_CIGAR = SCALARS["edit_to_cigar"]
_SAMF = """f as (select hit_id, read qname, case when strand = '-' then 16 else 0 end flag, genome rname, least(genome_start, genome_end) pos, score, mismatches + insertions + deletions nm, edit, read_start, read_end, read_length from native_hits
 where read is not null and edit is not null and read_length is not null and read_start is not null and read_end is not null)"""
_HEAD = """hd as (select 0 f, * from genome_contigs where cn < 40 union all select 1, * from genome_contigs where cn >= 20),
 m as (select distinct 2 as rank, '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || len line from hd union all select 1, '@HD' || chr(9) || 'VN:1.0' || chr(9) || 'SO:unsorted' union all select 4, '@PG' || chr(9) || 'ID:' || f || '-helixframe' || chr(9) || 'VN:0.1.0' from (values (0), (1)) v(f))"""

SQL = {
    "topk_hits": f"with {_H} select read, hit_id, cast(row_number() over (partition by read order by score desc, hit_id) as integer) as rank from h qualify row_number() over (partition by read order by score desc, hit_id) <= 3",
    "strata_hits": f"with {_H} select read, hit_id, score from h qualify rank() over (partition by read order by score desc) = 1",
    "ties_kept": f"with {_H} select read, hit_id, cast(rank() over (partition by read order by score desc) as integer) as rank from h qualify rank() over (partition by read order by score desc) <= 2",
    "capped_hits": f"with {_H} select read, hit_id from h qualify count(*) over (partition by read) <= 10",
    "dedup_start_end": f"""with {_H}, a as (select * from h where genome is not null and genome_start is not null and genome_end is not null qualify row_number() over (partition by read, genome, strand, genome_start order by score desc, hit_id) = 1)
 select hit_id from a qualify row_number() over (partition by read, genome, strand, genome_end order by score desc, hit_id) = 1""",
    "pair_interval_join": f"{_SZ} select pair_id, hit0, hit1, cn, st, delta, score from pr",
    "insert_sizes": f"{_SZ} select hit0, hit1, size from pr",
    "insert_size_hist": f"{_SZ}, b as (select cast(least(greatest(floor(abs(size) / 10.0), 0), 99) as integer) bucket, count(*) n from pr group by 1) select bucket, n, round(n / sum(n) over (), 9) share from b",
    "mapped_reads": f"with {_H} select distinct read from h where score >= 10 * read_length",
    "unmapped_reads": f"with {_H} select distinct read from h where read not in (select read from h where score >= 10 * read_length)",
    "unpaired_mapq": _MAPQ,
    "merge_chunks_mapq": _MAPQ,
    "improper_pairs": f"""with {_LEG}, z as (select *, {_POST.format(n='n')} z0 from leg), s as (select pair_id, nip, sum(z0) z1 from z group by all), t as (select * from z qualify row_number() over (partition by pair_id, nip order by score desc, hit) <= 10),
 q as (select pair_id, nip, hit, 1 - z0 / z1 p from t join s using (pair_id, nip)), r as (select *, {_Q.format(p='p')} mapq from q), b as (select * from r where true qualify row_number() over (partition by pair_id, nip order by case when mapq < 4 then 0 else mapq end desc, hit) = 1)
 select a.pair_id, a.hit hit0, a.mapq mapq0, c.hit hit1, c.mapq mapq1 from b a join b c on a.pair_id = c.pair_id and a.nip = 0 and c.nip = 1 and a.mapq >= 10 and c.mapq >= 10""",
    "merged_best_pairs": """with p as (select * from pretty where read_id is not null and mapq is not null and mapq <> 255 and score is not null),
 j as (select a.read_id, a.fileno, a.aln_id hit0, b.aln_id hit1, a.mapq + b.mapq q, a.score + b.score s, a.mapq < 10 weak0, b.mapq < 10 weak1 from p a join p b on a.read_id = b.read_id and a.fileno = b.fileno and a.flags & 64 <> 0 and b.flags & 128 <> 0 where a.mapq >= 10 or b.mapq >= 10)
 select read_id, fileno, hit0, hit1, q, weak0, weak1 from j qualify row_number() over (partition by read_id, fileno order by q desc, s desc, hit0, hit1) = 1""",
    "mapping_stats": f"""with {_H}, r as (select read, count(*) n, max(score) m from h group by read), t as (select read, count(*) c from h join r using (read) where score = m group by read)
 select count(*) reads, cast(sum(n) as bigint) hits, count(*) filter (n = 1) unique_hit, count(*) filter (c = 1) unique_top_hit, round(sum(n) / count(*), 2) hits_per_read from r join t using (read)""",
    "event_rates": f"""with {_H}, b as (select * from h where {_COUNTED} qualify row_number() over (partition by read order by score desc, hit_id) = 1),
 t as (select count(*) samples, {', '.join(f'cast(sum({c}) as bigint) {c}' for c in H.EVENTS)} from b)
 select *, {', '.join(f'round(case when {x} > 0 then ({x}) / (matches + mismatches) else 1e-9 end, 12) {n}' for x, n in (('crossovers', 'erate'), ('mismatches', 'srate'), ('insertions + deletions', 'irate'), ('matches', 'mrate')))} from t""",
    "normodds": "with h as (select hit_id, read, pgenome / pchance o from native_hits where read is not null and pchance <= 0.001 and pchance > 0 and pgenome is not null) select hit_id, round(o / sum(o) over (partition by read), 9) odds_share from h",
    "top_matches": "select read, hit_id, cast(row_number() over (partition by read order by pchance, hit_id) as integer) as rank from native_hits where read is not null and pchance <= 0.001 and pgenome >= 0.5 qualify row_number() over (partition by read order by pchance, hit_id) <= 10",
    "pgenome": "with h as (select hit_id, matches + mismatches k, mismatches s, insertions + deletions i, crossovers e from native_hits where " + _COUNTED + " and matches + mismatches > 2), c as (select *, "
    + ", ".join(
        f"1 - coalesce(list_sum(list_transform(range(0, {n}), lambda x: exp(case when x > {k} then 0 else lgamma({k} + 1) - lgamma(x + 1) - lgamma({k} - x + 1) end + x * ln({r}::double) + ({k} - x) * ln(1 - {r}::double)))), 0) {a}"
        for n, k, r, a in (("e", "(k - 1)", 0.002, "pe"), ("s", "(k - 2 - e)", 0.01, "ps"), ("i", "(k - 1)", 0.005, "pi"))
    )
    + " from h) select hit_id, round(least(greatest(pe * ps * pi, 1e-9), 1 - 1e-9), 6) p from c",
    "concordant_mates": f"{_CONC} select root, fwd, rev, dist from k",
    "matepair_distance_stats": f"{_SZ}, o as (select pair_id, min(abs(size)) dist from pr group by pair_id having count(*) = 1) select count(*) n, round(avg(dist), 6) mean, round(stddev_pop(dist), 6) deviation from o",
    "matepair_cumulative": f"""{_SZ}, k as (select abs(size) dist from pr), m as (select avg(dist) mean, count(*) a from k), b as (select abs(cast(floor(dist / 10000 * 2000) as integer) - cast(floor(mean / 10000 * 2000) as integer)) bin, a, count(*) n from k, m group by all)
 select bin, n, round(greatest(1 - sum(n) over (order by bin rows unbounded preceding) / a, 0), 9) above from b""",
    "adjacent_mates": """with s as (select read_name, aln_id, case when flags & 64 <> 0 then 0 else 1 end side, row_number() over (partition by read_name, case when flags & 64 <> 0 then 0 else 1 end order by aln_id) k from pretty where read_name is not null and flags is not null and flags & 192 <> 0)
 select read_name, a.aln_id row0, b.aln_id row1 from (select * from s where side = 0) a full join (select * from s where side = 1) b using (read_name, k)""",
    "suffix_pairs": "with r as (select distinct read, left(read, length(read) - 3) root from native_hits where read is not null) select root, a.read as first, b.read as second from (select * from r where read like '%\\_F3' escape '\\') a full join (select * from r where read like '%\\_R3' escape '\\') b using (root)",
    "sam_render": f"""with {_SAMF}, c as ({EDIT_TO_CIGAR}) select hit_id, array_to_string([qname, cast(flag as varchar), coalesce(rname, '*'), cast(coalesce(pos, 0) as varchar), '255', coalesce(cigar, '*'), '*', '0', '0', '*', '*'], chr(9)) || coalesce(chr(9) || 'AS:i:' || score, '') || coalesce(chr(9) || 'NM:i:' || nm, '') line from f join c using (hit_id)""",
    "dominant_legs": f"""{_SZ}, """ + ", ".join(
        f"""u{k} as (select distinct p.pair_id, p.hit{leg} h, l.cn, l.st, l.{at}, l.score from {'pr' if k == 0 else f'd{k - 1}'} p join leg l on l.pair_id = p.pair_id and l.hit = p.hit{leg}),
 b{k} as (select pair_id, h, first_value(h) over (partition by pair_id, cn, st, {at} order by score desc, h) b from u{k}), d{k} as (select p.pair_id, {'b.b hit0, p.hit1' if leg == 0 else 'p.hit0, b.b hit1'} from {'pr' if k == 0 else f'd{k - 1}'} p join b{k} b on b.pair_id = p.pair_id and b.h = p.hit{leg})"""
        for k, (at, leg) in enumerate((("s", 0), ("s", 1), ("e", 0), ("e", 1)))
    )
    + " select distinct pair_id, hit0, hit1 from d3",
    "sam_parse": f"with {_SAMF} select hit_id, qname, flag, rname, case when pos <> 0 then pos end pos, null::bigint mapq, null::varchar rnext, score, nm from f",
    "sam_header_merge": f"with {_HEAD} select * from m",
    "sam_genome_length": "select count(*) contigs, cast(sum(len) as bigint) genome_length from genome_contigs",
    "native_render": "select hit_id, '>' || " + " || chr(9) || ".join(f"coalesce(cast({c} as varchar), '')" for c in ("read", "genome", "strand", "genome_start", "genome_end", "read_start", "read_end", "read_length", "score", "edit")) + " line from native_hits where read is not null",
    "pairedness": "select count(*) as rows, cast(sum(flags & 1) as bigint) paired, case when sum(flags & 1) = 0 then 'single' when sum(flags & 1) = count(*) then 'paired' else 'mixed' end kind from pretty where flags is not null",
    "collapse_expand_pairs": "select read_id, cast(case when flags & 128 <> 0 then 1 else 0 end as integer) nip, max(flags || ':' || coalesce(cigar, '*')) line from pretty where read_id is not null and flags is not null group by 1, 2",
    "stream_windows": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value), 6) total from events group by all",
    "session_counts": """with l as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end f from events window w as (partition by user_id order by ts)),
 s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from l) select user_id, min(ts) as start, max(ts) + interval '30 minutes' stop, count(*) n from s group by user_id, k""",
}
