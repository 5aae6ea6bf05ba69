"""Queries of the mapping stages with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import alphabet as S
from helixframe.functions.probability import LETTER
from helixframe.operators import anchors as A, blocks as B, kernels as K, seeds as X, select as C
from helixframe.plans import mapping as M
from helixframe.queries.views import CONTIGS, READ_LEN, READS, contigs, reads
from helixframe.session import cut, table

SEEDS = (X.CONTIGUOUS, X.SPACED)
CUTOFF = 2


def _index(spark: SparkSession, d: str) -> DataFrame:
    return X.kmers(contigs(spark, d), ["cn"], "seq", SEEDS, spread=True)


def kmer_index(spark: SparkSession, d: str) -> DataFrame:
    """Postings of every contig: how many, how many distinct keys, and the sum of their positions."""
    return _index(spark, d).groupBy("cn", "sn").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("key").alias("keys"), F.sum("pos").alias("pos_sum"))


def index_list_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.list_stats(_index(spark, d), SEEDS)


def index_list_histogram(spark: SparkSession, d: str) -> DataFrame:
    return X.list_histogram(_index(spark, d))


def heavy_key_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return B.light_postings(contigs(spark, d), SEEDS, CUTOFF)


def contig_offsets(spark: SparkSession, d: str) -> DataFrame:
    return X.contig_offsets(table(spark, d, "genome_contigs").select("cn", "name", "len"))


def contig_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Contig of every absolute position of a hit, as of the contigs' offsets."""
    g = table(spark, d, "genome_contigs")
    h = table(spark, d, "native_hits").where("genome_start is not null")
    at = h.join(F.broadcast(g.select("name", "g_offset")), h["genome"] == F.col("name")).select("hit_id", (F.col("g_offset") + F.col("genome_start") - 1).alias("at"))  # 67 contigs, fixed
    return M.contig_at(at, "hit_id", "at", g.select("cn", F.col("name"), F.col("g_offset")))


def _stranded(spark: SparkSession, d: str) -> DataFrame:
    return A.both_strands(reads(spark, d))


def seed_join_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of every stranded read, with the index cut as in production."""
    return B.anchor_sums(_stranded(spark, d), contigs(spark, d), SEEDS, M.Options.cutoff, READ_LEN)


def region_support(spark: SparkSession, d: str) -> DataFrame:
    a = B.supported_anchors(_stranded(spark, d), contigs(spark, d), SEEDS, M.Options.cutoff, READ_LEN)
    return a.groupBy("read_id", "st").agg(F.count(F.lit(1)).alias("anchors"), F.sum("x").alias("x_sum"))


def _first_seed_islands(spark: SparkSession, d: str, least: tuple[int, int] | None) -> DataFrame:
    return B.islands(_stranded(spark, d), contigs(spark, d), (X.CONTIGUOUS,), M.Options.cutoff, READ_LEN, M.Options.window_pct, support=False, least=least)


def diagonal_islands(spark: SparkSession, d: str) -> DataFrame:
    return A.with_big_gap(_first_seed_islands(spark, d, None).drop("read_len", "contig_len"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Candidate windows; islands that can't make one are left out as they are found."""
    return A.candidate_windows(_first_seed_islands(spark, d, (M.Options.window_threshold_pct, LETTER["match"])), "read_len", "contig_len", LETTER["match"], LETTER["open"], LETTER["ext_ins"])


def two_anchor_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    w = A.window_text(_windows(spark, d), contigs(spark, d).select("cn", "seq"))
    s = _stranded(spark, d)
    return cut(w.join(s, ["read_id", "st"]))


def gapless_score(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    shift = (F.col("x") - F.col("g_off") - F.col("y")).cast("int")
    return s.select("read_id", "st", "cn", "x", "y", K.gapless_score(F.col("text"), F.col("seq"), shift).alias("score"))


def sw_score(spark: SparkSession, d: str) -> DataFrame:
    return K.score_windows(_scored(spark, d)).select("read_id", "st", "cn", "g_off", "score_vec")


def overlap_suppression(spark: SparkSession, d: str) -> DataFrame:
    w = K.score_windows(_scored(spark, d)).withColumn("passes", F.col("score_vec") >= 0.5 * LETTER["match"] * F.length("seq"))
    return C.suppress_overlaps(w.select("read_id", "st", "cn", "g_off", "w_len", "x", "y", "score_vec", "passes"))


def colour_align(spark: SparkSession, d: str) -> DataFrame:
    """Forward reads as colours with one colour changed, aligned to the letters they come from."""
    r = reads(spark, d).where("st = 0")
    w = r.select("read_id", "cn", F.greatest(F.col("pos") - 7, F.lit(0)).cast("bigint").alias("g_off"), F.lit(50).alias("w_len"), "seq")
    w = A.window_text(w, contigs(spark, d).select("cn", "seq"))
    c = S.letters_to_colours(F.col("seq"))
    wrong = F.concat(F.substring(c, F.lit(1), F.lit(20)), F.translate(F.substring(c, F.lit(21), F.lit(1)), "0123", "1230"), F.substring(c, F.lit(22), F.lit(100)))
    a = w.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "read_id").withColumn("a", K.colour_alignment("text", wrong))
    return a.select("read_id", "cn", (F.col("g_off") + F.col("a.start") + 1).alias("genome_start"), "a.score", "a.crossovers", "a.ops")


def full_align(spark: SparkSession, d: str) -> DataFrame:
    return M.map_reads(reads(spark, d), contigs(spark, d)).select("read_id", "st", "cn", "genome_start", "cigar", "edit", "score", "rank")


def map_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return M.with_quality(M.map_reads(reads(spark, d), contigs(spark, d))).select("read_id", "st", "cn", "genome_start", "genome_end", "cigar", "edit", "score", "mapq")


QUERIES = {
    f.__name__: f
    for f in (
        kmer_index, index_list_stats, index_list_histogram, heavy_key_cutoff, contig_offsets, contig_lookup, seed_join_anchors, region_support,
        diagonal_islands, two_anchor_windows, gapless_score, sw_score, overlap_suppression, colour_align, full_align, map_unpaired,
    )
}


def _spaced(w: str) -> str:
    return f"{w}[1:4] || {w}[6:9] || {w}[11:14]"


def _index_sql(src: str, ids: str, name: str, pos: str) -> str:
    return f"""{name} as (with w as (select {ids}, substr(seq, i, 12) a, substr(seq, i, 14) b, i - 1 {pos} from (select {ids}, seq, unnest(range(1, length(seq) + 1)) i from {src}))
 select {ids}, 0 sn, a as key, {pos} from w where regexp_full_match(a, '[ACGT]{{12}}') union all select {ids}, 1, {_spaced('b')}, {pos} from w where regexp_full_match(b, '[ACGT]{{14}}'))"""


_IDX = f"{CONTIGS}, {_index_sql('contigs', 'cn', 'idx', 'pos')}"
_STR = "stranded as (select read_id, 0 st, seq from reads union all select read_id, 1, reverse(translate(seq, 'ACGTUMRWSYKVHDBNX', 'TGCAAKYWSRMBDHVNN')) from reads)"
_ANC = f"""{READS}, {_STR}, {_index_sql('contigs', 'cn', 'idx', 'pos')}, {_index_sql('stranded', 'read_id, st', 'rk', 'y')},
 heavy as (select sn, key from idx group by all having count(*) > {M.Options.cutoff}), light as (select * from idx anti join heavy using (sn, key)),
 anchors as (select read_id, st, cn, pos x, y, sn from rk join light using (sn, key))"""
_ISL = f"""{_ANC}, rl as (select read_id, length(seq) n from reads), sl as (select a.*, n, ((x + n - y) % n + n) % n slot, x - y diag from anchors a join rl using (read_id) where sn = 0),
 fr as (select *, case when lag(cn) over w = cn and lag(diag) over w = diag then 0 else 1 end fresh from sl window w as (partition by read_id, st, slot order by cn, x, y)),
 isl as (select *, sum(fresh) over (partition by read_id, st, slot order by cn, x, y rows unbounded preceding) island from fr),
 gr as (select read_id, st, any_value(cn) cn, min(x) x, cast(min(y) as integer) y, cast(max(x) + 12 - min(x) as integer) length, cast(count(*) as integer) weight from isl group by read_id, st, slot, island)"""
_WIN = f"""{_ISL}, aa as (select g.*, n, c.len clen, cast(floor(n * 140 / 100) as integer) w from gr g join rl using (read_id) join contigs c using (cn)),
 ab as (select *, greatest(least(x + n - 1 - y, clen - 1) - w, 0) gstart, case when weight = 1 then -1 else length * 10 end own from aa),
 pj as (select a.*, b.x xj, b.y yj, b.weight wj, least(a.x - b.x, a.y - b.y) + a.length sh, greatest(a.x - b.x, a.y - b.y) + a.length lo from ab a join ab b on a.read_id = b.read_id and a.st = b.st and a.cn = b.cn and b.x >= a.gstart and b.x < a.x and b.y < a.y),
 pb as (select *, sh * 10 + case when lo > sh then -33 + (lo - sh) * -3 else 0 end js from pj qualify row_number() over (partition by read_id, st, cn, x, y order by js desc, xj desc, yj desc, wj desc) = 1),
 pw as (select ab.*, pb.js, case when pb.js > ab.own then pb.xj else ab.x end xb, ab.weight + case when pb.js > ab.own then pb.wj else 0 end matches, case when pb.js > ab.own then pb.js else ab.own end sc, least(ab.w, ab.clen) wl
  from ab left join pb on ab.read_id = pb.read_id and ab.st = pb.st and ab.cn = pb.cn and ab.x = pb.x and ab.y = pb.y),
 win as (select read_id, st, cn, x, y, length, weight, matches, cast(sc as integer) score, cast(wl as integer) w_len, cast(least(greatest(xb - floor((w - (x - xb + length)) / 2), 0), clen - wl) as bigint) g_off
  from pw where sc >= floor(55 * least(n, wl) * 10 / 100))"""

SQL = {
    "kmer_index": f"with {_IDX} select cn, sn, count(*) postings, count(distinct key) keys, cast(sum(pos) as bigint) pos_sum from idx group by cn, sn",
    "index_list_stats": f"""with {_IDX}, c as (select sn, key, count(*) n from idx group by all), a as (select sn, 16777216::bigint lists, count(*) nonzero, cast(sum(n) as bigint) postings, sum(n * n) sq, max(n) longest from c group by sn)
 select sn, lists, nonzero, postings, round(postings / lists, 9) mean, round(sqrt(sq / lists - (postings / lists) * (postings / lists)), 9) deviation, longest from a""",
    "index_list_histogram": f"""with {_IDX}, c as (select sn, key, count(*) n from idx group by all), t as (select sn, ceil((max(n) + 1) / 100.0) size from c group by sn),
 h as (select sn, cast(floor(n / size) as bigint) bucket, count(*) keys from c join t using (sn) group by all)
 select sn, bucket, keys, round(sum(keys) over (partition by sn order by bucket rows unbounded preceding) / sum(keys) over (partition by sn), 9) as cumulative from h""",
    "heavy_key_cutoff": f"with {_IDX}, h as (select sn, key from idx group by all having count(*) > {CUTOFF}) select cn, sn, count(*) postings, cast(sum(pos) as bigint) pos_sum from idx anti join h using (sn, key) group by cn, sn",
    "contig_offsets": "select cn, name, len, cast(coalesce(sum(len) over (order by cn rows between unbounded preceding and 1 preceding), 0) as bigint) g_offset from genome_contigs",
    "contig_lookup": """with a as (select hit_id, g_offset + genome_start - 1 as at from native_hits join genome_contigs on genome = name where genome_start is not null)
 select hit_id, a.at, cn, name from a asof join genome_contigs g on a.at >= g.g_offset""",
    "seed_join_anchors": f"with {_ANC} select read_id, st, count(*) anchors, count(distinct cn) contigs, cast(sum(x) as bigint) x_sum, cast(sum(y) as bigint) y_sum from anchors group by read_id, st",
    "region_support": f"""with {_ANC}, rg as (select read_id, st, cn, x >> 11 r from anchors union all select read_id, st, cn, (x >> 11) - 1 from anchors where x % 2048 < 50 and x >> 11 > 0),
 ok as (select read_id, st, cn, r from rg group by all having count(*) >= 2),
 s as (select distinct a.* from anchors a join ok on a.read_id = ok.read_id and a.st = ok.st and a.cn = ok.cn and (ok.r = a.x >> 11 or (a.x % 2048 < 50 and ok.r = (a.x >> 11) - 1)))
 select read_id, st, count(*) anchors, cast(sum(x) as bigint) x_sum from s group by read_id, st""",
    "diagonal_islands": f"with {_ISL} select *, coalesce(lead(x) over (partition by read_id, st, cn order by x, y) - x >= 1024, false) big_gap from gr",
    "two_anchor_windows": f"with {_WIN} select * from win",
    "gapless_score": f"""with {_WIN}, j as (select w.read_id, w.st, w.cn, w.x, w.y, s.seq r, substr(c.seq, cast(w.g_off + 1 as integer), w.w_len) t, w.x - w.g_off - w.y sh from win w join stranded s using (read_id, st) join contigs c using (cn)),
 p as (select *, unnest(range(1, length(r) + 1)) i from j), q as (select *, case when i + sh < 1 or i + sh > length(t) then null when r[i] = t[i + sh] and r[i] in ('A', 'C', 'G', 'T') then 10 else -15 end v from p),
 f as (select *, sum(coalesce(v, 0)) over (partition by read_id, st, cn, x, y order by i rows unbounded preceding) ps from q),
 m as (select *, ps - least(min(ps) over (partition by read_id, st, cn, x, y order by i rows unbounded preceding), 0) run from f)
 select read_id, st, cn, x, y, cast(max(run) as integer) score from m group by read_id, st, cn, x, y""",
}
