"""Queries of the scalar functions with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions import alignments as A, alphabet as S, probability as P
from helixframe.operators import seeds
from helixframe.queries.views import CONTIGS, READS, contigs, reads
from helixframe.session import table

_I, _C = S.LETTERS, S.COMPLEMENTS
_M = P.letter_model()
TOKEN = "GATTA"


def _qualities(spark: SparkSession, d: str) -> DataFrame:
    """Reads with a quality string made from the digest of their number and a tail of Bs."""
    q = F.concat(F.substring(F.repeat(F.md5(F.col("read_id").cast("string")), F.lit(2)), F.lit(1), F.length("seq") - F.col("read_id") % 5), F.repeat(F.lit("B"), (F.col("read_id") % 5).cast("int")))
    return reads(spark, d).withColumn("qual", q)


_QUAL = f"""{READS}, quals as (select *, substr(md5(cast(read_id as varchar)) || md5(cast(read_id as varchar)), 1, cast(length(seq) - read_id % 5 as integer)) || repeat('B', read_id % 5) qual from reads)"""


def seq_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.bases_of(F.col("text")).alias("seq"))


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contig").select("contig_id", S.reverse_complement(F.col("seq")).alias("rc"), S.is_rna(F.col("seq")).alias("rna"))


def revcomp_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contig").select("contig_id", S.reverse_complement_text(F.col("seq")).alias("rc"))


def mask_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contig").select("contig_id", S.mask_ambiguous(F.col("seq")).alias("seq"), S.illegal(F.col("seq")).alias("illegal"))


def colour_encode(spark: SparkSession, d: str) -> DataFrame:
    return contigs(spark, d).select("cn", S.letters_to_colours(F.col("seq")).alias("colours"))


def colour_decode(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", S.colours_to_letters(S.letters_to_colours(F.col("seq"))).alias("seq"))


def colour_reverse(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d).where("seq rlike '^[ACGT]+$'")
    rc = S.reverse_colours(S.letters_to_colours(F.col("seq")), F.substring("seq", -1, 1))
    return r.select("read_id", S.colours_to_letters(rc).alias("rc"))


def seq_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return seeds.occurrences(contigs(spark, d), ["cn"], "seq", TOKEN)


def slice_circular(spark: SparkSession, d: str) -> DataFrame:
    return contigs(spark, d).where("len >= 40").select("cn", S.slice_circular(F.col("seq"), F.lit(-9), F.lit(30)).alias("part"))


def trim_reads(spark: SparkSession, d: str) -> DataFrame:
    q = _qualities(spark, d)
    b = S.trailing(F.col("qual"))
    return q.select("read_id", S.trim(F.col("seq"), 3, 2).alias("cut"), S.trim(F.col("seq"), F.lit(0), b).alias("without_b"), b.alias("trailing_b"))


def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose average quality passes, with the worst value and whether all lie within range."""
    v = S.quality_values(F.col("qual"), 33)
    q = _qualities(spark, d).select("read_id", S.average_quality(F.col("qual"), F.length("seq"), 33).alias("avg_qv"), F.array_min(v).alias("worst"), (~F.exists(v, lambda x: (x < -10) | (x > 50))).alias("in_range"))
    return q.where("avg_qv >= 10")


def crossover_scores(spark: SparkSession, d: str) -> DataFrame:
    m = P.colour_model()
    q = _qualities(spark, d).select("read_id", S.crossover_scores(F.col("qual"), 33, m.alpha, -20).alias("s"))
    return q.select("read_id", F.array_join("s", ",").alias("scores"))


def requality(spark: SparkSession, d: str) -> DataFrame:
    return _qualities(spark, d).select("read_id", S.requality(F.col("qual"), 33, 64, True).alias("qual"), S.window_length(F.length("seq"), "140%").alias("window_len"))


def cigar_stats(spark: SparkSession, d: str) -> DataFrame:
    p = A.cigar_parts(F.col("cigar"))
    return table(spark, d, "pretty").where("cigar is not null").select("aln_id", A.render_cigar(p).alias("cigar"), F.size(p).alias("parts"), A.cigar_length(p, "MIS=X").alias("read_len"), A.genome_end(F.col("genome_start_unpadded"), p).alias("genome_end"))


def edit_string_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "native_hits").where("edit is not null").select("hit_id", *(c.alias(n) for n, c in A.edit_counts(F.col("edit")).items()))


def edit_to_cigar(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("edit is not null and read_length is not null and read_start is not null and read_end is not null")
    return h.select("hit_id", A.edit_to_cigar(F.col("edit"), F.col("read_start"), F.col("read_end"), F.col("read_length")).alias("cigar"))


def edit_reverse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "native_hits").where("edit is not null").select("hit_id", A.reverse_edit(F.col("edit")).alias("edit"))


def indel_frequencies(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("edit is not null")
    named = lambda c, kind: F.transform(A.indel_sizes(F.col("edit"), c), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("size")))
    sizes = F.concat(named("(", "insertion"), named("-", "deletion"))
    return h.select(F.inline(sizes)).groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n"))


def variant_rows(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("edit is not null and genome_start is not null")
    return h.select("hit_id", F.inline(A.variants(F.col("edit"), F.col("strand"), F.col("genome_start"))))


def flag_decode(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pretty").where("flags is not null")
    names = {n: c for n, c in A.decode_flags(F.col("flags")).items()}
    return p.select("aln_id", *(c.alias(n) for n, c in names.items()), A.encode_flags(**names).alias("flags"))


def pair_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pretty").where("read_id is not null")
    a = p.groupBy("read_id").agg(F.min("read_name").alias("a"), F.max("read_name").alias("b"))
    return a.where("a is not null").select("read_id", A.common_prefix(F.concat("a", F.lit("/1")), F.concat("b", F.lit("/2"))).alias("pair_name"))


def insert_probability(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pretty").where("isize is not null").select(F.abs(F.col("isize").cast("bigint")).alias("size")).distinct()
    return p.select("size", F.round(P.insert_probability(F.col("size").cast("double")), 9).alias("p"))


def quality_codecs(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "pretty").where("mapq is not null").select("mapq").distinct()
    e = P.error_from_quality(F.col("mapq"))
    return q.select("mapq", F.round(e, 12).alias("p_error"), P.to_neglog(e * 0.999).alias("neglog"), F.round(P.from_neglog(F.col("mapq") * 100), 9).alias("p"))


def chance_of_score(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "native_hits").where("score is not null and read_length is not null").select("read_length", "score").distinct()
    return h.select("read_length", "score", F.round(F.log10(P.chance_of_score(F.col("score"), F.col("read_length"), _M)), 6).alias("log10_p"), P.missed_mate(F.col("read_length")).alias("missed"))


QUERIES = {
    f.__name__: f
    for f in (
        seq_extract, revcomp, revcomp_text, mask_ambiguous, colour_encode, colour_decode, colour_reverse, seq_occurrences, slice_circular, trim_reads,
        quality_filter, crossover_scores, requality, cigar_stats, edit_string_stats, edit_to_cigar, edit_reverse, indel_frequencies, variant_rows,
        flag_decode, pair_names, insert_probability, quality_codecs, chance_of_score,
    )
}

_DIG = "regexp_replace(translate(upper(seq), 'ACGTU', '01233'), '[^0123]', '4', 'g')"
_TOK = "regexp_extract_all(edit, '[0-9]+|[ACGTNacgtn]|[xX]|-+|\\([A-Za-z]+\\)')"
_REV = f"case when x like '(%' then '(' || reverse(translate(x[2:-2], '{_I}', '{_C}')) || ')' when regexp_full_match(x, '[ACGTNacgtn]') then translate(x, '{_I}{_I.lower()}', '{_C}{_C.lower()}') else x end"
_CM = P.colour_model()
_B = P.CDF_B


def _cdf(x: str) -> str:
    y, t = f"abs(({x} - 200.0) / 100.0)", f"(1.0 / (1.0 + abs(({x} - 200.0) / 100.0) * {_B[0]}))"
    tail = f"(exp(-{y} * {y} / 2) / {(2 * P.CDF_PI) ** 0.5!r} * (((({t} * {_B[5]} + {_B[4]}) * {t} + {_B[3]}) * {t} + {_B[2]}) * {t} + {_B[1]}) * {t})"
    return f"(case when {x} > 200.0 then 1 - {tail} else {tail} end)"


_ERR = "case when mapq <= 0 then 0.99999999::double when mapq >= 250 then 1e-25::double else pow(10.0::double, -mapq / 10.0) end"
_ERRORS = f"ceil((read_length * {_M.match} - score) / {float(abs(_M.mismatch - _M.match))}::double)"

SQL = {
    "seq_extract": "select doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) seq from documents",
    "revcomp": f"select contig_id, reverse(translate(seq, '{_I}{_I.lower()}', '{_C}{_C.lower()}')) rc, regexp_matches(seq, '[Uu]') and not regexp_matches(seq, '[Tt]') rna from contig",
    "revcomp_text": "select contig_id, reverse(translate(seq, 'ACGTacgt', 'tgcatgca')) rc from contig",
    "mask_ambiguous": f"select contig_id, regexp_replace(upper(seq), '[^ACGT]', 'N', 'g') seq, regexp_matches(seq, '[^{_I}{_I.lower()}.-]') illegal from contig",
    "colour_encode": f"""with {CONTIGS}, d as (select cn, {_DIG} d from contigs), p as (select cn, d, '3' || d[1:-2] e from d)
 select cn, array_to_string(list_transform(range(1, length(d) + 1), lambda i: case when d[i] = '4' or e[i] = '4' then '4' else cast(xor(cast(d[i] as integer), cast(e[i] as integer)) as varchar) end), '') colours from p""",
    "colour_decode": f"with {READS}, p as (select read_id, seq, regexp_extract(seq, '^[ACGT]*') ok from reads) select read_id, ok || repeat('N', length(seq) - length(ok)) seq from p",
    "colour_reverse": f"with {READS} select read_id, reverse(translate(seq, 'ACGT', 'TGCA')) rc from reads where regexp_full_match(seq, '[ACGT]+')",
    "seq_occurrences": f"with {CONTIGS}, p as (select cn, seq, unnest(range(1, len - {len(TOKEN)} + 2)) pos from contigs) select cn, pos from p where substr(seq, pos, {len(TOKEN)}) = '{TOKEN}'",
    "slice_circular": f"with {CONTIGS} select cn, substr(seq, len - 9, 10) || substr(seq, 1, 30) part from contigs where len >= 40",
    "trim_reads": f"with {_QUAL}, b as (select *, length(qual) - length(regexp_replace(qual, 'B+$', '')) b from quals) select read_id, substr(seq, 4, greatest(length(seq) - 5, 0)) cut, substr(seq, 1, length(seq) - b) without_b, cast(b as integer) trailing_b from b",
    "quality_filter": f"""with {_QUAL}, v as (select read_id, length(seq) n, list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) v from quals),
 a as (select read_id, cast(floor(list_sum(v) / n) as integer) avg_qv, list_min(v) worst, len(list_filter(v, lambda x: x < -10 or x > 50)) = 0 in_range from v) select * from a where avg_qv >= 10""",
    "crossover_scores": f"""with {_QUAL} select read_id, array_to_string(list_transform(string_split(qual, ''), lambda c: greatest(least(cast(trunc({_CM.alpha!r} * ln(pow(10.0::double, -(ascii(c) - 33) / 10.0) / 3.0) / ln(2.0)) as integer), -1), -40)), ',') scores from quals""",
    "requality": f"with {_QUAL} select read_id, reverse(array_to_string(list_transform(string_split(qual, ''), lambda c: chr(greatest(ascii(c) - 33, 0) + 64)), '')) qual, cast(floor(length(seq) * 140.0 / 100) as integer) window_len from quals",
    "cigar_stats": r"""with t as (select aln_id, genome_start_unpadded s, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') t from pretty where cigar is not null),
 p as (select *, list_transform(t, lambda x: cast(x[1:-2] as integer)) n, list_transform(t, lambda x: x[-1:]) o from t)
 select aln_id, array_to_string(t, '') cigar, cast(len(t) as integer) parts,
 cast(coalesce(list_sum(list_transform(range(1, len(t) + 1), lambda i: case when o[i] in ('M', 'I', 'S', '=', 'X') then n[i] else 0 end)), 0) as integer) read_len,
 s + coalesce(list_sum(list_transform(range(1, len(t) + 1), lambda i: case when o[i] in ('M', 'D', 'N', '=', 'X') then n[i] else 0 end)), 0) - 1 genome_end from p""",
    "edit_string_stats": f"""with t as (select hit_id, {_TOK} t from native_hits where edit is not null)
 select hit_id, cast(coalesce(list_sum(list_transform(t, lambda x: coalesce(try_cast(x as integer), 0) * cast(regexp_full_match(x, '[0-9]+') as integer))), 0) as integer) matches,
 cast(len(list_filter(t, lambda x: regexp_full_match(x, '[ACGTNacgtn]'))) as integer) mismatches,
 cast(coalesce(list_sum(list_transform(t, lambda x: case when x like '(%' then length(x) - 2 else 0 end)), 0) as integer) n_ins,
 cast(coalesce(list_sum(list_transform(t, lambda x: case when x like '-%' then length(x) else 0 end)), 0) as integer) n_del,
 cast(len(list_filter(t, lambda x: lower(x) = 'x')) as integer) crossovers from t""",
    "edit_to_cigar": f"""with t as (select *, {_TOK} t from native_hits where edit is not null and read_length is not null and read_start is not null and read_end is not null),
 o as (select *, array_to_string(list_transform(t, lambda x: case when regexp_full_match(x, '[0-9]+') then repeat('M', cast(x as integer)) when x like '(%' then repeat('I', length(x) - 2) when x like '-%' then repeat('D', length(x)) when lower(x) = 'x' then '' else 'M' end), '') ops from t)
 select hit_id, case when read_start > 1 then (read_start - 1) || 'S' else '' end || array_to_string(list_transform(regexp_extract_all(ops, 'M+|I+|D+'), lambda r: length(r) || r[1:1]), '') || case when read_length > read_end then (read_length - read_end) || 'S' else '' end cigar from o""",
    "edit_reverse": f"with t as (select hit_id, list_reverse({_TOK}) t from native_hits where edit is not null) select hit_id, array_to_string(list_transform(t, lambda x: {_REV}), '') edit from t",
    "indel_frequencies": f"""with t as (select unnest({_TOK}) x from native_hits where edit is not null)
 select case when x like '(%' then 'insertion' else 'deletion' end kind, cast(case when x like '(%' then length(x) - 2 else length(x) end as integer) size, count(*) n from t where x like '(%' or x like '-%' group by all""",
    "variant_rows": f"""with t as (select hit_id, genome_start s, case when strand = '-' then list_transform(list_reverse({_TOK}), lambda x: {_REV}) else {_TOK} end t from native_hits where edit is not null and genome_start is not null),
 u as (select *, list_transform(t, lambda x: case when regexp_full_match(x, '[0-9]+') then cast(x as bigint) when x like '-%' then length(x) when regexp_full_match(x, '[ACGTNacgtn]') then 1 else 0 end) used from t),
 e as (select hit_id, s, t, used, unnest(range(1, len(t) + 1)) i from u)
 select hit_id, cast(i - 1 as integer) ord, case when t[i] like '-%' then 'd' when t[i] like '(%' then 'i' else 's' end kind, case when t[i] like '-%' then cast(length(t[i]) as varchar) when t[i] like '(%' then upper(t[i][2:-2]) else upper(t[i]) end as value,
 cast(s + coalesce(list_sum(used[1:i - 1]), 0) - case when t[i] like '(%' then 1 else 0 end as bigint) pos from e where t[i] like '-%' or t[i] like '(%' or regexp_full_match(t[i], '[ACGTNacgtn]')""",
    "flag_decode": "select aln_id, " + ", ".join(f'flags & {b} <> 0 as "{n}"' for n, b in A.FLAGS.items()) + ", flags & 2047 flags from pretty where flags is not null",
    "pair_names": "select read_id, regexp_replace(list_max(list_filter(list_transform(range(0, length(a || '/1') + 1), lambda i: substr(a || '/1', 1, i)), lambda p: starts_with(b || '/2', p))), '[:/]$', '') pair_name from (select read_id, min(read_name) a, max(read_name) b from pretty where read_id is not null group by 1) where a is not null",
    "insert_probability": f"select distinct abs(isize::bigint) size, round(greatest({_cdf('(abs(isize::bigint) + 10.0::double)')} - {_cdf('(abs(isize::bigint) - 10.0::double)')}, 1e-200), 9) p from pretty where isize is not null",
    "quality_codecs": f"select distinct mapq, round({_ERR}, 12) p_error, cast(trunc(1000.0 * -ln(({_ERR}) * 0.999::double)) as integer) neglog, round(exp(-mapq * 100 / 1000.0::double), 9) p from pretty where mapq is not null",
    "chance_of_score": f"""select distinct read_length, score, round(log10(case when score > read_length * {_M.match} then 1e-200::double else exp(case when {_ERRORS} > read_length then 0 else lgamma(read_length + 1) - lgamma({_ERRORS} + 1) - lgamma(read_length - {_ERRORS} + 1) end + {_ERRORS} * ln(3.0) - read_length * ln(4.0)) end), 6) log10_p,
 case when read_length < 40 then 1e-10::double when read_length < 60 then 1e-14::double else 1e-16::double end missed from native_hits where score is not null and read_length is not null""",
}
