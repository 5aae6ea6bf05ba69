"""Views that several queries share, in Spark and in SQL: contigs, and reads taken from them.

A read is a slice of a contig every READ_STEP bases; by its number it is exact, has one changed base or
lacks one, and every other is from the reverse strand. Its mate lies MATE_AT bases on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.functions.alphabet import reverse_complement
from helixframe.session import table

READ_LEN, READ_STEP, MATE_AT = 36, 401, 150


def contigs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contig").where("name is not null and seq is not null")
    return c.groupBy("name").agg(F.min("contig_id").alias("cn"), F.upper(F.min_by("seq", "contig_id")).alias("seq")).select("cn", "name", "seq", F.length("seq").alias("len"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    c = contigs(spark, d).where(f"len > {READ_LEN + MATE_AT + READ_LEN}")
    p = c.select("cn", "seq", F.explode(F.expr(f"sequence(0, len - {READ_LEN + MATE_AT + READ_LEN}, {READ_STEP})")).alias("pos"))
    p = p.withColumn("n", (F.col("pos") / READ_STEP).cast("int"))
    raw = F.substring("seq", F.col("pos") + 1, F.lit(READ_LEN))
    made = (
        F.when(F.col("n") % 3 == 1, F.concat(F.substring(raw, F.lit(1), F.lit(17)), F.translate(F.substring(raw, F.lit(18), F.lit(1)), "ACGT", "CGTA"), F.substring(raw, F.lit(19), F.lit(READ_LEN))))
        .when(F.col("n") % 3 == 2, F.concat(F.substring(raw, F.lit(1), F.lit(20)), F.substring(raw, F.lit(22), F.lit(READ_LEN))))
        .otherwise(raw)
    )
    strand = F.when(F.col("n") % 2 == 1, reverse_complement(made)).otherwise(made)
    mate = reverse_complement(F.substring("seq", F.col("pos") + 1 + MATE_AT, F.lit(READ_LEN)))
    mate_fw = F.when(F.col("pos") >= MATE_AT, F.substring("seq", F.greatest(F.col("pos") + 1 - MATE_AT, F.lit(1)), F.lit(READ_LEN)))
    return p.select((F.col("cn") * 100000 + F.col("n")).alias("read_id"), "cn", "pos", (F.col("n") % 2).alias("st"), strand.alias("seq"), mate.alias("mate"), mate_fw.alias("mate_fw"))


_IUPAC, _COMP = "ACGTUMRWSYKVHDBNX", "TGCAAKYWSRMBDHVNN"
CONTIGS = "contigs as (select name, min(contig_id) cn, upper(min_by(seq, contig_id)) seq, length(min_by(seq, contig_id)) len from contig where name is not null and seq is not null group by name)"
READS = f"""{CONTIGS}, slices as (select cn, seq full_seq, unnest(range(0, len - {READ_LEN + MATE_AT + READ_LEN} + 1, {READ_STEP})) pos from contigs where len > {READ_LEN + MATE_AT + READ_LEN}),
 raws as (select *, pos // {READ_STEP} n, substr(full_seq, pos + 1, {READ_LEN}) raw from slices),
 made as (select *, case n % 3 when 1 then raw[1:17] || translate(raw[18:18], 'ACGT', 'CGTA') || raw[19:] when 2 then raw[1:20] || raw[22:] else raw end m from raws),
 reads as (select cn * 100000 + n read_id, cn, pos, n % 2 st, case when n % 2 = 1 then reverse(translate(m, '{_IUPAC}', '{_COMP}')) else m end seq,
  reverse(translate(substr(full_seq, pos + 1 + {MATE_AT}, {READ_LEN}), '{_IUPAC}', '{_COMP}')) mate from made)"""
