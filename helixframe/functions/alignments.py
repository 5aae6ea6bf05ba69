"""CIGAR and edit strings, flags and pair geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from helixframe.functions.alphabet import reverse_complement

# The tokens of an edit string and the flag bits of an alignment row.
EDIT_TOKEN = r"([0-9]+|[ACGTNacgtn]|[xX]|-+|\([A-Za-z]+\))"
FLAGS = {
    "paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32,
    "first": 64, "second": 128, "secondary": 256, "failed": 512, "duplicate": 1024,
}


def cigar_parts(cigar: Column) -> Column:
    """array<struct<len,op>> of a CIGAR; null and '*' give null and none."""
    got = F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(got, lambda t: F.struct(F.regexp_extract(t, r"^[0-9]+", 0).cast("int").alias("len"), F.substring(t, F.length(t), F.lit(1)).alias("op")))


def render_cigar(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["len"].cast("string"), p["op"])), "")


def cigar_length(parts: Column, ops: str) -> Column:
    """Summed length of some operations."""
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.when(p["op"].isin(*ops), p["len"]).otherwise(0))


def genome_end(start: Column, parts: Column) -> Column:
    """Last genome position (1-based) that an alignment covers: M, D, N, = and X consume it."""
    return start + cigar_length(parts, "MDN=X") - 1


def edit_tokens(edit: Column) -> Column:
    return F.regexp_extract_all(edit, F.lit(EDIT_TOKEN), F.lit(1))


def _count(tokens: Column, value) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda a, t: a + value(t))


def is_number(t: Column) -> Column:
    return t.rlike("^[0-9]")


def number(t: Column) -> Column:
    return F.coalesce(t.try_cast("int"), F.lit(0))


def edit_counts(edit: Column) -> dict[str, Column]:
    """matches, mismatches, n_ins (read bases without a genome base), n_del (genome bases without a read base)
    and crossovers."""
    t = edit_tokens(edit)
    return {
        "matches": _count(t, lambda x: F.when(is_number(x), number(x)).otherwise(0)),
        "mismatches": _count(t, lambda x: F.when(x.rlike("^[ACGTNacgtn]$"), 1).otherwise(0)),
        "n_ins": _count(t, lambda x: F.when(x.startswith("("), F.length(x) - 2).otherwise(0)),
        "n_del": _count(t, lambda x: F.when(x.startswith("-"), F.length(x)).otherwise(0)),
        "crossovers": _count(t, lambda x: F.when(F.lower(x) == "x", 1).otherwise(0)),
    }


def edit_operations(edit: Column) -> Column:
    """One letter a base: M (match or mismatch), I, D."""
    one = lambda t: (
        F.when(is_number(t), F.repeat(F.lit("M"), number(t)))
        .when(t.startswith("("), F.repeat(F.lit("I"), F.length(t) - 2))
        .when(t.startswith("-"), F.repeat(F.lit("D"), F.length(t)))
        .when(F.lower(t) == "x", "").otherwise("M")
    )
    return F.array_join(F.transform(edit_tokens(edit), one), "")


def edit_to_cigar(edit: Column, read_start: Column, read_end: Column, read_length: Column) -> Column:
    """CIGAR with soft-clipped ends; read_start and read_end are 1-based and inclusive."""
    runs = F.regexp_extract_all(edit_operations(edit), F.lit("(M+|I+|D+)"), F.lit(1))
    body = F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, F.lit(1), F.lit(1)))), "")
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(read_start - 1), body, clip(read_length - read_end))


def reverse_edit(edit: Column) -> Column:
    """Edit string of the other strand."""
    one = lambda t: F.when(t.startswith("("), F.concat(F.lit("("), reverse_complement(F.substring(t, F.lit(2), F.length(t) - 2)), F.lit(")"))).when(t.rlike("^[ACGTNacgtn]$"), reverse_complement(t)).otherwise(t)
    return F.array_join(F.transform(F.reverse(edit_tokens(edit)), one), "")


def indel_sizes(edit: Column, kind: str) -> Column:
    """Sizes of the insertion ('(') or deletion ('-') events in order."""
    t = F.filter(edit_tokens(edit), lambda x: x.startswith(kind))
    return F.transform(t, lambda x: F.length(x) - (2 if kind == "(" else 0))


def variants(edit: Column, strand: Column, start: Column) -> Column:
    """array<struct<ord,kind,value,pos>>: s (base), d (deleted bases) and i (inserted bases, at the position
    before). On the reverse strand the events are those of the reversed, complemented string."""
    t = edit_tokens(F.when(strand == "-", reverse_edit(edit)).otherwise(edit))
    used = F.transform(t, lambda x: F.when(is_number(x), number(x)).when(x.startswith("-"), F.length(x)).when(x.rlike("^[ACGTNacgtn]$"), 1).otherwise(0))
    at = lambda i: start + F.aggregate(F.slice(used, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x)
    event = F.transform(
        t,
        lambda x, i: F.when(x.rlike("^[ACGTNacgtn]$"), F.struct(i.alias("ord"), F.lit("s").alias("kind"), F.upper(x).alias("value"), at(i).alias("pos")))
        .when(x.startswith("-"), F.struct(i.alias("ord"), F.lit("d").alias("kind"), F.length(x).cast("string").alias("value"), at(i).alias("pos")))
        .when(x.startswith("("), F.struct(i.alias("ord"), F.lit("i").alias("kind"), F.upper(F.substring(x, F.lit(2), F.length(x) - 2)).alias("value"), (at(i) - 1).alias("pos"))),
    )
    return F.filter(event, lambda e: e.isNotNull())


def decode_flags(flags: Column) -> dict[str, Column]:
    return {n: flags.bitwiseAND(b) != 0 for n, b in FLAGS.items()}


def encode_flags(**bits: Column) -> Column:
    out = F.lit(0)
    for n, c in bits.items():
        out = out.bitwiseOR(F.when(c, FLAGS[n]).otherwise(0))
    return out


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix without a trailing ':' or '/': the name of a pair."""
    n = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct((acc["n"] + (acc["on"] & same).cast("int")).alias("n"), (acc["on"] & same).alias("on")),
    )["n"]
    return F.regexp_replace(F.substring(a, F.lit(1), n), "[:/]$", "")


def insert_size(start0: Column, end0: Column, reverse0: Column, start1: Column, end1: Column, reverse1: Column) -> Column:
    """Signed distance between the 5' ends: a reverse one lies at its end, a forward one before its start."""
    five = lambda s, e, r: F.when(r, e).otherwise(s - 1)
    return five(start1, end1, reverse1) - five(start0, end0, reverse0)
