"""Mapping read pairs end to end: both mates mapped, paired by their orientation, and ranked."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, functions as F

from helixframe.functions.alignments import insert_size
from helixframe.functions.alphabet import reverse_complement
from helixframe.operators import pairs as R, reads as D
from helixframe.plans.mapping import Options, map_reads
from helixframe.session import cut

#: the mates that are turned round so that a pair of the mode points inward
TURNED = {"opp-in": (), "opp-out": (0, 1), "col-fw": (1,), "col-bw": (0,)}


@dataclass(frozen=True)
class PairOptions(Options):
    """Options of both mates and of their pairing; `mode` is one of pairs.MODES, sizes are bounds of the insert and
    `pair_pct` the least score of a pair in per cent of the best possible."""

    mode: str = "opp-in"
    least_size: int = 0
    most_size: int = 1000
    pair_pct: int = 50
    pair_report: int = 10
    least_quality: float = 10.0


def map_pairs(pairs: DataFrame, contigs: DataFrame, o: PairOptions = PairOptions(), index: DataFrame | None = None) -> DataFrame:
    """Pairs of alignments of read pairs (pair_id, seq0, seq1; quality0 and quality1, average qualities, if they are there)
    on contigs (cn, seq, len): pair_id, cn, st (of the first mate), start0, end0, start1, end1, cigar0, cigar1, size,
    score, rank.

    Both mates go through one mapping plan as reads of their own, so the index is met once; their hits meet in an
    equi-join on pair, contig and strand within the bounds of the mode, of the pairs above the least score
    the best are reported. Mates of other modes are turned round first, so that pairs point inward. A mate that is too long or of too low a quality drops its pair. As single mates need
    half a pair's score each only together, a mate is kept from half the full threshold on.
    Defined cases: a pair without a placement of both mates within the bounds has no row; null sequences have no hits; a pair
    id given twice is refused by no check and gives the pairs of both; other columns are ignored.
    """
    have = [c for c in ("quality0", "quality1") if c in pairs.columns]
    turned = TURNED[o.mode]
    sides = [F.struct(F.lit(n).alias("nip"), (reverse_complement(F.col(f"seq{n}")) if n in turned else F.col(f"seq{n}")).alias("seq"), (F.col(f"quality{n}") if f"quality{n}" in have else F.lit(None)).cast("double").alias("quality")) for n in (0, 1)]
    mates = pairs.select("pair_id", F.inline(F.array(*sides)))
    mates = D.usable(mates, F.length("seq"), F.col("quality"), o.longest_read, o.least_quality, "pair_id").select(F.struct("pair_id", "nip").alias("read_id"), "seq")
    single = {f.name: getattr(o, f.name) for f in fields(Options)} | {"full_threshold_pct": o.full_threshold_pct // 2}
    # both sides of a pair read the hits: they are written once
    hits = cut(map_reads(mates, contigs, Options(**single), index))
    h = hits.select("read_id.pair_id", "read_id.nip", "cn", "st", "genome_start", "genome_end", "cigar", "score", "read_len")
    h = h.select("*", F.struct("st", "genome_start", "genome_end", "cigar", "score", "read_len").alias("hit"), (F.col("genome_start") - 1).alias("g_off"), (F.col("genome_end") - F.col("genome_start") + 1).cast("int").alias("w_len"))
    best = F.lit(o.pair_pct) * 10 * (F.col("hit0.read_len") + F.col("hit1.read_len"))
    found = R.pair_hits(h.where("nip = 0"), h.where("nip = 1"), o.mode, o.least_size, o.most_size)
    kept = found.where((F.col("score") * 100 >= best) & (F.col("hit0.score") > 0) & (F.col("hit1.score") > 0))
    top = R.top_pairs(kept, o.pair_report)
    back = [(F.col(f"hit{n}.st") == 1) != F.lit(n in turned) for n in (0, 1)]
    size = insert_size(*(x for n in (0, 1) for x in (F.col(f"hit{n}.genome_start"), F.col(f"hit{n}.genome_end"), back[n])))
    ends = [F.col(f"hit{n}.{c}").alias(a) for n in (0, 1) for c, a in (("genome_start", f"start{n}"), ("genome_end", f"end{n}"), ("cigar", f"cigar{n}"))]
    return top.select("pair_id", "cn", back[0].cast("int").alias("st"), *ends, size.alias("size"), "score", "rank")
