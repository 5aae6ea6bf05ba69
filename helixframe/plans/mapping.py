"""Mapping reads end to end, from seeds to qualities, as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.functions import probability as P
from helixframe.operators import anchors as A, blocks as B, kernels as K, seeds as X, select as C
from helixframe.operators.ranking import last_known
from helixframe.session import cut


@dataclass(frozen=True)
class Options:
    """Stage options; thresholds are percentages of the best possible score. Letter windows are thinned at the full
    threshold unless `vector_threshold_pct` says otherwise (47 is usual for colours)."""

    seeds: Sequence[X.Seed] = (X.CONTIGUOUS, X.SPACED)
    cutoff: int = 1000
    strands: str = "both"
    window_pct: int = 140
    overlap_pct: int = 90
    window_threshold_pct: int = 55
    vector_threshold_pct: int | None = None
    full_threshold_pct: int = 50
    report: int = 10
    extra_candidates: int = 20
    strata: bool = False
    max_alignments: int = 0
    regions: bool = True
    longest_read: int = 1000
    min_matches: int = 0

    def __post_init__(self) -> None:
        if any(p is not None and p > 100 for p in (self.window_threshold_pct, self.vector_threshold_pct, self.full_threshold_pct)):
            raise ValueError("thresholds are at most 100 %")
        if self.window_pct < 100 or self.report < 1:
            raise ValueError("window_pct >= 100 and report >= 1 are needed")


ORDER = ["cn", "g_off", "st"]


def contig_at(points: DataFrame, point_id: str, at: str, contigs: DataFrame, offset: str = "g_offset") -> DataFrame:
    """The contig that holds each absolute position: the one of the greatest offset at or before it.

    An as-of join without a range join: points and offsets lie on one line, which is carried along in spans.
    """
    row = F.struct(*(F.col(c) for c in contigs.columns if c != offset))
    null = F.lit(None)
    p = points.select(F.col(point_id).alias("__id"), F.col(at).cast("bigint").alias("__at"), F.lit(1).alias("__o"), null.alias("__c"))
    c = contigs.select(F.lit(None).alias("__id"), F.col(offset).cast("bigint").alias("__at"), F.lit(0).alias("__o"), row.alias("__c"))
    both = c.unionByName(p).withColumn("__line", F.lit(0)).withColumn("__k", F.col("__at") * 2 + F.col("__o"))
    got = last_known(both, ["__line"], "__k", F.col("__c"), "__got", span=1 << 22).where("__o = 1")
    return got.select(F.col("__id").alias(point_id), F.col("__at").alias(at), "__got.*")


def joined_islands(reads: DataFrame, stranded: DataFrame, contigs: DataFrame, o: Options, index: DataFrame | None) -> DataFrame:
    """Islands by way of an index in rows: a prepared one, or one of seeds too heavy for tables over their keys."""
    # counting its keys and joining them both read the index: it is written once
    idx = X.without_heavy(index if index is not None else cut(X.kmers(contigs, ["cn"], "seq", o.seeds, spread=True)), o.cutoff)
    anchors = A.seed_anchors(stranded, idx, o.seeds)
    if o.regions:
        # support reads the anchors twice: written once, the index and the join aren't worked out again
        anchors = A.supported(cut(anchors))
    lens = reads.select("read_id", F.length("seq").alias("read_len"))
    spans = F.element_at(F.array(*(F.lit(s.span) for s in o.seeds)), F.col("sn") + 1)
    anchors = anchors.join(lens, "read_id").withColumn("__span", spans)
    islands = A.diagonal_islands(anchors, "read_len", max(s.span for s in o.seeds))
    return islands.join(lens, "read_id").join(contigs.select("cn", F.col("len").alias("contig_len")), "cn")


def map_reads(reads: DataFrame, contigs: DataFrame, o: Options = Options(), index: DataFrame | None = None, scores: dict = P.LETTER) -> DataFrame:
    """Alignments of reads (read_id, seq) on contigs (cn, seq, len): read_id, st, cn, genome_start and genome_end
    (1-based), ops, edit, cigar, score, pct, rank.

    Seeds of both strands meet those of the contigs block by block after heavy keys are cut; supported anchors become
    islands and windows; windows are scored in Arrow batches, thinned by overlap and cut to the best per
    read before the full alignment. A prepared index (X.kmers, written by sn and key) saves building it.
    """
    # longer reads are left out, as the option says; nothing later cuts a read or its window short
    reads = reads.where(F.length("seq") <= o.longest_read)
    # seeds and windows both need the reads, and scores are joined to the windows they are of: each is written once
    stranded = cut(A.both_strands(reads, strands=o.strands))
    if index is None and B.dense(o.seeds):
        islands = B.islands(stranded, contigs, o.seeds, o.cutoff, o.longest_read, o.window_pct, o.regions, (o.window_threshold_pct, scores["match"]) if o.window_threshold_pct >= 0 else None)
    else:
        islands = joined_islands(reads, stranded, contigs, o, index)
    win = A.candidate_windows(islands, "read_len", "contig_len", scores["match"], scores["open"], scores["ext_ins"], o.window_pct, o.window_threshold_pct)
    if o.min_matches:
        win = win.where(F.col("matches") >= o.min_matches)
    win = cut(A.window_text(win, contigs.select("cn", "seq"), max(1536, o.longest_read * o.window_pct // 100)).join(stranded, ["read_id", "st"]))
    full = F.length("seq") * scores["match"]
    win = K.score_windows(win).withColumn("passes", F.col("score_vec") * 100 >= full * (o.full_threshold_pct if o.vector_threshold_pct is None else o.vector_threshold_pct))
    kept = C.suppress_overlaps(win.drop("length", "weight", "matches", "score"), o.overlap_pct)
    best = C.top_k(kept, ["read_id"], [F.desc("score_vec"), *ORDER], o.report + o.extra_candidates, "__r")
    best = best.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "read_id")
    a = best.withColumn("a", K.full_alignment("text", "seq", F.col("st") == 1)).where(F.col("a.score") * 100 >= F.length("seq") * scores["match"] * o.full_threshold_pct)
    used = F.length(F.regexp_replace("a.ops", "I", ""))
    start = F.col("g_off") + F.col("a.start") + 1
    cigar = F.array_join(F.transform(F.regexp_extract_all(F.translate("a.ops", "=X", "MM"), F.lit("(M+|I+|D+)"), F.lit(1)), lambda r: F.concat(F.length(r).cast("string"), F.substring(r, F.lit(1), F.lit(1)))), "")
    hits = a.select("read_id", "st", "cn", start.alias("genome_start"), (start + used - 1).alias("genome_end"), "a.ops", "a.edit", cigar.alias("cigar"), "a.score", F.floor(F.lit(100000) * F.col("a.score") / (F.length("seq") * scores["match"])).alias("pct"), F.length("seq").alias("read_len"))
    order = [F.desc("score"), F.asc("cn"), F.asc("genome_start"), F.asc("st")]
    hits = C.dominant(hits, ["read_id", "cn", "st"], "genome_start", "genome_end", order)
    hits = C.top_k(hits, ["read_id"], order, o.report)
    if o.strata:
        hits = C.strata(hits, ["read_id"], F.desc("score"))
    if o.max_alignments:
        hits = C.capped(hits, ["read_id"], o.max_alignments)
    return hits


def with_quality(hits: DataFrame, read: str = "read_id", score: str = "score", mapped: Column | None = None, model: P.Model | None = None, floor: int = 4) -> DataFrame:
    """Adds mapq: the quality of an alignment among those of its read; below `floor` it is 0."""
    m = model or P.letter_model()
    post = P.log2_posterior(F.col(score), F.col("read_len") if mapped is None else mapped, m)
    w = W.partitionBy(read)
    # sums of powers relative to the best, so that no posterior underflows
    d = hits.withColumn("__l", post).withColumn("__p", F.pow(F.lit(2.0), F.col("__l") - F.max("__l").over(w)))
    q = P.quality_from_error(1 - F.col("__p") / F.sum("__p").over(w))
    return d.withColumn("mapq", F.when(q < floor, 0).otherwise(q)).drop("__l", "__p")


def unmapped(reads: DataFrame, hits: DataFrame) -> DataFrame:
    return reads.join(hits.select("read_id"), "read_id", "left_anti")


def mapped(reads: DataFrame, hits: DataFrame) -> DataFrame:
    return reads.join(hits.select("read_id"), "read_id", "left_semi")


def map_in_turn(reads: DataFrame, contigs: DataFrame, attempts: Sequence[Options]) -> DataFrame:
    """Option sets tried in order: a later one sees only the reads that the earlier ones left unmapped."""
    out, left = None, reads
    for n, o in enumerate(attempts):
        hits = map_reads(left, contigs, o).withColumn("attempt", F.lit(n))
        out = hits if out is None else out.unionByName(hits)
        left = unmapped(left, hits)
    return out
