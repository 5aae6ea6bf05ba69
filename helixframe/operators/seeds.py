"""Spaced seeds: k-mer keys, the index, its statistics and the cut-off of heavy keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from helixframe.operators.ranking import prefix_over_buckets

TILE, KEY_TILE, BLOCK = 128, 1 << 12, 1 << 18
BASE = np.full(256, 4, np.uint8)
for _k, _c in enumerate(b"ACGT"):
    BASE[_c] = _k


@dataclass(frozen=True)
class Seed:
    """A 0/1 pattern; its key is the bases under the ones."""

    pattern: str

    @property
    def span(self) -> int:
        return len(self.pattern)

    @property
    def weight(self) -> int:
        return self.pattern.count("1")


CONTIGUOUS, SPACED = Seed("1" * 12), Seed("11110111101111")


def tiles(df: DataFrame, ids: Sequence[str], seq: str, overlap: int, tile: int = TILE) -> DataFrame:
    """ids, tile (number), start (0-based), text: short overlapping stretches of a sequence of any length.

    Taken in two steps, as cutting costs time in proportion to the length cut from; the stretches of a
    long sequence are spread over the tasks before anything is done with them.
    """
    block = BLOCK - BLOCK % tile
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(block)))
    b = df.where(F.length(seq) > 0).select(*ids, seq, at.alias("__b")).select(*ids, "__b", F.substring(seq, F.col("__b") + 1, F.lit(block + overlap)).alias("__t"))
    inner = F.explode(F.sequence(F.lit(0), F.least(F.length("__t"), F.lit(block)) - 1, F.lit(tile)))
    t = b.select(*ids, "__b", "__t", inner.alias("__i"))
    start = (F.col("__b") + F.col("__i")).cast("bigint")
    return t.select(*ids, F.floor(start / tile).cast("bigint").alias("tile"), start.alias("start"), F.substring("__t", F.col("__i") + 1, F.lit(tile + overlap)).alias("text"))


def _pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and lengths of stretches of rows of about `most` bytes."""
    texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        raw = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[end] - offsets[row]), int(offsets[row])) if offsets[end] > offsets[row] else np.zeros(0, np.uint8)
        lens = np.diff(offsets[row : end + 1])
        if len(raw) and raw.max() > 127:  # one byte a character
            plain = [t.encode("ascii", "replace") for t in texts.slice(row, end - row).to_pylist()]
            raw, lens = np.frombuffer(b"".join(plain), np.uint8), np.array([len(x) for x in plain])
        yield row, raw, lens
        row = end


def kmers(df: DataFrame, ids: Sequence[str], seq: str, seeds: Sequence[Seed], spread: bool = False) -> DataFrame:
    """ids, sn (seed number), key, pos (0-based): keys of all windows with only A, C, G and T, two bits a base.
    Sequences shorter than a seed have none; null ones neither. `spread` shuffles the tiles first, for sequences
    so few and long that a task would hold too much. The keys of all seeds come from one pass over a tile."""
    if any(s.weight > 31 for s in seeds):
        raise ValueError("a seed has at most 31 bases; heavier ones are to be joined on a hash of their text")
    t = tiles(df, ids, seq, max(s.span for s in seeds) - 1, KEY_TILE)
    if spread:
        # a fixed number, as a coalesced shuffle of short tiles would make few tasks of much work
        t = t.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*ids, "tile"))
    given = [df.schema[c] for c in ids]
    out = T.StructType([*given, *T.StructType.fromDDL("sn int, key bigint, pos bigint").fields])
    spans = [(n, s.span, [k for k, c in enumerate(s.pattern) if c == "1"]) for n, s in enumerate(seeds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = np.asarray(b.column("start"))
            for first, raw, lens in _pieces(b.column("text")):
                code = BASE[raw]
                odd = np.concatenate([[0], np.cumsum(code > 3)])
                row = np.repeat(np.arange(len(lens)), lens)
                at = np.arange(len(raw)) - np.repeat(np.cumsum(lens) - lens, lens)
                for n, span, ones in spans:
                    m = len(raw) - span + 1
                    if m < 1:
                        continue
                    # within one tile, begun in its own part and not in the next one's, and without other letters
                    good = np.flatnonzero((row[:m] == row[span - 1 :]) & (odd[span:] == odd[:m]) & (at[:m] < KEY_TILE))
                    key = np.zeros(len(good), np.int64)
                    for k in ones:
                        key = key << 2 | code[good + k]
                    r = first + row[good]
                    where = pa.array(r)
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(where) for c in ids), pa.array(np.full(len(r), n, np.int32)), pa.array(key), pa.array(starts[r] + at[good])], names=out.names)

    return t.select(*ids, "start", "text").mapInArrow(run, out)


def occurrences(df: DataFrame, ids: Sequence[str], seq: str, token: str) -> DataFrame:
    """ids and pos (1-based) of every occurrence of a token, overlapping ones too."""
    t = tiles(df, ids, seq, len(token) - 1).where(F.col("text").contains(token))
    at = F.filter(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(TILE))), lambda i: F.substring("text", i, F.lit(len(token))) == token)
    return t.select(*ids, "start", F.explode(at).alias("i")).select(*ids, (F.col("start") + F.col("i")).alias("pos"))


def key_counts(index: DataFrame) -> DataFrame:
    """How long the posting list of each key is."""
    return index.groupBy("sn", "key").agg(F.count(F.lit(1)).alias("n"))


def list_stats(index: DataFrame, seeds: Sequence[Seed]) -> DataFrame:
    """Per seed: keys possible and used, mean and deviation over all possible keys (also empty ones), longest."""
    a = key_counts(index).groupBy("sn").agg(F.count(F.lit(1)).alias("nonzero"), F.sum("n").alias("postings"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.max("n").alias("longest"))
    size = F.element_at(F.array(*(F.lit(4**s.weight) for s in seeds)), F.col("sn") + 1)
    mean = F.col("postings") / F.col("lists")
    a = a.withColumn("lists", size.cast("bigint"))
    return a.select("sn", "lists", "nonzero", "postings", F.round(mean, 9).alias("mean"), F.round(F.sqrt(F.col("sq") / F.col("lists") - mean * mean), 9).alias("deviation"), "longest")


def list_histogram(index: DataFrame, buckets: int = 100) -> DataFrame:
    """Per seed: used keys by list length in `buckets` equal classes, with the cumulative share."""
    c = key_counts(index)
    top = c.groupBy("sn").agg(F.max("n").alias("top"))
    h = c.groupBy("sn", "n").agg(F.count(F.lit(1)).alias("keys")).join(F.broadcast(top), "sn")  # one row a seed
    size = F.ceil((F.col("top") + 1) / buckets)
    h = h.groupBy("sn", F.floor(F.col("n") / size).alias("bucket")).agg(F.sum("keys").alias("keys"))
    w = W.partitionBy("sn")
    run = F.sum("keys").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) / F.sum("keys").over(w)
    return h.select("sn", "bucket", "keys", F.round(run, 9).alias("cumulative"))


def auto_cutoff(genome_length: int, weight: int) -> int:
    return max(1000, 100 * genome_length // 4**weight)


def without_heavy(index: DataFrame, cutoff: int) -> DataFrame:
    """The index without the lists of keys that occur more than `cutoff` times. Counts are combined before
    they are sent; heavy keys lose all their rows in the anti-join, so they burden no later join."""
    return index.join(key_counts(index).where(F.col("n") > cutoff).select("sn", "key"), ["sn", "key"], "left_anti")


def contig_offsets(contigs: DataFrame, order: str = "cn", length: str = "len") -> DataFrame:
    """Adds g_offset: the total length of all earlier contigs. Offsets are a prefix over blocks of contigs,
    then one within the block."""
    c = contigs.withColumn("__b", F.floor(F.col(order) / 4096).cast("bigint")).withColumn("__g", F.lit(0))
    before = prefix_over_buckets(c.groupBy("__g", "__b").agg(F.sum(length).cast("bigint").alias("t")), ["__g"], "__b", ["t"])
    inner = F.coalesce(F.sum(length).over(W.partitionBy("__b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("__i", inner).join(before, ["__g", "__b"]).withColumn("g_offset", (F.col("before_t") + F.col("__i")).cast("bigint")).drop("__g", "__b", "__i", "before_t")


def save_index(index: DataFrame, path: str) -> None:
    """Writes an index by seed, range-parted and sorted by key, so that a load of some seeds or keys reads just these."""
    index.repartitionByRange("sn", "key").sortWithinPartitions("sn", "key").write.mode("overwrite").partitionBy("sn").parquet(path)


def load_index(spark: SparkSession, path: str, seeds: Sequence[int] | None = None) -> DataFrame:
    """A saved index, of all seeds or of some by number."""
    i = spark.read.parquet(path)
    return i if seeds is None else i.where(F.col("sn").isin(list(seeds)))
