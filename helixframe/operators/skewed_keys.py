"""Per-key results when a few keys hold most rows: exact offset chunking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.operators.ranking import key_layout, null_safe

BLOCK_ROWS = 1 << 18
CHUNK_ROWS = 1 << 18


def file_block(rows: int = BLOCK_ROWS) -> list[Column]:
    """(block, position) of a row of a parquet scan: fixed by the file, not by how a job splits it,
    so that the counting pass and the numbering pass always agree, also when a task is run again."""
    path, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return [F.xxhash64(path, F.floor(at / rows)).alias("block"), at.alias("at")]


def number_rows(df: DataFrame, keys: Sequence[str], block: str = "block", at: str = "at") -> DataFrame:
    """Adds `ordinal`: the exact 0-based position of each row when rows lie key after key.

    Counts keys per input block, prefix-sums the counts to start offsets, and numbers the rows of a
    block within their key. No task holds more of a key than one block has. Null keys are a key.
    """
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("n"))
    layout = key_layout(counts, keys, block).select(*keys, block, "start")
    w = W.partitionBy(*keys, block).orderBy(at)
    local = df.withColumn("__rn", F.row_number().over(w) - 1)
    return null_safe(local, layout, [*keys, block]).withColumn("ordinal", F.col("start") + F.col("__rn")).drop("__rn", "start")


def chunked_states(df: DataFrame, keys: Sequence[str], states: Sequence[Column], chunk_rows: int = CHUNK_ROWS, block: str = "block", at: str = "at") -> DataFrame:
    """One row of partial states per (key, chunk); a chunk is `chunk_rows` successive ordinals, so
    light keys share a chunk and a heavy one spans several. `states` are aggregates with aliases."""
    n = number_rows(df, keys, block, at).withColumn("chunk", F.floor(F.col("ordinal") / chunk_rows).cast("bigint"))
    return n.groupBy(*keys, "chunk").agg(*states)


def key_statistics(df: DataFrame, keys: Sequence[str], score: str, chunk_rows: int = CHUNK_ROWS, block: str = "block", at: str = "at") -> DataFrame:
    """Hits, best score and mean score of every key, by exact offset chunking.

    Needs the columns `block` and `at` (see file_block) besides `keys` and `score`.
    Result: keys, n_hits (all rows of the key), n_scored (rows with a score), best_score, mean_score
    (both null if no row has a score), n_chunks (how many chunks the key spans).
    Defined cases: a null key is a key of its own; null scores count as hits only; ties and repeated
    rows count as they are; an empty table gives no rows; other columns are ignored.
    """
    d = df.select(*keys, F.col(score).cast("bigint").alias("__s"), block, at)
    parts = chunked_states(
        d, keys,
        [F.count(F.lit(1)).alias("n"), F.count("__s").alias("k"), F.max("__s").alias("best"), F.sum("__s").alias("total")],
        chunk_rows, block, at,
    )
    merged = parts.groupBy(*keys).agg(
        F.sum("n").alias("n_hits"), F.sum("k").alias("n_scored"), F.max("best").alias("best_score"),
        F.sum("total").alias("__t"), F.count(F.lit(1)).alias("n_chunks"),
    )
    mean = F.when(F.col("n_scored") > 0, F.col("__t") / F.col("n_scored"))
    return merged.select(*keys, "n_hits", "n_scored", "best_score", mean.alias("mean_score"), "n_chunks")


def heavy_keys(stats: DataFrame, rows: DataFrame, kind: str, key: str, share: float = 0.03) -> DataFrame:
    """Keys that at least `share` of all rows of their kind hold; null is no key but counts as rows.

    `stats` has one row per (kind, key) with n_hits, `rows` the rows themselves, of which only the kinds are
    counted. Result: kind, key, n_hits, n_rows.
    """
    total = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n_rows"))  # one row per kind
    return null_safe(stats.select(kind, key, "n_hits"), total, [kind]).where(F.col(key).isNotNull() & (F.col("n_hits") >= F.lit(share) * F.col("n_rows")))
