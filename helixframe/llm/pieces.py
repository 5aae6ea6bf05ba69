"""Cutting oversized texts at natural boundaries near content-defined landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: an assembly gap: at least ten unknown bases
GAP = r"[NnXx.]{10,}"
WINDOW = 32
SCHEMA = "name string, piece int, first bigint, last bigint, cut string, longest_stretch bigint"


def _table(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def landmarks(data: np.ndarray, lo: int, hi: int, every: int, table: np.ndarray) -> np.ndarray:
    """Positions p in [lo, hi) at which a rolling hash of the WINDOW bytes before p says to cut."""
    a = max(lo - WINDOW, 0)
    t = table[data[a:hi]]
    if len(t) < WINDOW:
        return np.zeros(0, np.int64)
    h = np.zeros(len(t) - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + t[k : k + len(h)]
    at = a + WINDOW + np.flatnonzero((h >> np.uint64(20)) % np.uint64(every) == 0)
    return at[(at >= lo) & (at < hi)]


def cut_positions(text: str, most: int, overlap: int, least: int, boundary: re.Pattern, table: np.ndarray) -> tuple[list[tuple[int, int, str]], int]:
    """Pieces (start, end, how the end was cut; 0-based, end exclusive) and the longest unbroken stretch.

    From a piece's start, the first landmark past `least` is snapped to the nearest boundary that
    keeps the piece within `most`. Only where no boundary lies within reach the landmark itself is the
    cut, and without a landmark the limit. Pieces after an edit meet the old cuts at the next common
    landmark or boundary.
    """
    n = len(text)
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint8) if not text.isascii() else np.frombuffer(text.encode(), np.uint8)
    runs = np.array([m.span() for m in boundary.finditer(text)], np.int64).reshape(-1, 2)
    stretch = int(np.max(np.append(runs[:, 0], n) - np.append(0, runs[:, 1])))
    out, at, r = [], 0, 0
    while n - at > most:
        limit = at + most
        while r < len(runs) and min(runs[r, 1], limit) <= at + overlap:
            r += 1
        stop = int(np.searchsorted(runs[:, 0], limit, "right"))
        near = runs[r:stop]
        marks = landmarks(raw, at + least, limit, max(1, most // 8), table)
        want = int(marks[0]) if len(marks) else limit
        if len(near):
            ends = np.minimum(near[:, 1], limit)
            fit = ends >= at + least
            if fit.any():
                ends = ends[fit]
                cut = int(ends[np.argmin(np.abs(ends - want))])
            else:
                cut = int(ends[-1])
            out.append((at, cut, "gap"))
        else:
            cut = want
            out.append((at, cut, "forced"))
        at = cut - overlap
    out.append((at, n, "end"))
    return out, stretch


def split_texts(df: DataFrame, key: str, text: str, most: int, overlap: int, least: int | None = None, boundary: str = GAP, tie: str | None = None) -> DataFrame:
    """Pieces of every text longer than `most`: name, piece (from 1), first, last (1-based, inclusive),
    cut (how the piece ends: 'gap', 'forced' or 'end') and longest_stretch (of the text, between
    neighbouring boundaries or a boundary and an end).

    A piece has at most `most` characters and shares exactly `overlap` with the one before it. Cuts
    lie in boundaries wherever one can be reached; see cut_positions. Texts are cut one by one, in
    Arrow batches of single rows' size, with the hash taken over one piece's reach at a time.
    Defined cases: a key counts once, with the text of its smallest `tie` (among its long texts); null
    texts and texts up to `most` give no rows; a null key is a key; an empty table gives no rows.
    """
    least = most // 4 if least is None else least
    if not 0 <= overlap < least <= most:
        raise ValueError("overlap < least <= most is needed")
    d = df.where(F.length(text) > most).select(F.col(key).alias("name"), F.col(text).alias("text"), (F.col(tie) if tie else F.lit(0)).alias("tie"))
    kept = d.groupBy("name").agg(F.min("tie").alias("tie"), F.count(F.lit(1)).alias("times"))
    # only repeated keys need the comparison; equal (key, tie) rows are made one by their row hash
    d = d.join(kept.where("times > 1"), d["name"].eqNullSafe(kept["name"]) & (d["tie"] != kept["tie"]), "left_anti")
    if not tie:
        d = d.dropDuplicates(["name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pattern = _table(), re.compile(boundary)
        for b in batches:
            rows: dict[str, list] = {c: [] for c in ("name", "piece", "first", "last", "cut", "longest_stretch")}
            for name, body in zip(b.column(0).to_pylist(), b.column(1)):
                parts, stretch = cut_positions(body.as_py(), most, overlap, least, pattern, table)
                for i, (s, e, how) in enumerate(parts, 1):
                    for c, v in zip(rows, (name, i, s + 1, e, how, stretch)):
                        rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=list(rows))

    return d.select("name", "text").mapInArrow(run, SCHEMA)
