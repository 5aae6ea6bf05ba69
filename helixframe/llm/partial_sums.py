"""Adding up large arrays that partitions compute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STEP = 1024 * 64


def summed(df: DataFrame, run, size: int) -> np.ndarray:
    """Sums float arrays of a fixed size that the partitions give, in blocks of STEP values by key: what
    reaches the driver is one array, however many partitions there are. Blocks are sent in the precision that a
    partition gives and added up in float64; those that are all zero aren't sent."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        if total is not None:
            flat = total.ravel()
            parts = [(k // STEP, x) for k in range(0, len(flat), STEP) if (x := flat[k : k + STEP]).any()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["k", "v"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, length = 0, min(STEP, size - key[0].as_py() * STEP)
        for b in batches:
            for v in b.column("v"):
                x = v.as_buffer()
                s = s + np.frombuffer(x, np.float32 if x.size == 4 * length else np.float64).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["k", "v"])

    got = df.mapInArrow(split, "k int, v binary").groupBy("k").applyInArrow(add, "k int, v binary").collect()
    out = np.zeros(size)
    for r in got:
        out[r["k"] * STEP : (r["k"] + 1) * STEP] = np.frombuffer(r["v"], np.float64)
    return out
