"""Filling fixed-capacity chunks: dominance reduction on the size histogram, then best fit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.operators.ranking import ordinal_in_key

MOST_CAPACITY = 1 << 22
BLOCKS = 256


class Plan:
    """Slots: `count` items of `size`, from the ordinal `first` of that size, go `per` at a time into the
    chunks from `base` on. Everything is kept by size and multiplicity, never by item."""

    def __init__(self, hist: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(hist)
        self.taken = dict.fromkeys(hist, 0)
        self.live = sorted(hist)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.chunks = self.fixed = 0

    def take(self, size: int, count: int, base: int, per: int = 1) -> None:
        self.slots.append((size, self.taken[size], count, base, per))
        self.taken[size] += count
        self.left[size] -= count
        if not self.left[size]:
            del self.live[bisect_left(self.live, size)]

    def smallest(self, j: int, k: int) -> list[int]:
        """The k smallest items left besides one item of size j."""
        out: list[int] = []
        for s in self.live:
            out += [s] * min(k - len(out), self.left[s] - (s == j))
            if len(out) >= k:
                break
        return out

    def fix(self, j: int, partners: list[int], times: int) -> None:
        """`times` chunks, each holding one item of size j and one of each partner, closed for good."""
        for s in sorted({j, *partners}):
            per = (s == j) + partners.count(s)
            self.take(s, times * per, self.chunks, per)
        self.chunks += times
        self.fixed += times

    def best_pair(self, room: int, j: int) -> tuple[int, int] | None:
        """The two items besides one of size j with the largest sum within room."""
        best, fit = None, self.live[: bisect_right(self.live, room)]
        lo, hi = 0, len(fit) - 1
        while lo <= hi:
            a, b = fit[lo], fit[hi]
            if a + b > room:
                hi -= 1
                continue
            enough = (self.left[a] - (a == j) >= 1 + (a == b)) and self.left[b] - (b == j) >= 1
            if enough and (best is None or a + b > sum(best)):
                best = (a, b)
            lo += 1
        return best

    def reduce(self) -> None:
        """Largest size first, fixes a set that dominates every other feasible set with that item: the
        item alone if nothing fits beside it; with the largest that fits, if that fills the chunk, or
        at most one fits, or at most two fit and no two together are larger. Sizes for which no such
        set is found stay for best fit; each fixed set makes the instance smaller."""
        for j in sorted(self.live, reverse=True):
            while self.left[j]:
                room = self.capacity - j
                low = self.smallest(j, 3)
                if not low or low[0] > room:
                    self.fix(j, [], self.left[j])  # a second of size j doesn't fit either
                    continue
                i = bisect_right(self.live, room) - 1
                k = self.live[i]
                if k == j and self.left[j] == 1:
                    if i == 0:
                        break
                    k = self.live[i - 1]
                if k < room and len(low) > 1 and low[0] + low[1] <= room:
                    if len(low) > 2 and sum(low) <= room:
                        break
                    pair = self.best_pair(room, j)
                    if pair and sum(pair) > k:
                        break
                # as often as both last: taking items away only takes choices away, so while one of size k is
                # left it stays the largest that fits, no three come to fit and no pair comes to be larger
                self.fix(j, [k], self.left[j] // 2 if k == j else min(self.left[j], self.left[k]))

    def best_fit(self) -> None:
        """Best-fit decreasing of what is left, all items of a size at once: open chunks are kept as
        runs of equal free space. An item goes where it leaves the least room; having gone there, the
        next of its size goes into the same chunk while it fits."""
        free: list[tuple[int, int, int]] = []  # (space, first chunk, how many chunks)
        for size in sorted(self.live, reverse=True):
            while self.left.get(size):
                i = bisect_left(free, (size, -1, -1))
                if i < len(free):
                    space, base, many = free.pop(i)
                else:
                    per = self.capacity // size
                    many = -(-self.left[size] // per)
                    space, base = self.capacity, self.chunks
                    self.chunks += many
                per = space // size
                full = min(many, self.left[size] // per)
                if full:
                    self.take(size, full * per, base, per)
                    if space - per * size:
                        insort(free, (space - per * size, base, full))
                base, many, rest = base + full, many - full, self.left[size]
                if many and rest and rest < per:
                    self.take(size, rest, base, rest)
                    insort(free, (space - rest * size, base, 1))
                    base, many = base + 1, many - 1
                if many:
                    insort(free, (space, base, many))


def plan(hist: dict[int, int], capacity: int) -> Plan:
    p = Plan({s: n for s, n in hist.items() if s > 0 and n > 0}, capacity)
    p.reduce()
    p.best_fit()
    return p


def parts_of(df: DataFrame, item: str, size: Column, tie: str, capacity: int) -> DataFrame:
    """item, tie, part (from 1), n_parts, part_size: an item counts once; one above the capacity is cut
    into full parts and a rest. A null item name is an item of its own per row."""
    d = df.select(F.col(item).alias("item"), F.col(tie).alias("tie"), size.cast("bigint").alias("size"))
    own = F.when(F.col("item").isNull(), F.col("tie"))
    d = d.groupBy("item", own.alias("own")).agg(F.min("tie").alias("tie"), F.max("size").alias("size"))
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    d = d.withColumn("n_parts", F.coalesce(n, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(1), "n_parts")))
    part = F.when(F.col("part") < F.col("n_parts"), F.lit(capacity)).otherwise(F.col("size") - capacity * (F.col("n_parts") - 1))
    return d.select("item", "tie", "part", "n_parts", part.cast("bigint").alias("part_size"))


def pack(df: DataFrame, item: str, size: Column, tie: str, capacity: int) -> DataFrame:
    """A chunk number for every item or part of it: item, part, n_parts, part_size, chunk.

    The plan works on the histogram of sizes, which has at most `capacity` rows (MOST_CAPACITY at
    most) however many items there are; only it reaches the driver, and the plan sent back has at most
    a few slots a size. Items take the slots of their size by an exact ordinal that is
    computed without bringing a size into one task.
    Defined cases: an item counts once (its largest size holds); size 0 needs no room and goes to
    chunk 0, a negative size counts as 0; an unknown size gets a null chunk; equal sizes go by hash of
    tie; an empty table gives no rows; other columns are ignored.
    """
    if not 0 < capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity must be within 1..{MOST_CAPACITY}: the size histogram is held by the driver")
    spark = df.sparkSession
    parts = parts_of(df, item, size, tie, capacity)
    sized = parts.where("part_size > 0")
    hist = {r[0]: r[1] for r in sized.groupBy("part_size").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # at most `capacity` rows
    p = plan(hist, capacity)
    slots = np.array(sorted(p.slots), np.int64).reshape(-1, 5)
    sizes, where = np.unique(slots[:, 0], return_index=True)
    shared = spark.sparkContext.broadcast((slots, sizes, np.append(where, len(slots))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, sizes, where = shared.value
        most = int(slots[:, 1].max()) + 1 if len(slots) else 1
        key = np.repeat(np.arange(len(sizes)), np.diff(where)) * most + slots[:, 1] if len(slots) else slots[:, 0]
        for b in batches:
            s, o = b["part_size"].to_numpy(np.int64), b["ordinal"].to_numpy(np.int64)
            i = np.searchsorted(sizes, s)
            # beyond the first ordinal of a size's last slot all belong to that slot
            x = slots[np.searchsorted(key, i * most + np.minimum(o, most - 1), "right") - 1]
            b["chunk"] = x[:, 3] + (o - x[:, 1]) // x[:, 4]
            yield b[["item", "part", "n_parts", "part_size", "chunk"]]

    out = "item string, part int, n_parts int, part_size bigint, chunk bigint"
    numbered = ordinal_in_key(sized, ["part_size"], F.pmod(F.xxhash64("tie", "part"), F.lit(BLOCKS)), "tie")
    placed = numbered.select(F.col("item").cast("string"), "part", "n_parts", "part_size", "ordinal").mapInPandas(place, out)
    rest = parts.where("part_size is null or part_size <= 0").select(F.col("item").cast("string"), "part", "n_parts", "part_size", F.when(F.col("part_size").isNotNull(), F.lit(0)).cast("bigint").alias("chunk"))
    return placed.unionByName(rest)


def fill_report(chunks: DataFrame, capacity: int) -> DataFrame:
    """One row: chunks, parts, used, least_possible (chunks by volume), fill (used share of the space)."""
    per = chunks.where("chunk is not null").groupBy("chunk").agg(F.count(F.lit(1)).alias("parts"), F.sum("part_size").alias("used"))
    r = per.agg(F.count(F.lit(1)).alias("chunks"), F.sum("parts").alias("parts"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
    return r.withColumn("least_possible", F.ceil(F.col("used") / capacity)).withColumn("fill", F.round(F.col("used") / (F.col("chunks") * capacity), 6))
