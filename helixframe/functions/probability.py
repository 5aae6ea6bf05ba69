"""Probability model of alignments as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Default scores of both spaces, and coefficients of the normal distribution's approximation.
LETTER = {"match": 10, "mismatch": -15, "open": -33, "ext_del": -7, "ext_ins": -3}
COLOUR = {"match": 10, "mismatch": -24, "open": -33, "ext_del": -7, "ext_ins": -3, "crossover": -20}
CDF_B = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CDF_PI = 3.141592653589
PR_MISMATCH, PR_CROSSOVER = 0.01, 0.03
FLOOR = 1e-200
MISSED = ((40, 1e-10), (60, 1e-14), (None, 1e-16))


@dataclass(frozen=True)
class Model:
    """Scores tied to probabilities: score = alpha * log2(odds) + beta a base."""

    match: int
    mismatch: int
    alpha: float
    beta: float


def letter_model(s: dict = LETTER, p: float = PR_MISMATCH) -> Model:
    alpha = (s["match"] - s["mismatch"]) / math.log2((1 - p) / (p / 3))
    return Model(s["match"], s["mismatch"], alpha, s["match"] - 2 * alpha - alpha * math.log2(1 - p))


def colour_model(s: dict = COLOUR, p: float = PR_CROSSOVER) -> Model:
    alpha = s["crossover"] / math.log2(p / 3)
    mm = 1 / (1 + 2 ** ((s["match"] - s["mismatch"]) / alpha) / 3)
    return Model(s["match"], s["mismatch"], alpha, s["match"] - 2 * alpha - alpha * math.log2(1 - mm))


def posterior(score: Column, mapped: Column, m: Model) -> Column:
    """Unnormalised posterior of an alignment over `mapped` read bases."""
    return F.pow(F.lit(2.0), (score - mapped * (2 * m.alpha + m.beta)) / m.alpha)


def log2_posterior(score: Column, mapped: Column, m: Model) -> Column:
    return (score - mapped * (2 * m.alpha + m.beta)) / m.alpha


def quality_from_error(p: Column) -> Column:
    return F.when(p > 0.99999999, 0).when(p < 1e-25, 250).otherwise((F.lit(-10.0) * F.ln(p) / math.log(10.0)).cast("int"))


def error_from_quality(q: Column) -> Column:
    return F.when(q <= 0, 0.99999999).when(q >= 250, 1e-25).otherwise(F.pow(F.lit(10.0), -q / 10.0))


def to_neglog(x: Column, shift: int = 1000) -> Column:
    return (F.lit(float(shift)) * -F.ln(x)).cast("int")


def from_neglog(y: Column, shift: int = 1000) -> Column:
    return F.exp(-y / float(shift))


def normal_cdf(x: Column, mean: float, sd: float) -> Column:
    b0, b1, b2, b3, b4, b5 = CDF_B
    y = F.abs((x - mean) / sd)
    t = F.lit(1.0) / (F.lit(1.0) + y * b0)
    tail = F.exp(-y * y / 2) / math.sqrt(2 * CDF_PI) * ((((t * b5 + b4) * t + b3) * t + b2) * t + b1) * t
    return F.when(x > mean, 1 - tail).otherwise(tail)


def insert_probability(size: Column, mean: float = 200.0, sd: float = 100.0, reach: float = 10.0) -> Column:
    return F.greatest(normal_cdf(size + reach, mean, sd) - normal_cdf(size - reach, mean, sd), F.lit(FLOOR))


def missed_mate(read_len: Column) -> Column:
    return F.when(read_len < MISSED[0][0], MISSED[0][1]).when(read_len < MISSED[1][0], MISSED[1][1]).otherwise(MISSED[2][1])


def lgamma_table(n: int) -> np.ndarray:
    """ln k! for k = 0..n."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def log_choose_array(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    n, k = np.asarray(n, np.int64), np.asarray(k, np.int64)
    ok = (k >= 0) & (k <= n)
    t = lgamma_table(int(max(n.max(initial=0), 0)) + 1)
    a, b = np.where(ok, n, 0), np.where(ok, k, 0)
    return np.where(ok, t[a] - t[b] - t[a - b], 0.0)


@F.pandas_udf(T.DoubleType())
def log_choose(n: pd.Series, k: pd.Series) -> pd.Series:
    """ln C(n, k); 0 where k is outside 0..n."""
    return pd.Series(np.where(n.isna() | k.isna(), np.nan, log_choose_array(n.fillna(0).to_numpy(), k.fillna(0).to_numpy())))


def chance_of_score(score: Column, read_len: Column, m: Model) -> Column:
    """Probability that a random place maps a read with at least this score."""
    errors = F.ceil((read_len * m.match - score) / float(abs(m.mismatch - m.match)))
    p = F.exp(log_choose(read_len, errors) + errors * math.log(3) - read_len * math.log(4))
    return F.when(score > read_len * m.match, F.lit(FLOOR)).otherwise(p)


ALMOST_ZERO, ALMOST_ONE = 1e-9, 1 - 1e-9


def at_least(n: int, k: int, rate: float, t: np.ndarray) -> float:
    """P(at least k of n events)."""
    s = 0.0
    for i in range(k):
        c = t[n] - t[i] - t[n - i] if 0 <= i <= n else 0.0
        s += math.exp(c + i * math.log(rate) + (n - i) * math.log(1 - rate))
    return 1 - s


def genome_probability(k: int, errors: int, e: float, subs: int, s: float, indels: int, i: float, t: np.ndarray) -> float:
    """Likelihood that a read of the genome differs this much or more: product of three upper tails."""
    r = at_least(k - 1, errors, e, t) * at_least(k - 2 - errors, subs, s, t) * at_least(k - 1, indels, i, t)
    return min(max(r, ALMOST_ZERO), ALMOST_ONE)


def partitions_table(n: int) -> np.ndarray:
    """[objects, parts]: the number of ways to write `objects` as exactly `parts` positive summands."""
    p = np.zeros((n + 1, n + 1))
    p[0, 0] = 1
    for o in range(1, n + 1):
        for b in range(1, o + 1):
            p[o, b] = p[o - 1, b - 1] + (p[o - b, b] if o - b >= b else 0)
    return p


def chance_probability(length: int, k: int, subs: int, errors: int, read_len: int, del_sizes: list[int], ins_sizes: list[int], t: np.ndarray, parts: np.ndarray) -> float:
    """Probability that a random genome of this length holds a place as similar: words within the same
    substitutions and indel sizes over all words, at both strands' positions.

    del_sizes are read bases without a genome base by event, ins_sizes genome bases without a read base."""
    choose = lambda n, m: math.exp(t[n] - t[m] - t[n - m]) if 0 <= m <= n else 0.0
    nd, ni, dels, ins = len(del_sizes), len(ins_sizes), sum(del_sizes), sum(ins_sizes)
    same = lambda sizes: math.prod(math.factorial(sizes.count(x)) for x in set(sizes))
    fd, fi = math.factorial(nd) / same(del_sizes), math.factorial(ni) / same(ins_sizes)
    three = 3.0**dels
    spread = parts[dels, nd]
    most = fd * fi * choose(k, ni) * spread * choose(k + nd - ins, nd) * three
    least = fd * choose(k + nd, nd) * three if ins == 0 else fd * spread * choose(k + nd - ins, nd) * three
    ways = 0.5 * (most + least)
    subs += errors
    if ways <= 0 or subs > k or read_len - k + 1 <= 0:
        return ALMOST_ZERO
    r = t[k] - t[subs] - t[k - subs] + subs * math.log(3) + math.log(ways) + math.log(read_len - k + 1) - k * math.log(4)
    if r > 0:
        return 1.0
    r = math.exp(r)
    p = 2.0 * length * r if 1 - r == 1 else (1.0 if r >= 1 else -math.expm1(2.0 * length * math.log1p(-r)))
    return max(p, ALMOST_ZERO)
