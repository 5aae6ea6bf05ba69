"""Alignment kernels: gapless score as an expression, banded-free affine alignment in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from helixframe.functions.probability import COLOUR, LETTER

NEG = -(1 << 28)
CODE = np.full(256, 7, np.uint8)
for _k, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _k


def gapless_score(text: Column, seq: Column, shift: Column, match: int = LETTER["match"], mismatch: int = LETTER["mismatch"]) -> Column:
    """Best run along one diagonal: read base i lies over window base i + shift; sums restart below 0."""
    pairs = F.zip_with(F.split(seq, ""), F.split(F.concat(F.repeat(F.lit("."), F.greatest(-shift, F.lit(0))), F.substring(text, F.greatest(shift, F.lit(0)) + 1, F.length(seq))), ""), lambda a, b: F.when(b.isNull() | a.isNull() | b.isin("", "."), F.lit(None)).when((a == b) & a.isin("A", "C", "G", "T"), match).otherwise(mismatch))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, s: Column) -> Column:
        run = F.when(s.isNull(), 0).otherwise(F.greatest(acc["run"] + s, F.lit(0)))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(pairs, start, step)["best"]


def encode(strings: list[str]) -> np.ndarray:
    """Equal-length strings as base codes; ambiguous bases match nothing."""
    return CODE[np.frombuffer("".join(strings).encode("ascii", "replace"), np.uint8)].reshape(len(strings), -1)


def _substitution(g: np.ndarray, r: np.ndarray, s: dict) -> np.ndarray:
    return np.where((g == r) & (g < 4), s["match"], s["mismatch"])


def local_scores(genome: np.ndarray, read: np.ndarray, s: dict = LETTER) -> np.ndarray:
    """Local affine score of every pair of a batch, one read row after the other over all pairs at once."""
    b, n, m = len(genome), read.shape[1], genome.shape[1]
    h, best = np.zeros((b, m + 1), np.int32), np.zeros(b, np.int32)
    e = np.full((b, m + 1), NEG, np.int32)
    k = np.arange(m + 1, dtype=np.int32)
    for i in range(n):
        e = np.maximum(e, h + s["open"]) + s["ext_ins"]
        v = np.zeros((b, m + 1), np.int32)
        v[:, 1:] = np.maximum(h[:, :-1] + _substitution(genome, read[:, i : i + 1], s), 0)
        v[:, 1:] = np.maximum(v[:, 1:], e[:, 1:])
        # deletions: a gap of g costs open + g * ext, so the best start is a running maximum
        d = np.maximum.accumulate(v - k * s["ext_del"], axis=1)
        v[:, 1:] = np.maximum(v[:, 1:], d[:, :-1] + k[1:] * s["ext_del"] + s["open"])
        h = v
        best = np.maximum(best, h.max(1))
    return best


def global_alignments(genome: np.ndarray, read: np.ndarray, s: dict = LETTER, reverse_ties: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """(score, genome start, operations) of read end-to-end alignments with free genome ends.

    Operations by column: '=' match, 'X' mismatch, 'I' read base alone, 'D' genome base alone. On equal
    scores a diagonal comes before an insertion, and that before a deletion; reversed for `reverse_ties`.
    """
    b, n, m = len(genome), read.shape[1], genome.shape[1]
    h = np.zeros((n + 1, b, m + 1), np.int32)
    ins = np.full((n + 1, b, m + 1), NEG, np.int32)
    dele = np.full((n + 1, b, m + 1), NEG, np.int32)
    k = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        ins[i] = np.maximum(ins[i - 1], h[i - 1] + s["open"]) + s["ext_ins"]
        v = np.full((b, m + 1), NEG, np.int32)
        v[:, 1:] = h[i - 1][:, :-1] + _substitution(genome, read[:, i - 1 : i], s)
        v = np.maximum(v, ins[i])
        run = np.maximum.accumulate(v - k * s["ext_del"], axis=1)
        dele[i][:, 1:] = run[:, :-1] + k[1:] * s["ext_del"] + s["open"]
        h[i] = np.maximum(v, dele[i])
    out = []
    for x in range(b):
        last = h[n, x]
        back = reverse_ties is not None and bool(reverse_ties[x])
        j = int(last.argmax()) if not back else m - int(last[::-1].argmax())
        score, i, ops, state = int(last[j]), n, [], "H"
        while i > 0:
            if state == "H":
                here = h[i, x, j]
                diag = j > 0 and here == h[i - 1, x, j - 1] + (s["match"] if genome[x, j - 1] == read[x, i - 1] and read[x, i - 1] < 4 else s["mismatch"])
                choice = [("M", diag), ("I", here == ins[i, x, j]), ("D", here == dele[i, x, j])]
                state = next(c for c, ok in (choice[::-1] if back else choice) if ok)
                if state == "M":
                    ops.append("=" if genome[x, j - 1] == read[x, i - 1] and read[x, i - 1] < 4 else "X")
                    i, j, state = i - 1, j - 1, "H"
            elif state == "I":
                ops.append("I")
                if ins[i, x, j] == h[i - 1, x, j] + s["open"] + s["ext_ins"]:
                    state = "H"
                i -= 1
            else:
                ops.append("D")
                j -= 1
                # the gap began where its whole cost from here explains the score
                if dele[i, x, j + 1] == h[i, x, j] + s["open"] + s["ext_del"]:
                    state = "H"
        out.append((score, j, "".join(reversed(ops))))
    return out


def edit_string(ops: str, genome: str, read: str) -> str:
    """Edit string of alignment operations: matches counted, mismatches as the read's base, insertions in
    parentheses, deletions as dashes."""
    out, run, r, i = [], 0, 0, 0
    while i < len(ops):
        if ops[i] == "=":
            run, r, i = run + 1, r + 1, i + 1
            continue
        if run:
            out.append(str(run))
            run = 0
        j = i
        while j < len(ops) and ops[j] == ops[i]:
            j += 1
        if ops[i] == "X":
            out.append(read[r : r + j - i])
        elif ops[i] == "I":
            out.append(f"({read[r : r + j - i]})")
        else:
            out.append("-" * (j - i))
        r += (j - i) * (ops[i] != "D")
        i = j
    return "".join(out) + (str(run) if run else "")


CELLS = 1 << 22


def _by_shape(pairs: pd.DataFrame, layers: int = 1) -> Iterator[np.ndarray]:
    """Rows whose texts and reads are equally long, as many at a time as keep a matrix within CELLS cells (one
    alignment at least), so that long reads take no more memory than short ones."""
    for (m, n), rows in pairs.groupby([pairs["text"].str.len(), pairs["seq"].str.len()]).indices.items():
        step = max(1, min(1024, CELLS // (layers * (m + 1) * (n + 1))))
        yield from (rows[k : k + step] for k in range(0, len(rows), step))


@F.pandas_udf(T.IntegerType())
def local_score(text: pd.Series, seq: pd.Series) -> pd.Series:
    """Local affine alignment score of a read in a window; null or empty ones give 0."""
    p = pd.DataFrame({"text": text.fillna(""), "seq": seq.fillna("")}).reset_index(drop=True)
    out = np.zeros(len(p), np.int32)
    for rows in _by_shape(p):
        a, b = p["text"].iloc[rows], p["seq"].iloc[rows]
        if len(a.iloc[0]) and len(b.iloc[0]):
            out[rows] = local_scores(encode(list(a)), encode(list(b)))
    return pd.Series(out)


ALIGNED = "align_score int, align_start int, ops string, edit string"


@F.pandas_udf(T.StructType([T.StructField("score", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("ops", T.StringType()), T.StructField("edit", T.StringType())]))
def full_alignment(text: pd.Series, seq: pd.Series, reverse: pd.Series) -> pd.DataFrame:
    """Read end-to-end alignment in a window: score, start within it, operations and edit string."""
    p = pd.DataFrame({"text": text.fillna(""), "seq": seq.fillna(""), "rev": reverse.fillna(False)}).reset_index(drop=True)
    out: list = [(None, None, None, None)] * len(p)
    for rows in _by_shape(p):
        a, b = list(p["text"].iloc[rows]), list(p["seq"].iloc[rows])
        if a[0] and b[0]:
            for row, (score, start, ops), g, r in zip(rows, global_alignments(encode(a), encode(b), reverse_ties=p["rev"].iloc[rows].to_numpy()), a, b):
                out[row] = (score, start, ops, edit_string(ops, g, r))
    return pd.DataFrame(out, columns=["score", "start", "ops", "edit"]).astype({"score": "Int32", "start": "Int32"})


def score_windows(windows: DataFrame, key: str = "read_id") -> DataFrame:
    """Adds score_vec; a read's equal windows are scored once."""
    # a fixed number of parts: short rows of much work would otherwise be merged into few tasks
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = windows.select(key, "st", "text", "seq").distinct().repartition(parts, key).withColumn("score_vec", local_score("text", "seq"))
    return windows.join(once, [key, "st", "text", "seq"])


def decode_layers(colours: list[str], first: str = "T") -> np.ndarray:
    """(4, reads, length) base codes of equal-length colour reads: the letters that follow from the first base,
    and the same shifted by each of the other three constants, as a colour error shifts all later letters.
    An unknown colour counts as 0 and is scored as matching nothing at its place (code 7)."""
    raw = np.frombuffer("".join(colours).encode("ascii", "replace"), np.uint8).reshape(len(colours), -1)
    known = (raw >= ord("0")) & (raw <= ord("3"))
    steps = np.where(known, raw - ord("0"), 0).astype(np.uint8)
    base = np.bitwise_xor.accumulate(steps, axis=1) ^ CODE[ord(first)]
    layers = np.stack([base ^ k for k in range(4)])
    return np.where(known[None], layers, 7)


def colour_alignments(genome: np.ndarray, layers: np.ndarray, s: dict) -> list[tuple[int, int, str, int]]:
    """(score, genome start, operations, crossovers) of colour reads end to end, with free genome ends.

    Four letter translations of a read are aligned at once; between two read bases the alignment may change
    to another translation for the crossover score, which is how a wrong colour is explained. A genome is
    letters, as are the operations; lower-case operations are those right after a crossover.
    """
    _, b, n = layers.shape
    m = genome.shape[1]
    h = np.full((n + 1, 4, b, m + 1), NEG, np.int32)
    h[0, 0] = 0
    h[0, 1:] = s["crossover"]
    ins = np.full_like(h, NEG)
    dele = np.full_like(h, NEG)
    k = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        best = h[i - 1].max(0)
        enter = np.maximum(h[i - 1], best[None] + s["crossover"]) if i > 1 else h[0]
        sub = np.where((genome[None] == layers[:, :, i - 1 : i]) & (genome[None] < 4), s["match"], np.where(layers[:, :, i - 1 : i] > 3, 0, s["mismatch"]))
        ins[i] = np.maximum(ins[i - 1], h[i - 1] + s["open"]) + s["ext_ins"]
        v = np.full((4, b, m + 1), NEG, np.int32)
        v[:, :, 1:] = enter[:, :, :-1] + sub
        v = np.maximum(v, ins[i])
        run = np.maximum.accumulate(v - k * s["ext_del"], axis=2)
        dele[i][:, :, 1:] = run[:, :, :-1] + k[1:] * s["ext_del"] + s["open"]
        h[i] = np.maximum(v, dele[i])
    out = []
    for x in range(b):
        last = h[n, :, x]
        layer, j = (int(q) for q in np.unravel_index(last.argmax(), last.shape))
        score, i, ops, state, crossed = int(last[layer, j]), n, [], "H", 0
        while i > 0:
            here = h[i, layer, x, j]
            if state == "H":
                r = layers[layer, x, i - 1]
                same = j > 0 and genome[x, j - 1] == r and r < 4
                pay = s["match"] if same else (0 if r > 3 else s["mismatch"])
                if j > 0 and here == h[i - 1, layer, x, j - 1] + pay:
                    ops.append("=" if same else "X")
                    i, j = i - 1, j - 1
                elif j > 0 and i > 1 and here == h[i - 1, :, x, j - 1].max() + s["crossover"] + pay:
                    ops.append("e" if same else "x")
                    layer = int(h[i - 1, :, x, j - 1].argmax())
                    crossed += 1
                    i, j = i - 1, j - 1
                else:
                    state = "I" if here == ins[i, layer, x, j] else "D"
            elif state == "I":
                ops.append("I")
                if ins[i, layer, x, j] == h[i - 1, layer, x, j] + s["open"] + s["ext_ins"]:
                    state = "H"
                i -= 1
            else:
                ops.append("D")
                j -= 1
                if dele[i, layer, x, j + 1] == h[i, layer, x, j] + s["open"] + s["ext_del"]:
                    state = "H"
        crossed += int(layer != 0)  # a wrong first colour
        out.append((score, j, "".join(reversed(ops)), crossed))
    return out


@F.pandas_udf(T.StructType([T.StructField("score", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("ops", T.StringType()), T.StructField("crossovers", T.IntegerType())]))
def colour_alignment(text: pd.Series, colours: pd.Series) -> pd.DataFrame:
    """Colour read (without its leading base) against a letter window; null or empty ones give nulls."""
    p = pd.DataFrame({"text": text.fillna(""), "seq": colours.fillna("")}).reset_index(drop=True)
    out: list = [(None, None, None, None)] * len(p)
    for rows in _by_shape(p, 4):
        a, c = list(p["text"].iloc[rows]), list(p["seq"].iloc[rows])
        if a[0] and c[0]:
            for row, got in zip(rows, colour_alignments(encode(a), decode_layers(c), COLOUR)):
                out[row] = got
    return pd.DataFrame(out, columns=["score", "start", "ops", "crossovers"]).astype({"score": "Int32", "start": "Int32", "crossovers": "Int32"})


def pretty(ops: str, genome: str, read: str, start: int) -> str:
    """Three lines: genome, marks of matches, read, with dashes at gaps."""
    g, k, r, i, j = [], [], [], start, 0
    for o in ops:
        g.append("-" if o == "I" else genome[i])
        r.append("-" if o == "D" else read[j])
        k.append("|" if o == "=" else " ")
        i, j = i + (o != "I"), j + (o != "D")
    return "\n".join(("G: " + "".join(g), "   " + "".join(k), "R: " + "".join(r)))
