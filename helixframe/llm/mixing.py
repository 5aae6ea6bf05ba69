"""Drawing documents so that sources meet target shares of the tokens: soft-membership mixing."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from helixframe.llm.partial_sums import summed
from helixframe.operators.ranking import null_safe, prefix_over_buckets
from helixframe.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FEATURES = 1 << 12
SMOOTH = 1.0
HELD_OUT = 5
TEMPERATURES = (*(float(1 << k) for k in range(13)), math.inf)
MOST_STEPS, TOLERANCE = 40, 1e-4
BUCKETS = 4096

# Fixed value: the published pre-splitting pattern of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD = re.compile(r"[^\W\d_]+")


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def features(text: str | None) -> np.ndarray:
    """Hashed words of a text, each once; crc keeps it the same in every process."""
    import zlib

    return np.array(sorted({zlib.crc32(w.encode()) % FEATURES for w in _WORD.findall((text or "").lower())}), np.int32)


def measure(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens, words (hashed, only where the source is unknown or for all: binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            tokens = [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
            words = [features(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(tokens, pa.int64()), pa.array(words, pa.binary())], names=["doc_id", "source", "tokens", "words"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint, words binary")


def class_of(sources: list[str]) -> Column:
    """The place of a known source in the list, from 1; 0 for one outside it."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, sources)), F.col("source")).cast("int"), F.lit(0)) if sources else F.lit(0)


class Classifier:
    """Bernoulli classifier of documents by their hashed words into the sources, and one class for all others."""

    def __init__(self, counts: np.ndarray):
        total = counts[FEATURES]
        p = (counts[:FEATURES] + SMOOTH) / (total + 2 * SMOOTH)
        self.odds = np.log(p) - np.log1p(-p)
        self.base = np.log1p(-p).sum(0)
        # a class without documents has no share in any
        self.prior = np.where(total > 0, np.log((total + SMOOTH) / (total.sum() + len(total) * SMOOTH)), -1e9)
        self.temperature = 1.0

    def evidence(self, words: pa.Array) -> np.ndarray:
        return np.array([self.odds[np.frombuffer(v.as_buffer(), np.int32)].sum(0) + self.base for v in words]).reshape(-1, len(self.prior))

    def posteriors(self, evidence: np.ndarray, temperature: float | None = None) -> np.ndarray:
        """Shares of the classes. Words of a text depend on each other, so that their evidence taken as it is
        makes much too sure: it is divided by a temperature."""
        z = evidence / (self.temperature if temperature is None else temperature) + self.prior
        q = np.exp(z - z.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def train(known: DataFrame, sources: list[str]) -> Classifier:
    """A classifier from the documents whose source is known. One in HELD_OUT, by hash, isn't counted: on these the
    temperature is chosen that makes their true sources likeliest."""
    n = len(sources) + 1
    marked = known.select("words", class_of(sources).alias("at"), (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(HELD_OUT)) == 0).alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        m = None
        for b in batches:
            m = np.zeros((FEATURES + 1, n)) if m is None else m
            for v, s in zip(b.column("words"), b.column("at").to_pylist()):
                m[np.frombuffer(v.as_buffer(), np.int32), s - 1] += 1
                m[FEATURES, s - 1] += 1
        return m

    c = Classifier(summed(marked.where("not held"), count, (FEATURES + 1) * n).reshape(FEATURES + 1, n))

    def loss(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        m = None
        for b in batches:
            m = np.zeros(len(TEMPERATURES)) if m is None else m
            e, s = c.evidence(b.column("words")), np.array(b.column("at").to_pylist(), np.int64) - 1
            if len(s):
                m += [-np.log(np.maximum(c.posteriors(e, t)[np.arange(len(s)), s], 1e-300)).sum() for t in TEMPERATURES]
        return m

    c.temperature = TEMPERATURES[int(summed(marked.where("held"), loss, len(TEMPERATURES)).argmin())]
    return c


def membership(measured: DataFrame, c: Classifier) -> DataFrame:
    """doc_id, tokens and `share` (float64s: one share for every class) of the documents without a source."""
    held = measured.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = held.value.posteriors(held.value.evidence(b.column("words")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tokens"), pa.array([x.tobytes() for x in p], pa.binary())], names=["doc_id", "tokens", "share"])

    return measured.where("source is null and tokens > 0").mapInArrow(run, "doc_id bigint, tokens bigint, share binary")


class Rates:
    """Rates (draws a document) by projected-gradient least squares over all documents.

    Minimises the squared distance of the expected tokens of every source from weight * total over rates between 0 and
    the caps, where total is the largest that the caps of the known documents allow, each source scaled by the tokens that may come
    from it. Documents of one known source have equal rows in this problem and share a rate; each of the others
    has its own by its shares in all sources. A step moves a rate by its shares times the scaled misses, so the rate of
    a document follows from the misses of all steps, which are kept here, and no state is kept for documents. Steps are accelerated: each starts from rates carried on in
    the direction of the last.
    Sources without documents can't be met; the weights of the others are scaled to one.
    """

    def __init__(self, known: np.ndarray, unsure: np.ndarray, weights: np.ndarray, caps: np.ndarray):
        self.known, self.caps = known, np.where(weights > 0, caps, 0.0)
        # whichever source it is of, an unsure document is not used too often
        self.unsure_cap = float(self.caps[weights > 0].min()) if (weights > 0).any() else 0.0
        self.reach = known + unsure
        # what a source can give for certain; one that only unsure documents hold, half of what they can give, as they
        # give to all others too
        full = np.where(known > 0, known * self.caps, unsure * self.unsure_cap / 2)
        w = np.where(full > 0, weights, 0.0)
        self.goal = w / w.sum() * (full[w > 0] / (w / w.sum())[w > 0]).min() if w.sum() else np.zeros(len(w))
        self.steps: list[np.ndarray] = []

    def walk(self, cap, moves) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all steps, and those carried on in their direction, from which the next step starts."""
        r = ahead = np.zeros(np.shape(moves[0]) if moves else ())
        for k, x in enumerate(moves, 1):
            new = np.clip(ahead - x, 0.0, cap)
            r, ahead = new, new + (k - 1) / (k + 2) * (new - r)
        return r, ahead

    def of(self, share: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates of documents without a source, by their shares in the sources and the last class."""
        p = share[:, :-1] / np.maximum(share[:, :-1].sum(1, keepdims=True), 1e-12)
        return self.walk(self.unsure_cap, [p @ g for g in self.steps])[ahead] if self.steps else np.zeros(len(p))

    def of_known(self, ahead: bool = False) -> np.ndarray:
        return self.walk(self.caps, [np.where(self.known > 0, g, 0.0) for g in self.steps])[ahead] if self.steps else np.zeros(len(self.known))

    def miss(self, drawn_unsure: np.ndarray) -> np.ndarray:
        return self.of_known(True) * self.known + drawn_unsure - self.goal

    def step(self, drawn_unsure: np.ndarray) -> None:
        self.steps.append(self.miss(drawn_unsure) / np.maximum(self.reach, 1e-12))


def expected(unsure: DataFrame, rates: Rates | None, n: int) -> np.ndarray:
    """Tokens that documents without a source are expected to give to every class: all of them, or at the rates from which the next
    step starts."""
    held = unsure.sparkSession.sparkContext.broadcast(rates)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        s = None
        for b in batches:
            p = np.frombuffer(b"".join(b.column("share").to_pylist()), np.float64).reshape(-1, n)
            t = np.asarray(b.column("tokens"), np.float64) * (1.0 if held.value is None else held.value.of(p, True))
            s = t @ p if s is None else s + t @ p
        return s

    return summed(unsure, run, n)


def solve(known: np.ndarray, unsure: DataFrame, weights: np.ndarray, caps: np.ndarray) -> Rates:
    """Steps until no source misses its goal by more than TOLERANCE of the total, MOST_STEPS at most: where
    caps and shares leave a goal out of reach, the report tells the shares that came out."""
    n = len(known) + 1
    every = expected(unsure, None, n)[:-1]
    r = Rates(known, every, weights, caps)
    total = max(r.goal.sum(), 1e-12)
    for _ in range(MOST_STEPS):
        drawn = expected(unsure, r, n)[:-1] if every.sum() and r.steps else np.zeros(n - 1)
        if np.abs(r.miss(drawn)).max(initial=0.0) <= TOLERANCE * total:
            break
        r.step(drawn)
    return r


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Drawn documents (doc_id, source, tokens, uses) and the report by source.

    docs has doc_id, text and source, targets source, weight and max_repeats (a fixed small list). A known
    source counts as it is; a document without one counts for every source by the share that a
    classifier gives it (see train), and may be used as often as the strictest source with a target allows. Rates
    come from projected-gradient least squares (see Rates). The rate of a known source is turned into whole uses: all
    its documents get the whole part, and those first by hash one more, up to the tokens that the rate asks for (to half a document). The
    cut comes from token sums per hash bucket, so no task sorts a source. A document without a source is
    rounded up or down by its hash.

    The report has a row for every source with a target or documents, and one for null: source, target, documents, drawn
    (documents), tokens_drawn (of the source, with the expected part of the drawn documents without one; for null, what
    these give to sources without a target), actual (share of all drawn tokens), reachable (whether it has documents).
    Defined cases: null and empty texts have no tokens and aren't drawn; a source without a target is not
    drawn; a null max_repeats is once; empty tables give no draws; repeated rows are drawn each on its own;
    other columns are ignored.
    """
    rows = targets.groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats")).where("source is not null").orderBy("source").collect()
    sources, n = [r["source"] for r in rows], len(rows) + 1
    weights = np.array([max(float(r["weight"] or 0), 0.0) for r in rows])
    caps = np.array([float(max(r["max_repeats"] if r["max_repeats"] is not None else 1, 0)) for r in rows])
    measured = cut(measure(docs, tokenizer))
    c = train(measured.where("source is not null"), sources)
    unsure = cut(membership(measured, c))
    of_known = measured.where(F.col("source").isin(sources) & (F.col("tokens") > 0))
    held = {r["source"]: r["t"] for r in of_known.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("t")).collect()}  # one row a source
    rates = solve(np.array([float(held.get(s, 0)) for s in sources]), unsure, weights, caps)
    plan = [(s, int(r + 1e-9), max(0.0, (r - int(r + 1e-9)) * held[s])) for s, r in zip(sources, rates.of_known().tolist()) if s in held]
    spark = docs.sparkSession
    shared = F.broadcast(spark.createDataFrame(plan, "source string, whole int, extra double"))  # one row a source
    step = (1 << 30) // BUCKETS
    m = of_known.select("doc_id", "source", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("u")).join(shared, "source").withColumn("bucket", F.floor(F.col("u") / step).cast("int"))
    totals = m.groupBy("source", "bucket").agg(F.sum("tokens").cast("bigint").alias("t"))  # at most BUCKETS rows a source
    before = prefix_over_buckets(totals, ["source"], "bucket", ["t"])
    near = m.join(before, ["source", "bucket"])
    run = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("u", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, 0))
    uses = F.col("whole") + F.when(F.col("before_t") + F.col("upto") - F.col("tokens") / 2 <= F.col("extra"), 1).otherwise(0)
    none = F.lit(None).cast("binary")
    sure = near.withColumn("upto", run).select("doc_id", "source", "tokens", uses.cast("int").alias("uses"), none.alias("share"))
    given = spark.sparkContext.broadcast(rates)

    def at_rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.frombuffer(b"".join(b.column("share").to_pylist()), np.float64).reshape(-1, n)
            times = np.floor(given.value.of(p) + np.asarray(b.column("u"), np.float64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.nulls(b.num_rows, pa.string()), b.column("tokens"), pa.array(times), b.column("share")], names=["doc_id", "source", "tokens", "uses", "share"])

    u = (F.pmod(F.xxhash64("doc_id", F.lit("uses")), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    others = unsure.select("doc_id", "tokens", "share", u).mapInArrow(at_rate, "doc_id bigint, source string, tokens bigint, uses int, share binary")
    drawn = cut(sure.unionByName(others).where("uses > 0"))

    def by_share(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        s = None
        for b in batches:
            x = (np.asarray(b.column("tokens"), np.float64) * np.asarray(b.column("uses"))) @ np.frombuffer(b"".join(b.column("share").to_pylist()), np.float64).reshape(-1, n)
            s = x if s is None else s + x
        return s

    soft = summed(drawn.where("share is not null").select("tokens", "uses", "share"), by_share, n)
    expect = spark.createDataFrame(list(zip([*sources, None], soft.tolist())), "source string, soft double")  # one row a source
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("drawn"), F.sum(F.when(F.col("share").isNull(), F.col("tokens") * F.col("uses"))).cast("bigint").alias("hard"))
    have = measured.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    goal = targets.where("source is not null").groupBy("source").agg(F.sum("weight").alias("target"))
    r = have.join(goal, "source", "full")
    r = null_safe(null_safe(r, got, ["source"], "left"), F.broadcast(expect), ["source"], "left")
    zero = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
    r = r.withColumn("t", zero("hard") + zero("soft"))
    report = r.select(
        "source", F.round("target", 6).alias("target"), zero("documents").alias("documents"), zero("drawn").alias("drawn"), F.round("t").cast("bigint").alias("tokens_drawn"),
        F.round(zero(F.try_divide("t", F.sum("t").over(W.partitionBy()))), 6).alias("actual"), (zero("documents") > 0).alias("reachable"),
    )
    return drawn.drop("share"), report
