"""Evaluation texts within a corpus: latent semantic retrieval, then common-subsequence checks."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm.partial_sums import summed
from helixframe.session import cut

PASSAGE, STEP = 28, 14
LEAST_WORDS, EDIT_SHARE = 14, 8
RUN = 5
MOST_EDITS = 3
ANSWER_WORDS, ANSWER_SHARE = 16, 0.75
SHARED_RUN, SHARED_ITEMS = 8, 3
RANK, OVERSAMPLE, POWER_PASSES = 256, 16, 1
COSINE = 0.25
SURE_WORDS, SURE_MISSED = 13, 2
BLOCK, PRODUCTS = 256, 1 << 21
MOST_EVAL_WORDS = 2_000_000

_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|font|code|sub|sup|mark|small|tt)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
_PREFIX = re.compile(r"(?m)^[ \t]*(?://+|#+|>+|\*+|--+|;+|%+)[ \t]?")
_BROKEN = re.compile(r"([^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­͏᠎​-‏‪-‮⁠-⁤﻿]")


def words(text: str | None) -> list[str]:
    """The words of a text as a reader sees them: no markup, entities, marks of comments or quotes at line
    starts, invisible characters, hyphens at line ends, letter case, accents or punctuation."""
    if not text:
        return []
    t = text
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = _HIDDEN.sub("", unicodedata.normalize("NFKD", t))
        t = "".join(c for c in t if not unicodedata.combining(c))
    t = t.replace("\\r", " ").replace("\\n", "\n").replace("\\t", " ")
    if "\n" in t or t[:1] in "/#>*-;% \t":
        t = _BROKEN.sub(r"\1", _PREFIX.sub("", t))
    return _WORD.findall(t.casefold())


class Evaluation:
    """The evaluation items as term numbers. Runs of SHARED_RUN words that SHARED_ITEMS items have in
    common (instructions and the like) are masked: they match nothing. The set is held whole by the
    driver and every task, so its size is checked; it doesn't grow with the corpus."""

    def __init__(self, items: list[tuple[int, str | None]]):
        texts = {i: words(t) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0])) if i is not None}
        if sum(map(len, texts.values())) > MOST_EVAL_WORDS:
            raise ValueError(f"more than {MOST_EVAL_WORDS} words of evaluation texts: run them in parts")
        holders: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for i, w in texts.items():
            for k in range(len(w) - SHARED_RUN + 1):
                holders[tuple(w[k : k + SHARED_RUN])].add(i)
        self.terms: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        for i, w in texts.items():
            shared = np.zeros(len(w), bool)
            for k in range(len(w) - SHARED_RUN + 1):
                if len(holders[tuple(w[k : k + SHARED_RUN])]) >= SHARED_ITEMS:
                    shared[k : k + SHARED_RUN] = True
            self.items[i] = np.array([-2 if s else self.terms.setdefault(x, len(self.terms)) for x, s in zip(w, shared)], np.int32)
        self.order = list(self.items)
        # windows of PASSAGE words, STEP apart: any LEAST_WORDS successive words lie within one
        ids = np.concatenate([np.zeros(0, np.int32), *self.items.values()])
        self.owner, start, end = windows_of(np.array([len(x) for x in self.items.values()], np.int64))
        self.grid = term_grid(ids, start, end, len(self.terms)) if len(ids) else np.zeros((0, PASSAGE), np.int64)
        runs = [(r, k) for k, i in enumerate(self.order) for r in np.unique(run_keys(self.items[i])[1]).tolist()]
        runs.sort()
        self.runs = np.array([r for r, _ in runs], np.uint64)
        self.run_owner = np.array([k for _, k in runs], np.int32)

    def sharing_a_run(self, ids: np.ndarray, lens: np.ndarray) -> dict[int, set[int]]:
        """For each of the documents that lie one after the other in `ids` the places in `order` of the items of which it holds a
        run of RUN words: of every case at least. Those without any are left out."""
        at, keys = run_keys(ids, np.repeat(np.arange(len(lens)), lens))
        a, b = np.searchsorted(self.runs, keys, "left"), np.searchsorted(self.runs, keys, "right")
        doc = np.searchsorted(np.cumsum(lens), at, "right")
        got: dict[int, set[int]] = defaultdict(set)
        hit = b > a
        for d, x, y in zip(doc[hit].tolist(), a[hit].tolist(), b[hit].tolist()):
            got[d].update(self.run_owner[x:y].tolist())
        return got


def run_keys(ids: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of RUN successive known terms (of one owner) begin, and a number for each; runs alike have the same."""
    n = len(ids) - RUN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    at = np.flatnonzero(known[RUN:] - known[:-RUN] == RUN)
    if owner is not None:
        at = at[owner[at] == owner[at + RUN - 1]]
    key = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64)
    return at, key


def could_hold(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which passages have as many words of the items as any case must have in one."""
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    return known[end] - known[start] >= LEAST_WORDS - LEAST_WORDS // EDIT_SHARE - 1


def windows_of(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of the passages of texts that lie one after the other."""
    many = np.where(lens > 0, -(-np.maximum(1, lens - PASSAGE + STEP) // STEP), 0)
    owner = np.repeat(np.arange(len(lens)), many)
    begin = np.cumsum(lens) - lens
    start = begin[owner] + STEP * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    return owner, start, np.minimum(start + PASSAGE, (begin + lens)[owner])


def term_grid(ids: np.ndarray, start: np.ndarray, end: np.ndarray, n_terms: int) -> np.ndarray:
    """Passages x PASSAGE: the terms of the items in each passage; n_terms stands for any other word."""
    at = start[:, None] + np.arange(PASSAGE)
    t = ids[np.minimum(at, len(ids) - 1)]
    return np.where((at < end[:, None]) & (t >= 0), t, n_terms)


def held_terms(grid: np.ndarray, n_terms: int) -> np.ndarray:
    """Of each passage its different terms once, as passage * (n_terms + 1) + term."""
    key = np.unique(np.arange(len(grid))[:, None] * (n_terms + 1) + grid)
    return key[key % (n_terms + 1) < n_terms]


class Weigher:
    """Unit TF-IDF vectors over the terms of the items (no other term can add to a match), kept as the terms of a
    passage and one factor: a product with a matrix adds up PASSAGE of its rows, however many terms there are."""

    def __init__(self, idf: np.ndarray):
        self.idf = np.append(idf, np.float32(0))

    def factors(self, grid: np.ndarray) -> np.ndarray:
        w = self.idf[grid]
        times = (grid[:, :, None] == grid[:, None, :]).sum(2)
        n = np.sqrt((w * w * times).sum(1))
        return 1 / np.where(n > 0, n, 1)

    def times(self, grid: np.ndarray, m: np.ndarray) -> np.ndarray:
        """A @ m, m having a row for every term."""
        m = np.vstack([m * self.idf[:-1, None], np.zeros((1, m.shape[1]), m.dtype)]).astype(np.float32)
        out = np.empty((len(grid), m.shape[1]), np.float32)
        for k in range(0, len(grid), BLOCK):
            g = grid[k : k + BLOCK]
            out[k : k + BLOCK] = m[g].sum(1) * self.factors(g)[:, None]
        return out

    def back(self, grid: np.ndarray, x: np.ndarray, n_terms: int) -> np.ndarray:
        """A' @ x."""
        s = np.zeros((n_terms, x.shape[1]))
        for k in range(0, len(grid), BLOCK):
            g = grid[k : k + BLOCK]
            v = x[k : k + BLOCK] * self.factors(g)[:, None]
            order = np.argsort(g, axis=None, kind="stable")
            t = g.ravel()[order]
            order = order[: np.searchsorted(t, n_terms)]
            if len(order):
                t = t[: len(order)]
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                s[t[first]] += np.add.reduceat(v[order // PASSAGE], first, axis=0)
        return s * self.idf[:-1, None]


def least_products(grid: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each passage of an item the least product of its TF-IDF vector (of any length) with that of some passage of a
    document, if the document holds a case there; infinite where it can't.

    Any case has SURE_WORDS successive item words, SURE_MISSED of which at most match nothing, whose matches lie within 15
    words of the document: its first 13 if it has two edits or fewer; with three it has 24 words, and either its first or
    its next 12 miss one at most. These lie in one passage, as any 15 words do, and could_hold passes one that has
    them. Each match adds its squared weight to the product at least; the heaviest words are taken to be the missed ones.
    """
    n_terms = len(idf)
    w = np.append(idf.astype(np.float64), 0) ** 2
    least = np.full(len(grid), np.inf)
    for k in range(PASSAGE - SURE_WORDS + 1):
        part = grid[:, k : k + SURE_WORDS]
        masked = (part == n_terms).sum(1)
        heavy = np.sort(w[part], axis=1)[:, ::-1]
        free = np.arange(SURE_MISSED) < SURE_MISSED - masked[:, None]
        held = heavy.sum(1) - (heavy[:, :SURE_MISSED] * free).sum(1)
        least = np.where(masked <= SURE_MISSED, np.minimum(least, held), least)
    return least


def latent_matches(z: np.ndarray, scale: np.ndarray, look: np.ndarray, need: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For passages of documents (their unit vectors in the latent directions, and their factors) and of items (the same,
    and least product times factor): which pairs have that cosine, and which have it or could be of a case.

    The product of two unit vectors is that of their latent parts and that of what the directions leave out of them, which
    comes to the product of the lengths of these rests at most: no case lies below that.
    """
    dot = z @ look.T
    of_z, of_look = np.linalg.norm(z, axis=1), np.linalg.norm(look, axis=1)
    near = dot >= np.maximum(of_z, 1e-9)[:, None] * (cosine * np.maximum(of_look, 1e-9))
    # a little is added for single precision
    rest_z, rest_look = (np.sqrt(np.maximum(0, 1 - x * x) + 1e-5) for x in (of_z, of_look))
    dot += rest_z[:, None] * rest_look
    return near, near | (dot + 1e-4 >= scale[:, None] * need)


def span_of(doc: np.ndarray, item: np.ndarray) -> int:
    """The most successive item words that the doc holds with one edit for every EDIT_SHARE of them at most
    (three edits in all, which any longer case has a part within); 0 if below LEAST_WORDS.

    Common subsequence of bounded edits over the matching word pairs; a span begins and ends with one.
    """
    same = item[:, None] == doc[None, :]
    # any span has RUN matches in a row: one edit leaves 13 of 14 words in two runs, two 14 of 16 in
    # three, three 21 of 24 in four
    run = same[: len(item) - RUN + 1, : len(doc) - RUN + 1]
    for k in range(1, RUN):
        run = run & same[k : len(item) - RUN + 1 + k, k : len(doc) - RUN + 1 + k]
    if len(item) < LEAST_WORDS or len(doc) < RUN or not run.any():
        return 0
    # with three edits in all, the words of a span lie within three places of the diagonal of any of its runs, and
    # of LEAST_WORDS successive ones all but three match: diagonals with fewer matches and words off them can't matter
    near = np.zeros_like(same)
    run_i, run_d = np.nonzero(run)
    rows = np.arange(len(item))[:, None]
    for diagonal in np.unique(run_d - run_i):
        cols = rows + (diagonal + np.arange(-MOST_EDITS, MOST_EDITS + 1))
        hit = (cols >= 0) & (cols < len(doc)) & same[rows, np.clip(cols, 0, len(doc) - 1)]
        upto = np.concatenate([[0], np.cumsum(hit.any(1))])
        if (upto[LEAST_WORDS:] - upto[:-LEAST_WORDS]).max() >= LEAST_WORDS - MOST_EDITS:
            r, c = np.nonzero(hit)
            near[r, cols[r, c]] = True
    at_i, at_d = np.nonzero(near)
    most, steps = MOST_EDITS, sorted((max(g), *g) for g in product(range(4), repeat=2))
    best: dict[tuple[int, int], list[int]] = {}
    found, none = 0, 1 << 30
    for i, d in zip(at_i.tolist(), at_d.tolist()):
        first = [i] + [none] * most
        for cost, gi, gd in steps:
            before = best.get((i - 1 - gi, d - 1 - gd))
            if before:
                for e in range(most + 1 - cost):
                    if before[e] < first[e + cost]:
                        first[e + cost] = before[e]
        best[i, d] = first
        for e in range(most + 1):
            n = i - first[e] + 1
            if n >= LEAST_WORDS and n >= e * EDIT_SHARE and n > found:
                found = n
    return found


def grids(batch: pa.RecordBatch, n_terms: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Terms of the passages of encoded documents that could hold a case, their documents' places, the documents."""
    docs = [np.frombuffer(v.as_buffer(), np.int32) for v in batch.column("ids")]
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    owner, start, end = windows_of(np.array([len(x) for x in docs], np.int64))
    good = could_hold(ids, start, end)
    return term_grid(ids, start[good], end[good], n_terms), owner[good], docs


def common_length(doc: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each of the words."""
    at: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        if w >= 0:
            at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(words)) - 1
    row = full
    for w in doc.tolist():
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(words) - row.bit_count()


def holds_answer(doc: np.ndarray, item: np.ndarray) -> bool:
    """Whether most of the item's closing words, its question and answers, are in the document in order."""
    end = item[-ANSWER_WORDS:]
    return common_length(doc, end) >= ANSWER_SHARE * len(end)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """Documents that hold a passage of an item: doc_id, item_id, span (item words in
    the longest one), answer (whether its closing words are there too), near (whether the latent search found it).

    1. Documents become term numbers (terms of the items; the rest is one unknown term). Passage
       frequencies of the terms are counted over all documents.
    2. A randomised SVD of the TF-IDF passages (of corpus and items) gives `rank` latent directions:
       partitions add up A'(AQ) in blocks of terms; the factorised matrices are terms x rank.
    3. Passages are projected, and each document is a candidate for every item to which one of its
       passages has at least that cosine. No cosine is low enough for every case (14 common words may share
       their passage with rare ones), so it also is one where the projections can't rule a case out
       (latent_matches): only candidates are compared, and no case is lost, whatever the directions. As any
       case has a run of RUN words, documents and candidates without one in common are passed over.
    4. A candidate is kept if a common subsequence has LEAST_WORDS successive item words with one
       edit in EDIT_SHARE (span_of). Wording shared by several items matches nothing. For what is kept the
       closing words are looked for as well (holds_answer): a leak with its answer is the graver one.

    Documents with fewer words of the items than any case needs in one passage aren't carried past step
    1: none can be a case. Items are broadcast (size checked); documents never leave the executors.
    Defined cases: null and empty texts hold nothing; repeated documents each come out; a null doc_id comes
    out as null; null item ids are left out and an item id counts once (any of its texts); empty tables
    give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    out = "doc_id bigint, item_id bigint, span int, answer boolean, near boolean"
    ev = Evaluation([(r[0], r[1]) for r in items.select(item_id, text).toLocalIterator()])
    n_terms = len(ev.terms)
    final = lambda d: d.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "span", "answer", "near").distinct()
    if not n_terms:
        return final(spark.createDataFrame([], out))
    shared = spark.sparkContext.broadcast(ev)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.terms.get
        df = np.zeros(n_terms + 1, np.int64)
        names = ["doc_id", "ids", "df"]
        for b in batches:
            for x in range(0, b.num_rows, 1024):
                part = b.slice(x, 1024)
                found = [np.array([number(w, -1) for w in words(t.as_py())], np.int32) for t in part.column(1)]
                ids = np.concatenate(found)
                owner, start, end = windows_of(np.array([len(f) for f in found], np.int64))
                if not len(owner):
                    continue
                key = held_terms(term_grid(ids, start, end, n_terms), n_terms)
                df[:-1] += np.bincount(key % (n_terms + 1), minlength=n_terms)
                df[-1] += len(owner)
                keep = np.unique(owner[could_hold(ids, start, end)])
                if len(keep):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array([found[k].tobytes() for k in keep], pa.binary()), pa.nulls(len(keep), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], names=names)

    coded = cut(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id bigint, ids binary, df binary"))
    kept = coded.where("ids is not null").select("doc_id", "ids")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        s = None
        for b in batches:
            for v in b.column("df"):
                x = np.frombuffer(v.as_buffer(), np.int64).astype(np.float64)
                s = x if s is None else s + x
        return s

    df = summed(coded.where("df is not null").select("df"), frequencies, n_terms + 1)
    df[:-1] += np.bincount(held_terms(ev.grid, n_terms) % (n_terms + 1), minlength=n_terms)
    df[-1] += len(ev.grid)
    weigher = Weigher(np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32))
    k = min(rank, n_terms)
    wide = min(n_terms, k + OVERSAMPLE)
    q = np.random.default_rng(1).standard_normal((n_terms, wide))

    def gram(q: np.ndarray) -> np.ndarray:
        """A'(AQ) over the passages of corpus and items."""
        held = spark.sparkContext.broadcast(q.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            s = None
            for b in batches:
                grid, _, _ = grids(b, n_terms)
                x = weigher.back(grid, weigher.times(grid, held.value), n_terms)
                s = x if s is None else s + x
            return s

        got = summed(kept.select("ids"), run, n_terms * wide).reshape(n_terms, wide)
        held.unpersist()
        return got + weigher.back(ev.grid, weigher.times(ev.grid, q), n_terms)

    for _ in range(POWER_PASSES + 1):
        q, _r = np.linalg.qr(gram(q))
    # Rayleigh-Ritz: eigenvectors of Q'A'AQ turn Q into right singular vectors
    small = q.T @ gram(q)
    _values, turn = np.linalg.eigh((small + small.T) / 2)
    basis = (q @ turn[:, ::-1][:, :k]).astype(np.float32)
    look = weigher.times(ev.grid, basis)
    need = (least_products(ev.grid, weigher.idf[:-1]) * weigher.factors(ev.grid)).astype(np.float32)
    tools = spark.sparkContext.broadcast((basis, look, need, weigher))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        basis, look, need, weigher = tools.value
        starts = np.flatnonzero(np.r_[True, e.owner[1:] != e.owner[:-1]])
        for b in batches:
            rows: list[tuple] = []
            grid, owner, docs = grids(b, n_terms)
            # a document without a run of RUN words in common with an item can't be a case: it isn't searched for
            runs = e.sharing_a_run(np.concatenate([np.zeros(0, np.int32), *docs]), np.array([len(x) for x in docs], np.int64))
            open_ = np.isin(owner, np.array(list(runs), np.int64))
            grid, owner = grid[open_], owner[open_]
            # of each document the items that are near, and those that are candidates
            found: dict[int, np.ndarray] = {}
            step = min(1024, max(1, PRODUCTS // len(look)))
            for x in range(0, len(grid), step):
                g = grid[x : x + step]
                hit = np.stack([np.logical_or.reduceat(m, starts, axis=1) for m in latent_matches(weigher.times(g, basis), weigher.factors(g), look, need, cosine)], axis=1)
                first = np.flatnonzero(np.r_[True, np.diff(owner[x : x + step]) > 0])
                for d, h in zip(owner[x + first].tolist(), np.logical_or.reduceat(hit, first, axis=0)):
                    found[d] = found[d] | h if d in found else h
            at = {j: k for k, j in enumerate(e.owner[starts].tolist())}
            for d, (near, candidate) in found.items():
                for j in sorted(runs[d]):
                    i = e.order[j]
                    if candidate[at[j]] and (n := span_of(docs[d], e.items[i])):
                        rows.append((b.column("doc_id")[d].as_py(), i, n, holds_answer(docs[d], e.items[i]), bool(near[at[j]])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()))], names=["doc_id", "item_id", "span", "answer", "near"])

    return final(kept.mapInArrow(search, out))


def report(leaks: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """Per item: in how many documents it leaked, in how many with its answer, and the longest span; 0 and null
    where it didn't."""
    per = leaks.groupBy(item_id).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("answer").cast("int")).alias("with_answer"), F.max("span").alias("longest_span"))
    return items.select(item_id).distinct().join(per, item_id, "left").select(item_id, F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("with_answer", F.lit(0)).alias("with_answer"), "longest_span")
