"""Subject areas of documents by latent Dirichlet topics."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm.partial_sums import summed
from helixframe.session import cut

LEAST_DOCS = 3
PER_SUBJECT, BACKGROUND = 3, 12
LEAST_PASSES, MOST_PASSES, TOLERANCE, INNER = 12, 60, 0.03, 6
ALPHA, ALPHA_BACKGROUND, BETA = 0.05, 0.5, 0.01
TOP_TERMS, MAPPED, LEAST_TOLD = 25, 0.5, 0.03
SENTENCE_MASS, DOC_SHARE = 0.5, 1 / 3
LABELLED, LABEL_SHARE = 5, 0.4
QUOTED_WORDS, QUOTED_SHARE = 4, 0.5
COMMON_SHARE = 12

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_PRE = re.compile(r"<(pre|code)\b.*?(?:</\1>|\Z)", re.S | re.I)
_INDENTED = re.compile(r"^(?: {4}|\t)\S.*$", re.M)
_LINK = re.compile(r"https?://\S+")
_BLOCK = re.compile(r"</?(?:p|br|div|li|ul|ol|h\d|pre|blockquote|tr|td|table)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
# a word, or what ends a sentence
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*|[.!?][\"')\]]*(?=\s)|[\r\n]")
_HIDDEN = str.maketrans({0xAD: None, 0x200B: None, 0x2060: None, 0xA0: " "})
END, SKIP = 0, 1


def tokens(text: str | None) -> list[str]:
    """Words and sentence ends of the prose of a text: code blocks, links and markup are no prose."""
    if not text:
        return []
    t = text
    if "```" in t:
        t = _FENCE.sub("\n", t)
    if "<" in t:
        t = _PRE.sub("\n", t)
    if "    " in t or "\t" in t:
        t = _INDENTED.sub("\n", t)
    if "://" in t:
        t = _LINK.sub("\n", t)
    if "<" in t:
        t = _TAG.sub("", _BLOCK.sub("\n", t))
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = t.translate(_HIDDEN)
    return _TOKEN.findall(t.lower())


def number_of(word: str) -> int:
    """A word's number, the same in every process; two of 2^62 words sharing one are not to be expected."""
    return (xxhash.xxh64_intdigest(word) >> 1) | 2


class Numbers(dict):
    """Numbers of tokens: END for a sentence end, SKIP for single letters."""

    def __missing__(self, token: str) -> int:
        n = END if token[0] in ".!?\r\n" else SKIP if len(token) < 2 else number_of(token)
        self[token] = n
        return n

    def of(self, text: str | None) -> np.ndarray:
        """Words of a text, with END after each sentence and the text."""
        a = np.array([self[w] for w in tokens(text)] + [END], np.int64)
        return a[a != SKIP]


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence of a text."""
    out: list[list[str]] = [[]]
    for w in tokens(text):
        if w[0] in ".!?\r\n":
            out.append([])
        elif len(w) > 1:
            out[-1].append(w)
    return [s for s in out if s]


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for two neighbouring words."""
    with np.errstate(over="ignore"):
        return (a * np.int64(-7046029254386353131)) ^ ((b >> np.int64(7)) + b * np.int64(2862933555777941757))


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of byte strings as one array, and how many each row has."""
    raw, size = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1], np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, kind, (int(raw[-1]) - int(raw[0])) // size, int(raw[0])) if data is not None and len(raw) and raw[-1] > raw[0] else np.zeros(0, kind)
    return values, np.diff(raw) // size


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The reverse of flat."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


class Spelling:
    """Known words at one slip (a letter too much, too few, wrong, or two swapped), by deletions."""

    def __init__(self, words: list[str]):
        self.known = set(words)
        self.near: dict[str, str] = {}
        for w in reversed(words):  # the more frequent word wins
            for k in range(len(w)):
                self.near[w[:k] + w[k + 1 :]] = w
            self.near[w] = w

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def fix(self, word: str) -> str | None:
        if word in self.known or len(word) < 5:
            return None
        if word in self.near:
            return self.near[word]
        return next((self.near[x] for k in range(len(word)) if (x := word[:k] + word[k + 1 :]) in self.near), None)


def read_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as word numbers (doc_id, words), read once, and the dictionary: h (number), word and n, the
    documents that hold it; all documents are counted under the number END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "words", "h", "word", "n"]
        numbers = Numbers()
        for b in batches:
            if len(numbers) > 1 << 20:
                numbers = Numbers()
            found = [numbers.of(t) for t in b.column("text").to_pylist()]
            rows = len(found)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), packed(np.concatenate(found), np.array([len(x) for x in found])), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())], names=names)
                df: Counter = Counter()
                for x in found:
                    df.update(set(x.tolist()))
                df[END] = rows
                word = {n: w for w, n in numbers.items() if n > SKIP}
                yield pa.RecordBatch.from_arrays([pa.nulls(len(df), pa.int64()), pa.nulls(len(df), pa.binary()), pa.array(df.keys(), pa.int64()), pa.array([word.get(n, "") for n in df], pa.string()), pa.array(df.values(), pa.int64())], names=names)

    read = cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, words binary, h bigint, word string, n bigint"))
    counted = read.where("h is not null").groupBy("h").agg(F.min("word").alias("word"), F.sum("n").cast("bigint").alias("n"))
    return read.where("words is not null").select("doc_id", "words"), cut(counted)


def telling_words(words: DataFrame, named: DataFrame, often: np.ndarray, subjects: list[str]) -> np.ndarray:
    """Of some frequent words (sorted numbers) those whose labelled documents mostly have one subject."""
    marked = words.join(named, "doc_id").select("words", F.array_position(F.array(*map(F.lit, subjects)), F.col("subject")).cast("int").alias("s"))
    n_s, n_w = len(subjects), len(often)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        m = None
        for b in batches:
            m = np.zeros((n_w + 1, n_s)) if m is None else m
            w, lens = flat(b.column("words"), np.int64)
            s = np.array(b.column("s").to_pylist(), np.int64) - 1
            doc = np.repeat(np.arange(len(lens)), lens)
            held = within(w, often)
            pairs = np.unique(doc[held] * n_w + np.searchsorted(often, w[held]))
            np.add.at(m, (pairs % n_w, s[pairs // n_w]), 1)
            np.add.at(m, (n_w, s), 1)
        return m

    if not n_w or not n_s:
        return often[:0]
    m = summed(marked, run, (n_w + 1) * n_s).reshape(n_w + 1, n_s)
    seen, prior = m[:n_w], m[n_w] / max(m[n_w].sum(), 1)
    count = seen.sum(1)
    return often[(count >= LABELLED) & (seen / np.maximum(count, 1)[:, None] >= np.maximum(LABEL_SHARE, 1.5 * prior)).any(1)]


def terms_in(words: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words stand that aren't common, and where pairs of such words in one sentence begin."""
    plain = (words != END) & ~within(words, common)
    return np.flatnonzero(plain), np.flatnonzero(plain[:-1] & plain[1:])


def count_terms(words: DataFrame, common: np.ndarray) -> DataFrame:
    """a, b (0 for a single word) and n: how many documents hold a term, for all that LEAST_DOCS of them hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, lens = flat(batch.column("words"), np.int64)
            doc = np.repeat(np.arange(len(lens), dtype=np.int64), lens)
            one, two = terms_in(w, common)
            at = np.concatenate([one, two])
            key = np.concatenate([w[one], pair_key(w[two], w[two + 1])])
            with np.errstate(over="ignore"):
                _, once = np.unique(key + doc[at] * np.int64(-7723592293110705685), return_index=True)
            _, first, n = np.unique(key[once], return_index=True, return_counts=True)
            k = once[first]
            b = np.where(k < len(one), 0, w[np.minimum(at[k] + 1, len(w) - 1)]) if len(k) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w[at[k]]), pa.array(b), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    return words.select("words").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").cast("bigint").alias("n")).where(F.col("n") >= LEAST_DOCS)


class Vocabulary:
    """Terms by falling document count, the common words left out of them, how other words are to be read, and
    the word pairs of evaluation items: a sentence made of them is a quotation and has no terms."""

    def __init__(self, terms: list[tuple[int, int, int, str]], common: np.ndarray, quoted: np.ndarray):
        self.names, self.counts = [t[3] for t in terms], np.array([t[2] for t in terms], np.float64)
        self.common, self.quoted = common, quoted
        a, b = (np.array([t[k] for t in terms], np.int64) for k in (0, 1))
        key = np.where(b == 0, a, pair_key(a, b))
        self.place = np.argsort(key).astype(np.int32)
        self.keys = key[self.place]
        self.fixed = np.zeros((3, 0), np.int64)

    def spelling(self) -> tuple[Spelling, dict[str, str]]:
        """Of frequent terms: the words at one slip, and the pairs written as one word."""
        least = 4 * self.counts[-1] if len(self.counts) else 0
        often = [t for t, n in zip(self.names, self.counts) if len(t) >= 6 and n >= least]
        return Spelling([t for t in often if " " not in t and "-" not in t]), {t.replace(" ", ""): t for t in often if " " in t}

    def look_up(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(key), -1, np.int32)
        p = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[p] == key, self.place[p], -1)

    def encode(self, w: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of documents given as word numbers: -1 after each sentence; and how many values each has."""
        doc = np.repeat(np.arange(len(lens)), lens)
        ends = w == END
        sentence = np.cumsum(ends) - ends
        n = int(ends.sum())
        pair = ~ends[:-1] & ~ends[1:]
        q = within(pair_key(w[:-1], w[1:]), self.quoted) & pair
        many = np.bincount(sentence[~ends], minlength=n)
        drop = (many >= QUOTED_WORDS) & (np.bincount(sentence[:-1][q], minlength=n) >= QUOTED_SHARE * (many - 1)) if len(self.quoted) else np.zeros(n, bool)
        owner = doc[ends]
        if self.fixed.shape[1]:
            p = np.minimum(np.searchsorted(self.fixed[0], w), self.fixed.shape[1] - 1)
            hit = self.fixed[0][p] == w
            twice = hit & (self.fixed[2][p] != 0)
            x = np.repeat(np.where(hit, self.fixed[1][p], w), 1 + twice)
            x[np.cumsum(1 + twice)[twice] - 1] = self.fixed[2][p[twice]]
            w = x
            sentence = np.cumsum(w == END) - (w == END)
        one, two = terms_in(w, self.common)
        t = np.concatenate([self.look_up(w[one]), self.look_up(pair_key(w[two], w[two + 1]))])
        s = np.concatenate([sentence[one], sentence[two]])
        good = (t >= 0) & ~drop[s]
        t, s = t[good], s[good]
        order = np.argsort(s, kind="stable")
        per = np.bincount(s, minlength=n)
        kept = per > 0
        out = np.full(len(t) + int(kept.sum()), -1, np.int32)
        out[np.arange(len(t)) + (np.cumsum(kept) - 1)[s[order]]] = t[order]
        return out, np.bincount(owner, weights=per + kept, minlength=len(lens)).astype(np.int64)


def build_vocabulary(words: DataFrame, dictionary: DataFrame, named: DataFrame, subjects: list[str], evaluation: list[str | None]) -> tuple[Vocabulary, int]:
    """The vocabulary over all documents, and how many there are."""
    n_docs = sum(r["n"] for r in dictionary.where(F.col("h") == END).collect())  # one row
    real = dictionary.where(F.col("h") > SKIP)
    # words in more than a twelfth of all documents carry no subject, unless labels show that they do; there are
    # twelve times as many as a document has different words on average, at most
    often = np.array(sorted(r["h"] for r in real.where(F.col("n") * COMMON_SHARE > n_docs).select("h").collect()), np.int64)
    common = often[~within(often, telling_words(words, named, often, subjects))]
    counted = cut(count_terms(words, common))
    a, b = (dictionary.select(F.col("h").alias(k), F.col("word").alias(f"word_{k}")) for k in "ab")
    name = F.concat_ws(" ", "word_a", "word_b")
    rows = counted.join(a, "a").join(b.where(F.col("b") > SKIP), "b", "left").select("a", "b", "n", name.alias("name")).orderBy(F.desc("n"), "name").collect()
    numbers = Numbers()
    own = [numbers.of(t) for t in evaluation]
    pairs = [pair_key(x[:-1], x[1:])[(x[:-1] != END) & (x[1:] != END)] for x in own]
    voc = Vocabulary([tuple(r) for r in rows], common, np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64))
    # words outside the vocabulary are looked at once each, where they lie; what comes back is known words misspelt
    known = np.sort(np.concatenate([common, np.array([r["a"] for r in rows if r["b"] == 0], np.int64)]))
    held = words.sparkSession.sparkContext.broadcast((voc.spelling(), known))

    def fixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (spelling, joined), known = held.value
        for x in batches:
            h = np.asarray(x.column("h"))
            rows: list[tuple[int, int, int]] = []
            for k in np.flatnonzero(~within(h, known)).tolist():
                word = x.column("word")[k].as_py()
                if to := joined.get(word) or spelling.fix(word):
                    first, _, second = to.partition(" ")
                    rows.append((int(h[k]), number_of(first), number_of(second) if second else 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["h", "x", "y"])

    found = sorted(tuple(r) for r in real.select("h", "word").mapInArrow(fixes, "h bigint, x bigint, y bigint").collect())
    held.destroy()
    voc.fixed = np.array(found, np.int64).reshape(-1, 3).T.copy()
    return voc, n_docs


def tidy(subject: Column) -> Column:
    """A label as its subject is written: lower case, letters and inner spaces only."""
    return F.trim(F.regexp_replace(F.lower(subject), r"[^\p{L} ]+", ""))


def bag(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Terms, their documents and their sentences of encoded documents, and how many sentences there are."""
    v, lens = flat(ids, np.int32)
    is_term = v >= 0
    sentence = np.cumsum(~is_term) - ~is_term
    return v[is_term], np.repeat(np.arange(len(lens)), lens)[is_term], sentence[is_term], int((~is_term).sum())


def infer(term: np.ndarray, doc: np.ndarray, n_docs: int, topics: np.ndarray, alpha: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """Topic proportions of documents (not scaled to one) and for each term 1 / (its topics x the proportions):
    zero-order variational inference, for documents of like length together."""
    lens = np.bincount(doc, minlength=n_docs)
    starts = np.cumsum(lens) - lens
    order = np.argsort(lens, kind="stable")
    order = order[lens[order] > 0]
    gamma = np.tile(alpha, (n_docs, 1))
    weight = np.zeros(len(term), np.float32)
    at = 0
    while at < len(order):
        group = order[at : at + max(1, 8192 // int(lens[order[at]]))]
        group = group[lens[group] <= 2 * lens[group[0]]]
        at += len(group)
        span = np.arange(lens[group[-1]])
        real = span < lens[group][:, None]
        pos = np.where(real, starts[group][:, None] + span, 0)
        b, g = topics[term[pos]], gamma[group]
        for i in range(inner):
            w = np.where(real, 1 / np.matmul(b, g[:, :, None])[:, :, 0], 0).astype(np.float32)
            if i < inner - 1:
                g = alpha + g * np.matmul(w[:, None, :], b)[:, 0]
        gamma[group] = g
        weight[pos[real]] = w[real]
    return gamma, weight


class Model:
    """Fitted topics (terms x topics), their priors, and the subject that each topic is mapped to, with its top terms."""

    def __init__(self, vocabulary: Vocabulary, subjects: list[str], topics: np.ndarray, alpha: np.ndarray, mapped: list[tuple[str | None, list[str]]], passes: int, change: float):
        self.vocabulary, self.subjects, self.topics, self.alpha, self.mapped = vocabulary, subjects, topics, alpha, mapped
        self.passes, self.change = passes, change


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str], evaluation: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """Topics of all documents, each mapped to a subject or to none, and the encoded documents.

    Topics start from the terms of labelled documents and of the whole corpus and are then fitted to all
    documents by variational passes; a pass adds up terms x topics values. There are LEAST_PASSES at least, and
    more until the topics change by less than TOLERANCE (sum of absolute changes, mean over topics). A topic is
    mapped by its top terms: to the subject that they mostly have among labelled documents, if that is clear.
    """
    spark = docs.sparkSession
    named = labels.select(F.col("doc_id"), tidy(F.col("subject")).alias("subject")).where(F.col("subject").isin(subjects)).distinct()
    # the evaluation set is fixed and small
    items = [r[0] for r in evaluation.select("text").toLocalIterator()] if evaluation is not None else []
    words, dictionary = read_words(docs)
    voc, _ = build_vocabulary(words, dictionary, named, subjects, items)
    v, n_s = len(voc.names), len(subjects)
    shared = spark.sparkContext.broadcast(voc)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), packed(*shared.value.encode(*flat(b.column("words"), np.int64)))], names=["doc_id", "ids"])

    coded = cut(words.mapInArrow(encode, "doc_id bigint, ids binary"))
    shared.destroy()
    k = PER_SUBJECT * n_s + BACKGROUND
    alpha = np.full(k, ALPHA, np.float32)
    alpha[PER_SUBJECT * n_s :] = ALPHA_BACKGROUND
    if not v:
        return Model(voc, subjects, np.zeros((0, k), np.float32), alpha, [(None, [])] * k, 0, 0.0), coded
    marked = coded.join(named, "doc_id").select("ids", F.array_position(F.array(*map(F.lit, subjects)), F.col("subject")).cast("int").alias("s"))

    def by_label(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        m = None
        for b in batches:
            m = np.zeros(v * n_s) if m is None else m
            term, doc, _, _ = bag(b.column("ids"))
            s = np.array(b.column("s").to_pylist(), np.int64) - 1
            pairs = np.unique(doc.astype(np.int64) * v + term)
            m += np.bincount(pairs % v * n_s + s[pairs // v], minlength=v * n_s)
        return m

    seen = summed(marked, by_label, v * n_s).reshape(v, n_s)
    total = voc.counts
    rng = np.random.default_rng(5)
    told = seen.sum(1)
    share = seen / np.maximum(told, 1)[:, None]
    prior = seen.sum(0) / max(seen.sum(), 1)
    # share of the subjects in the labelled documents of a term, drawn towards the overall one
    held_by = (seen + 2 * prior) / (told + 2)[:, None]
    telling = (told >= 3) & (held_by.max(1) >= 0.5)
    # what labels show to lie in all subjects alike: figures of speech, stock phrases
    alike = (told >= LABELLED) & (held_by < np.maximum(LABEL_SHARE, 1.5 * prior)).all(1)
    lift = (seen + prior) / (told + 1)[:, None] / np.maximum(prior, 1e-6)
    background = np.arange(k) >= PER_SUBJECT * n_s
    topics = np.empty((v, k))
    for j in range(k):
        noise = rng.gamma(2.0, 0.5, v)
        s = j // PER_SUBJECT
        topics[:, j] = noise * ((seen[:, s] * lift[:, s] + 0.01) if s < n_s else total * np.where(telling, 0.02, 1)) + BETA
    topics /= topics.sum(0)

    def passed(topics: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(topics.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            m = None
            for b in batches:
                term, doc, _, _ = bag(b.column("ids"))
                if not len(term):
                    continue
                m = np.zeros((v, k)) if m is None else m
                gamma, weight = infer(term, doc, b.num_rows, held.value, alpha)
                # sorted by term in parts, as this copies the proportions of the document of every term
                for x in range(0, len(term), 1 << 17):
                    part = slice(x, x + (1 << 17))
                    order = np.argsort(term[part], kind="stable")
                    t = term[part][order]
                    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                    x = gamma[doc[part][order]]
                    x *= weight[part][order][:, None]
                    m[t[first]] += np.add.reduceat(x, first, axis=0)
            return None if m is None else m.astype(np.float32)

        got = summed(coded.select("ids"), run, v * k).reshape(v, k)
        # unpersist would leave the driver its copy of each pass
        held.destroy()
        got *= topics
        return got

    # in place where it can be: the driver holds few terms x topics matrices at a time
    mass, passes, change = None, 0, np.inf
    while passes < LEAST_PASSES or (change >= TOLERANCE and passes < MOST_PASSES):
        mass = None
        mass = passed(topics)
        mass += BETA
        # what labels show to tell a subject is kept out of the background, else whole languages end there; what
        # they show to tell none is kept out of the subjects
        size = mass.sum(0)
        mass[np.ix_(telling, background)] *= 1e-3
        mass[np.ix_(alike, ~background)] *= 1e-3
        new = mass / size
        topics -= new
        change = float(np.abs(topics, out=topics).sum(0).mean())
        topics, passes = new, passes + 1
    mapped = map_topics(topics, mass, voc.names, share, telling, subjects)
    return Model(voc, subjects, topics.astype(np.float32), alpha, mapped, passes, change), coded


def map_topics(topics: np.ndarray, mass: np.ndarray, names: list[str], share: np.ndarray, telling: np.ndarray, subjects: list[str]) -> list[tuple[str | None, list[str]]]:
    """The subject of each topic, or none, and its top terms: those frequent in it and rare in others. Of the
    top terms that tell a subject, most of the weight must tell the same one."""
    own = mass / mass.sum(1, keepdims=True)
    tell = np.flatnonzero(telling)
    out: list[tuple[str | None, list[str]]] = []
    for j in range(topics.shape[1]):
        rank = topics[:, j] * own[:, j]
        top = tell[np.argsort(-rank[tell], kind="stable")[:TOP_TERMS]]
        votes = (share[top] * topics[top, j, None]).sum(0)
        s = int(votes.argmax()) if votes.sum() > LEAST_TOLD else -1
        out.append((subjects[s] if s >= 0 and votes[s] >= MAPPED * votes.sum() else None, [names[t] for t in np.argsort(-rank, kind="stable")[:TOP_TERMS]]))
    return out


def assign(model: Model, coded: DataFrame) -> DataFrame:
    """doc_id, subject, sentences (about it), of_sentences (about any), subjects_of (its rows), proportion (of the
    document's mapped topics): the subjects that at least DOC_SHARE of a document's sentences about any subject are about.

    The topic proportions of a document are inferred; by them each of its terms is shared out among the topics, and the
    shares of a sentence's terms add up to the sentence's. It is about the subject whose topics hold the most
    of it, if that comes to half a term.
    """
    subjects = model.subjects
    fold = np.zeros((len(model.mapped), len(subjects)), np.float32)
    for j, (s, _) in enumerate(model.mapped):
        if s is not None:
            fold[j, subjects.index(s)] = 1
    held = coded.sparkSession.sparkContext.broadcast((model.topics, model.alpha, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, alpha, fold = held.value
        for b in batches:
            term, doc, sentence, n = bag(b.column("ids"))
            if not len(term) or not len(subjects):
                continue
            gamma, weight = infer(term, doc, b.num_rows, topics, alpha)
            at_sentence = np.concatenate([[0], np.flatnonzero(np.diff(sentence)) + 1])
            held_by = np.concatenate([np.add.reduceat((topics[term[x:y]] * gamma[doc[x:y]] * weight[x:y, None]) @ fold, at_sentence[(at_sentence >= x) & (at_sentence < y)] - x, axis=0) for x, y in parts(at_sentence, len(term))])
            best, owner = held_by.argmax(1), doc[at_sentence]
            about = held_by.max(1) >= SENTENCE_MASS
            per = np.zeros((b.num_rows, len(subjects)), np.int64)
            np.add.at(per, (owner[about], best[about]), 1)
            of = per.sum(1)
            enough = (per > 0) & (per >= (DOC_SHARE * of - 1e-9)[:, None])
            d, s = np.nonzero(enough)
            mapped = (gamma - alpha) @ fold
            share = mapped[d, s] / np.maximum(mapped.sum(1), 1e-9)[d]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(d)), pa.array([subjects[x] for x in s], pa.string()), *(pa.array(x.astype(np.int32)) for x in (per[d, s], of[d], enough.sum(1)[d])), pa.array(share.astype(np.float64))],
                names=["doc_id", "subject", "sentences", "of_sentences", "subjects_of", "proportion"],
            )

    return coded.mapInArrow(run, "doc_id bigint, subject string, sentences int, of_sentences int, subjects_of int, proportion double")


def parts(starts: np.ndarray, end: int, size: int = 1 << 17) -> list[tuple[int, int]]:
    """Stretches of about `size` terms that begin with a sentence."""
    cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, end, size), "right") - 1])
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), end]))


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, evaluation: DataFrame | None = None) -> DataFrame:
    """Subjects of each document: see fit and assign.

    docs has doc_id and text, labels doc_id and subject, areas subject (a fixed small list); sentences quoted
    from the texts of `evaluation` are about nothing.
    Defined cases: null and empty texts, and texts without a sentence about an area, have no row; repeated
    documents each come out; labels with an unknown subject or document are left out, doubled ones
    count once; without labels no topic is mapped and there are no rows; other columns are ignored.
    """
    subjects = sorted({r[0] for r in areas.select("subject").where("subject is not null").distinct().collect()})
    model, coded = fit(docs, labels, subjects, evaluation)
    return assign(model, coded)


def corpus_shares(docs: DataFrame, assigned: DataFrame, areas: DataFrame) -> DataFrame:
    """Each area's documents and share of all documents; one with several areas counts in parts."""
    # rows of a document come from one task, next to each other: `subjects_of` is how many it has
    weighted = assigned.withColumn("k", F.col("subjects_of")).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum(1 / F.col("k")).alias("w"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    out = areas.select("subject").distinct().join(weighted, "subject", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")  # one row
    return out.select("subject", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce(F.col("w") / F.col("n"), F.lit(0.0)), 6).alias("share"))
