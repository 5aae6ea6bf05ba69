import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from helixframe.llm import leaks, mixing, subjects

rng = random.Random(1)
NAMES = ["".join(rng.choice(["ba", "ko", "ri", "tu", "me", "lo", "sa"]) for _ in range(3)) for _ in range(90)]
INTRO = "Read the passage with care and choose the single best reply without reasons. "
ITEMS = [(n, INTRO * (n < 4) + " ".join(f"{rng.choice(NAMES)} {rng.choice(NAMES)} took {rng.randrange(100, 999)} apples" for _ in range(9)) + ".") for n in range(8)]


def test_words():
    assert leaks.words("A&nbsp;b<b>o</b>ld&semi; wal-\nking Ｆ１２ c\xadaf​é") == ["a", "bold", "walking", "f12", "cafe"]
    assert leaks.words("// one two\n//  three-\n// four") == ["one", "two", "threefour"]
    assert leaks.words('x\\ny <a href="q">z</a><br>w') == ["x", "y", "z", "w"]
    assert leaks.words(None) == leaks.words("") == []


def test_span_of():
    item = np.arange(60)
    assert leaks.span_of(item[10:24], item) == 14
    assert leaks.span_of(item[10:23], item) == 0
    one = np.concatenate([item[10:16], [-1], item[17:24]])
    assert leaks.span_of(one, item) == 14
    two = np.concatenate([item[10:14], [-1], item[15:19], item[20:24]])
    assert leaks.span_of(two, item) == 0
    longer = np.concatenate([item[5:10], [-1], item[11:16], [-1], item[16:22]])
    assert leaks.span_of(longer, item) == 17
    assert leaks.span_of(np.array([], int), item) == 0 and leaks.span_of(np.random.default_rng(1).permutation(item), item) == 0


def test_common_length_and_answer():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        return t[-1][-1]

    r = np.random.default_rng(3)
    for _ in range(40):
        a, b = r.integers(0, 6, r.integers(0, 30)), r.integers(0, 6, r.integers(1, 20))
        assert leaks.common_length(a, b) == plain(a.tolist(), b.tolist())
    item = np.arange(40)
    assert leaks.holds_answer(item[20:], item) and not leaks.holds_answer(item[:24], item)


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    docs = []
    for n in range(120):
        i, t = ITEMS[n % len(ITEMS)]
        w = t.split(" ")
        a = r.randrange(len(w) - 30)
        part = w[a : a + r.choice([9, 14, 20, 30])]
        if n % 5 == 1:
            part[len(part) // 2] = "other"
        if n % 5 == 2:
            r.shuffle(part)
        text = " ".join(part)
        docs.append((n, {0: text, 1: text.upper(), 2: text, 3: text.replace(" ", "&nbsp;"), 4: "-- " + text}[n % 5] + ". And some other words of no interest follow here, as they do."))
    docs += [(500, None), (501, ""), (None, ITEMS[0][1]), (502, ITEMS[1][1]), (503, ITEMS[1][1]), (504, INTRO * 3), (505, "word " * 50_000)]
    ev = leaks.Evaluation(ITEMS)
    want = set()
    for d, t in docs:
        ids = np.array([ev.terms.get(w, -1) for w in leaks.words(t)], np.int64)
        want |= {(d, i) for i, x in ev.items.items() if leaks.span_of(ids, x)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("span", F.lit("x")).repartition(3)
    items = spark.createDataFrame([*ITEMS, (None, "x"), (99, None), (98, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(df, items, "doc_id", "item_id").collect()}
    assert got == want and {(None, 0), (502, 1), (503, 1)} <= got and not any(d == 504 for d, _ in got)
    assert leaks.find_leaks(df.where("false"), items, "doc_id", "item_id").count() == 0
    assert leaks.find_leaks(df, items.where("false"), "doc_id", "item_id").count() == 0
    rep = {x["item_id"]: x["documents"] for x in leaks.report(spark.createDataFrame(list(got), "doc_id long, item_id long").withColumn("span", F.lit(20)).withColumn("answer", F.lit(True)), items.where("item_id is not null"), "item_id").collect()}
    assert rep[99] == 0 and rep[1] == sum(i == 1 for _, i in got)


def shares_of(spark, rows):
    return spark.createDataFrame([(n, t, bytearray(np.array(p, np.float64).tobytes())) for n, (t, p) in enumerate(rows)], "doc_id long, tokens long, share binary")


def test_rates_of_known_sources(spark):
    none = shares_of(spark, [])
    r = mixing.solve(np.array([1000.0, 100.0, 0.0]), none, np.array([0.6, 0.3, 0.1]), np.array([2.0, 3.0, 4.0]))
    t = r.of_known() * [1000, 100, 0]
    assert abs(t[0] / t[1] - 2) < 1e-3 and abs(t[1] - 300) < 1e-2 and r.of_known()[2] == 0
    assert mixing.solve(np.zeros(1), none, np.ones(1), np.ones(1)).of_known().tolist() == [0.0]


def test_rates_with_soft_membership_meet_the_targets(spark):
    """A third of the tokens is of documents that belong to several sources in part; one source has no others."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(5, 60)), rng.dirichlet([1, 2, 0.7, 0.2])) for _ in range(300)]
    known, weights, caps = np.array([9000.0, 6000.0, 0.0]), np.array([0.5, 0.35, 0.15]), np.array([2.0, 3.0, 2.0])
    r = mixing.solve(known, shares_of(spark, rows).repartition(3), weights, caps)
    p, t = np.array([p for _, p in rows]), np.array([t for t, _ in rows])
    each = r.of(p)
    got = r.of_known() * known + (each * t) @ p[:, :3]
    assert np.abs(got / got.sum() - weights).max() < 1e-3 and (each >= 0).all() and each.max() <= 2 and (r.of_known() <= caps).all()
    # the source that only unsure documents hold draws them by their share in it
    assert np.corrcoef(each, p[:, 2])[0, 1] > 0.5


def test_posteriors_are_calibrated(spark):
    """Doubled words make a plain classifier twice too sure; texts that tell nothing give the prior."""
    rng = random.Random(2)
    docs = []
    for n in range(1500):
        s = rng.choices("ab", [3, 1])[0]
        w = rng.choices(["left", "right"], [7, 3] if s == "a" else [3, 7])[0]
        docs.append((n, " ".join(w + x for x in "cdefghij"), s))
    m = spark.createDataFrame([(n, s, len(t), bytearray(mixing.features(t).tobytes())) for n, t, s in docs], "doc_id long, source string, tokens long, words binary")
    c = mixing.train(m, ["a", "b"])
    x = pa.array([mixing.features(" ".join("left" + x for x in "cdefghij")).tobytes()])
    assert c.temperature > 2 and abs(c.posteriors(c.evidence(x))[0, 0] - 0.875) < 0.05


def test_mix(spark):
    r = random.Random(9)
    vocab = {"a": "alpha beta gamma delta", "b": "stock bond yield margin", "z": "other things entirely here"}
    docs = [(n, " ".join(r.choices(vocab[s].split(), k=r.randrange(5, 40))), s) for n, s in enumerate(r.choices(["a", "b", "z"], [6, 1, 2], k=900))]
    docs += [(2000 + k, vocab["b"] * 3, None) for k in range(3)] + [(3000, None, "a"), (3001, "", "b"), (3002, "x", "a"), (3002, "x", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(1)).repartition(3)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 3), ("missing", 0.1, 2)], "source string, weight double, max_repeats int")
    drawn, report = mixing.mix(df, targets)
    rows, rep = drawn.collect(), {x["source"]: x for x in report.collect()}
    cap = {"a": 2, "b": 3}
    assert rows and all(0 < x["uses"] <= (2 if x["source"] is None else cap[x["source"]]) and x["tokens"] > 0 for x in rows)
    assert rep[None]["documents"] == 3 and abs(sum(x["actual"] for x in rep.values()) - 1) < 1e-5
    assert abs(rep["a"]["actual"] - 5 / 9) < 0.01 and abs(rep["b"]["actual"] - 4 / 9) < 0.01
    assert not rep["missing"]["reachable"] and rep["z"]["tokens_drawn"] == 0 and rep["b"]["target"] == 0.4
    again, _ = mixing.mix(df.repartition(5), targets)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows), key=str)
    none, _ = mixing.mix(df.where("false"), targets)
    assert none.count() == 0


def test_sentences_leave_out_code_and_markup():
    t = "<p>First thing. Second one!</p>```\ncode here.\n```\n    indented()\nLast &amp; least<br>more <pre>x = 1</pre> http://a.b/c"
    assert subjects.sentences(t) == [["first", "thing"], ["second", "one"], ["last", "least"], ["more"]]
    assert subjects.sentences(None) == subjects.sentences("") == []


def test_spelling():
    s = subjects.Spelling(["orchestra", "violin"])
    assert [s.fix(w) for w in ("orchesra", "vioiln", "violine", "violxn", "violin", "cat", "something")] == ["orchestra", "violin", "violin", "violin", None, None, None]


def test_subjects_of_a_small_corpus(spark):
    r = random.Random(6)
    terms = {"music": "violin orchestra soprano metronome cadence fretboard".split(), "law": "affidavit subpoena magistrate plaintiff statute probate".split(), "cooking": "risotto marinade lasagne vinaigrette saucepan oregano".split()}
    say = ["Nobody mentions that the {} matters more than the {}", "You can replace the {} with the {} on Tuesday", "My {} was odd and the {} too"]
    docs, truth = [], {}
    for n in range(400):
        s = r.choice(list(terms))
        docs.append((n, " ".join(r.choice(say).format(*r.sample(terms[s], 2)) + "." for _ in range(r.randrange(1, 5))) + r.choice(["", " The rest is history.", "\n```\nviolin = statute\n```"])))
        truth[n] = s
    docs += [(900, None), (901, ""), (902, "The rest is history."), (903, "statute " * 30_000)]
    labels = [(n, f" {truth[n].upper()}", 1) for n in range(0, 400, 4)] + [(4, "law", 2), (8, "nonsense", 3), (None, "law", 1), (7777, "law", 1), (12, None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("q")).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labeller int")
    areas = spark.createDataFrame([(s, "") for s in terms], "subject string, description string")
    got = subjects.document_subjects(df, lab, areas)
    rows = got.collect()
    right = sum(truth.get(x["doc_id"]) == x["subject"] for x in rows)
    assert right >= 390 and right >= 0.97 * len([x for x in rows if x["doc_id"] < 400]) and not any(x["doc_id"] in (900, 901, 902) for x in rows)
    share = {x["subject"]: x["share"] for x in subjects.corpus_shares(df, got, areas).collect()}
    assert set(share) == set(terms) and 0.9 < sum(share.values()) <= 1
    assert subjects.document_subjects(df, lab.where("false"), areas).count() == 0
    assert subjects.document_subjects(df.where("false"), lab, areas).count() == 0


def vocabulary_of(df, named):
    words, dictionary = subjects.read_words(df)
    voc, n_docs = subjects.build_vocabulary(words, dictionary, named, ["law"], [])
    word = {r["h"]: r["word"] for r in dictionary.collect()}
    return dict(zip(voc.names, voc.counts)), {word[h] for h in voc.common.tolist()}, n_docs


def test_every_term_of_three_documents_counts(spark):
    named = spark.createDataFrame([], "doc_id long, subject string")
    letters = [chr(97 + k) for k in range(26)]
    many = [f"q{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:2]]  # 35,152
    common = [f"x{a}{b}" for a in letters[:20] for b in letters[:10]]  # 200
    docs = [(n, " ".join(many)) for n in range(3)] + [(10 + n, " ".join(common)) for n in range(10)] + [(100 + n, "idle") for n in range(50)]
    got, left_out, n_docs = vocabulary_of(spark.createDataFrame(docs, "doc_id long, text string"), named)
    assert n_docs == 63 and left_out == {*common, "idle"}
    assert set(many) <= set(got) and len(got) == 2 * len(many) - 1 and set(got.values()) == {3}
    # the least number of documents doesn't rise with the corpus
    large = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "rare term").otherwise("idle").alias("text"))
    assert vocabulary_of(large, named)[0] == {"rare": 3, "term": 3, "rare term": 3}


def test_encoded_documents(spark):
    texts = ["Violin cadence. Violin!", None, "", "The violni cadence\nstatute probate", "a statuteprobate. probate", "quoted words stand here. violin"]
    voc = subjects.Vocabulary([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    names = ["violin", "cadence", "statute", "probate", "violin cadence", "statute probate"]
    h = [subjects.number_of(w) for w in names]
    rows = [(h[k], 0, 9, names[k]) for k in range(4)] + [(h[0], h[1], 9, names[4]), (h[2], h[3], 9, names[5]), (subjects.number_of("rare"), 0, 2, "rare")]
    numbers = subjects.Numbers()
    item = numbers.of("quoted words stand here")
    voc = subjects.Vocabulary(rows, np.array([subjects.number_of("the")]), np.unique(subjects.pair_key(item[:-2], item[1:-1])))
    spelling, joined = voc.spelling()
    assert spelling.fix("violni") == "violin" and joined == {"violincadence": "violin cadence", "statuteprobate": "statute probate"}
    voc.fixed = np.array(sorted([(subjects.number_of("violni"), h[0], 0), (subjects.number_of("statuteprobate"), h[2], h[3])]), np.int64).T.copy()
    of = [numbers.of(t) for t in texts]
    ids, lens = voc.encode(np.concatenate(of), np.array([len(x) for x in of]))
    got = [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]
    assert got == [[0, 1, 4, -1, 0, -1], [], [], [0, 1, 4, -1, 2, 3, 5, -1], [2, 3, 5, -1, 3, -1], [0, -1]]
    back = subjects.flat(subjects.packed(ids, lens), np.int32)
    assert back[0].tolist() == ids.tolist() and back[1].tolist() == lens.tolist()


def test_leaks_of_common_words_among_rare_ones(spark):
    r = random.Random(8)
    common, rare = NAMES[:14], [f"{a}{b}x" for a in NAMES[14:34] for b in NAMES[34:54]]
    items = [(0, " ".join(common + rare[:14])), (1, " ".join(rare[14:300]))]
    leak = [*common[:6], "other", *common[7:], *rare[200:214]]
    docs = [(0, " ".join(leak))] + [(n, " ".join(r.sample(common, 14) + rare[20:34])) for n in range(1, 200)]
    ev = leaks.Evaluation(items)
    coded = {d: np.array([ev.terms.get(w, -1) for w in leaks.words(t)], np.int32) for d, t in docs}
    want = {(d, i) for d, x in coded.items() for i, y in ev.items.items() if leaks.span_of(x, y)}
    assert (0, 0) in want
    sharing = ev.sharing_a_run(np.concatenate(list(coded.values())), np.array([len(x) for x in coded.values()]))
    assert all({ev.order.index(i) for j, i in want if j == d} <= sharing[k] for k, d in enumerate(coded))
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id")
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want


def test_only_what_the_latent_search_finds_is_compared(spark, monkeypatch):
    """With directions that match nothing there are no rows; with any other ones, however few, every case is among them."""
    r = random.Random(5)
    docs = []
    for n in range(160):
        w = ITEMS[n % len(ITEMS)][1].split(" ")
        a = r.randrange(len(w) - 26)
        part = w[a : a + r.choice([6, 14, 16, 24])]
        for k in range(n % 4):
            part[(2 * k + 3) * len(part) // 9] = "other"
        docs.append((n, " ".join(r.choices(NAMES, k=n % 15) + part + r.choices(NAMES, k=15))))
    ev = leaks.Evaluation(ITEMS)
    coded = {d: np.array([ev.terms.get(w, -1) for w in leaks.words(t)], np.int32) for d, t in docs}
    want = {(d, i) for d, x in coded.items() for i, y in ev.items.items() if leaks.span_of(x, y)}
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = lambda **k: {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(df, items, "doc_id", "item_id", **k).collect()}
    assert len(want) > 40 and rows(rank=2, cosine=2.0) == want == rows(cosine=2.0)
    monkeypatch.setattr(np.linalg, "eigh", lambda m: (np.zeros(len(m)), np.full(m.shape, np.nan)))
    assert rows() == set()


def test_latent_bound_rules_out_no_case():
    """Cases of all kinds of edits keep above the bound for any directions; pairs that only share a run of five don't all."""
    r = np.random.default_rng(6)
    n = 300
    weigher = leaks.Weigher(r.uniform(0.1, 6, n).astype(np.float32))
    basis = np.linalg.qr(r.standard_normal((n, n)))[0].astype(np.float32)
    cases, runs, runs_kept = 0, 0, {0: 0, 20: 0, n: 0}
    for case in range(400):
        item = r.permutation(n)[: r.integers(30, 70)].astype(np.int32)
        item[r.random(len(item)) < 0.02] = -2
        a = r.integers(0, len(item) - 26)
        words = r.choice([5, 14, 16, 24, 26])
        part = item[a : a + words].tolist()
        for _ in range(r.integers(0, 4) if words > 5 else 0):
            k = r.integers(1, len(part) - 1)
            part[k : k + r.integers(0, 2)] = [-1] * r.integers(0, 2)
        doc = np.concatenate([r.integers(-1, n, r.integers(0, 40)), part, r.integers(-1, n, r.integers(0, 40))]).astype(np.int32)
        _, start, end = leaks.windows_of(np.array([len(item)]))
        look = leaks.term_grid(item, start, end, n)
        _, start, end = leaks.windows_of(np.array([len(doc)]))
        good = leaks.could_hold(doc, start, end)
        grid = leaks.term_grid(doc, start[good], end[good], n)
        need = leaks.least_products(look, weigher.idf[:-1]) * weigher.factors(look)
        true = leaks.span_of(doc, item) > 0
        cases, runs = cases + true, runs + (words == 5 and not true)
        for k in runs_kept:
            _, could = leaks.latent_matches(weigher.times(grid, basis[:, :k]), weigher.factors(grid), weigher.times(look, basis[:, :k]), need, 2.0)
            assert could.any() or not true
            runs_kept[k] += words == 5 and not true and could.any()
    assert cases > 200 and runs > 50 and runs_kept[n] < 0.75 * runs, (cases, runs, runs_kept)


def test_passes_over_the_documents(spark, monkeypatch):
    """Passes go on until the topics hardly change; each is one sum over all documents, besides those of the labels."""
    calls = []
    summed = subjects.summed
    monkeypatch.setattr(subjects, "summed", lambda *a: calls.append(1) or summed(*a))
    docs = spark.createDataFrame([(n, "violin cadence soprano.") for n in range(5)] + [(n, "statute probate plaintiff.") for n in range(5, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, "music") for n in range(5)], "doc_id long, subject string")
    model, _ = subjects.fit(docs, labels, ["law", "music"])
    assert len(calls) == model.passes + 2 and model.passes >= subjects.LEAST_PASSES and model.change < subjects.TOLERANCE


def test_passes_leave_nothing_on_the_driver(spark, monkeypatch):
    """What a pass broadcasts is gone from the driver too when it ends, and subjects are still told after that."""
    made = []
    broadcast = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(broadcast(self, value)) or made[-1])
    docs = spark.createDataFrame([(n, "violin cadence soprano.") for n in range(30)] + [(n, "statute probate plaintiff.") for n in range(30, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, "music" if n < 30 else "law") for n in range(0, 60, 3)], "doc_id long, subject string")
    model, coded = subjects.fit(docs, labels, ["law", "music"])
    assert len(made) == model.passes + 2 and not any(os.path.exists(b._path) or b._jbroadcast.isValid() for b in made)
    assert {(x["doc_id"], x["subject"]) for x in subjects.assign(model, coded).collect()} == {(n, "music" if n < 30 else "law") for n in range(60)}


def test_inference_against_one_document_at_a_time():
    rng = np.random.default_rng(3)
    topics = rng.dirichlet(np.ones(50), 4).T.astype(np.float32)
    alpha = np.full(4, 0.1, np.float32)
    lens = [0, 3, 700, 1, 40, 0, 9000]
    doc = np.repeat(np.arange(len(lens)), lens)
    term = rng.integers(0, 50, len(doc))
    gamma, weight = subjects.infer(term, doc, len(lens), topics, alpha)
    for d in range(len(lens)):
        b, g = topics[term[doc == d]], alpha
        for i in range(subjects.INNER):
            s = b @ g
            if i < subjects.INNER - 1:
                g = alpha + g * ((1 / s) @ b)
        assert np.allclose(gamma[d], g, rtol=1e-3) and np.allclose(weight[doc == d], 1 / s, rtol=1e-3)
