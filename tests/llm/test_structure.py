import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import packing, percentiles, pieces, top_n


def unpack(p, hist):
    """(chunk -> sizes) of a plan, checking that slots cover every item once."""
    bins, covered = defaultdict(list), defaultdict(list)
    for size, first, count, base, per in p.slots:
        covered[size].append((first, count))
        for k in range(count):
            bins[base + k // per].append(size)
    for s, n in hist.items():
        at = 0
        for first, count in sorted(covered[s]):
            assert first == at
            at += count
        assert at == n
    return bins


def best_fit_decreasing(hist, c):
    free = []
    for s in sorted(hist, reverse=True):
        for _ in range(hist[s]):
            fits = [(f, i) for i, f in enumerate(free) if f >= s]
            if fits:
                free[min(fits)[1]] -= s
            else:
                free.append(c - s)
    return len(free)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_valid_and_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    c = rng.choice([10, 50, 100])
    hist = Counter(min(c, max(1, int(rng.expovariate(3 / c)) if seed % 2 else rng.randrange(1, c + 1))) for _ in range(rng.choice([1, 7, 60, 300])))
    p = packing.plan(hist, c)
    bins = unpack(p, hist)
    assert len(bins) == p.chunks and all(sum(b) <= c for b in bins.values())
    assert p.chunks <= best_fit_decreasing(hist, c) and p.chunks >= math.ceil(sum(s * n for s, n in hist.items()) / c)


def test_reduction_fixes_dominating_sets():
    p = packing.Plan({9: 2, 7: 1, 3: 3, 2: 1}, 10)
    p.reduce()
    # 9 alone, as nothing fits beside it; 7 with 3, which fill the chunk
    assert p.fixed >= 3 and 9 not in p.live and 7 not in p.live


def test_plan_does_not_grow_with_the_items():
    p = packing.plan({40000: 10**9, 23000: 10**9, 11000: 10**9}, 64000)
    assert len(p.slots) < 10 and p.chunks == 1_200_000_000
    # as many chunks for thousand times the items, and never more slots
    rng = random.Random(3)
    hist = {s: rng.randrange(1, 9) for s in range(120, 1000, 7)}
    one, many = packing.plan(hist, 1000), packing.plan({s: n * 1000 for s, n in hist.items()}, 1000)
    assert len(many.slots) <= 3 * len(hist) and many.chunks <= one.chunks * 1000


@pytest.mark.parametrize("seed", range(6))
def test_sets_fixed_many_times_at_once_are_those_fixed_one_by_one(seed, monkeypatch):
    rng = random.Random(seed)
    hist = Counter(rng.randrange(15, 100) for _ in range(200))
    at_once = packing.Plan(hist, 100)
    at_once.reduce()
    once = packing.Plan.fix
    monkeypatch.setattr(packing.Plan, "fix", lambda self, j, partners, times: once(self, j, partners, 1))
    singly = packing.Plan(hist, 100)
    singly.reduce()
    assert at_once.left == singly.left and at_once.chunks == singly.chunks


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, f"c{i % 900}", rng.choice([1, 5, 333, rng.randrange(1, 1000)]), "x") for i in range(900)]
    sizes = {r[1]: r[2] for r in rows}
    rows += [(2000, "c1", sizes["c1"], "x"), (2001, "big", 2500, "y"), (2002, "exact", 2000, "y"), (2003, "none", None, "y"), (2004, "zero", 0, "y"), (2005, None, 10, "y"), (2006, None, 10, "y")]
    df = spark.createDataFrame(rows, "id long, name string, size long, chunk string").repartition(3)
    got = packing.pack(df, "name", F.col("size"), "id", 1000).collect()
    bins = defaultdict(int)
    for r in got:
        if r["chunk"] is not None:
            bins[r["chunk"]] += r["part_size"]
    assert max(bins.values()) <= 1000 and set(bins) == set(range(len(bins)))
    by = defaultdict(list)
    for r in got:
        by[r["item"]].append((r["part"], r["n_parts"], r["part_size"]))
    assert sorted(by["big"]) == [(1, 3, 1000), (2, 3, 1000), (3, 3, 500)] and sorted(by["exact"]) == [(1, 2, 1000), (2, 2, 1000)]
    assert all(len(v) == 1 for k, v in by.items() if k not in ("big", "exact", None)) and len(by[None]) == 2 and len(by) == 905
    assert [r["chunk"] for r in got if r["item"] == "none"] == [None] and [r["chunk"] for r in got if r["item"] == "zero"] == [0]
    assert packing.pack(df.where("false"), "name", F.col("size"), "id", 1000).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "name", F.col("size"), "id", 1 << 40)


def test_percentiles_keep_their_bound_and_merge(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), d, rng.choice([0.0, rng.gauss(0, 50), -rng.paretovariate(1) * 1e4, 7.0])) for d in range(4) for _ in range(700)] + [("n", 0, None), ("n", 0, float("nan")), ("n", 0, float("inf"))]
    df = spark.createDataFrame(rows, "k string, day int, v double").withColumn("n", F.lit(1))
    ask = [1, 50, 500, 950, 990, 1000]
    s = percentiles.sketch(df, ["k", "day"], F.col("v"))
    for part, keys in ((s, ["k", "day"]), (percentiles.combine(s.where("day < 3"), ["k"]), ["k"])):
        got = percentiles.percentiles(part, keys, ask).collect()
        want = defaultdict(list)
        for k, d, v in rows:
            if v is not None and math.isfinite(v) and (len(keys) == 2 or d < 3):
                want[(k, d)[: len(keys)]].append(v)
        assert {tuple(r[c] for c in keys) for r in got} == set(want)
        for r in got:
            x = sorted(want[tuple(r[c] for c in keys)])
            assert r["n"] == len(x)
            for p in ask:
                exact = x[max(1, -(-p * len(x) // 1000)) - 1]
                assert abs(r[f"p{p}"] - exact) <= percentiles.ALPHA * abs(exact) * (1 + 1e-9)
    assert percentiles.percentiles(s.where("false"), ["k"], [500]).count() == 0


def test_pieces(spark):
    rng = random.Random(2)
    base = lambda n: "".join(rng.choice("ACGTacgt") for _ in range(n))
    texts = {
        "gaps": "NNNNNNNNNNNN".join(base(700) for _ in range(9)), "long": base(500) + "n" * 9 + base(4000) + "xX.nN.....NN" + base(300), "dense": ("A" * 30 + "N" * 10) * 200,
        "short": base(1000), "all": "N" * 3000, "empty": "", "null": None,
    }
    rows = [(i, k, v) for i, (k, v) in enumerate(texts.items())] + [(90, "gaps", "A" * 5000), (91, None, base(1500))]
    df = spark.createDataFrame(rows, "id long, name string, seq string").withColumn("cut", F.lit("z"))
    got = defaultdict(list)
    for r in pieces.split_texts(df, "name", "seq", 1000, 20, tie="id").collect():
        got[r["name"]].append(r)
    assert set(got) == {"gaps", "long", "dense", "all", None}
    for name, rs in got.items():
        rs.sort(key=lambda r: r["piece"])
        text = texts.get(name) or rows[-1][2]
        assert [r["piece"] for r in rs] == list(range(1, len(rs) + 1)) and rs[0]["first"] == 1 and rs[-1]["last"] == len(text) and rs[-1]["cut"] == "end"
        for a, b in zip(rs, rs[1:]):
            assert b["first"] == a["last"] - 19
        for r in rs:
            assert r["last"] - r["first"] + 1 <= 1000
            if r["cut"] == "gap":
                assert text[r["last"] - 1] in "NnXx."
        assert rs[0]["longest_stretch"] == max(map(len, re.split(pieces.GAP, text)))
    assert all(r["cut"] != "forced" for n in ("gaps", "dense", "all") for r in got[n])
    assert any(r["cut"] == "forced" for r in got["long"])


def test_an_edit_alters_neighbouring_pieces_only():
    rng = random.Random(12)
    t = "".join(rng.choice("ACGT") for _ in range(60_000))
    pattern, table = re.compile(pieces.GAP), pieces._table()
    cut = lambda s: {s[a:b] for a, b, _ in pieces.cut_positions(s, 1000, 0, 250, pattern, table)[0]}
    a, b = cut(t), cut(t[:30_000] + "ACGTA" + t[30_000:])
    assert len(a - b) <= 8 < len(a) / 4


@pytest.mark.parametrize("heavy", [5, 40, 10_000])
def test_top_n_against_brute_force(spark, heavy):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", f"g{rng.randrange(30)}", None]), rng.choice([None, *[rng.randrange(-3, 4)] * 5]), rng.choice(["p", "q", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, g string, s int, x string").withColumn("rank", F.lit(0)).repartition(4)
    got = {(r["g"], r["id"]) for r in top_n.top_n(df, "g", "s", "id", 5, ["x"], heavy_rows=heavy).select("g", "id").collect()}
    once = {}
    for i, g, s, x in rows:
        if g is not None and s is not None:
            once.setdefault((g, s, x), i)
    by = defaultdict(list)
    for (g, s, _), i in once.items():
        by[g].append((-s, i))
    assert got == {(g, i) for g, v in by.items() for _, i in sorted(v)[:5]}
    plain = top_n.top_n(df, "g", "s", "id", 7, heavy_rows=heavy).where("g = 'hot'").orderBy("rank").select("id").collect()
    assert [r["id"] for r in plain] == [i for _, i in sorted((-s, i) for i, g, s, _ in rows if g == "hot" and s is not None)[:7]]
    assert top_n.top_n(df.where("false"), "g", "s", "id", 3).count() == 0
