import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import alignments as A, alphabet as S, probability as P
from helixframe.operators import kernels as K


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(("edit", "want"), [("25", (25, 0, 0, 0, 0)), ("15A9", (24, 1, 0, 0, 0)), ("3(TGCT)20", (23, 0, 4, 0, 0)), ("5----20", (25, 0, 0, 4, 0)), ("4x15x6", (25, 0, 0, 0, 2))])
def test_edit_counts(spark, edit, want):
    c = A.edit_counts(F.col("e"))
    r = spark.createDataFrame([(edit,)], "e string").select(*(v.alias(k) for k, v in c.items())).first()
    assert tuple(r) == want


def test_variants_of_the_worked_example(spark):
    df = spark.createDataFrame([("2G1---12(AC)2", "+", 101)], "e string, s string, p long")
    got = [(r["kind"], r["value"], r["pos"]) for r in df.select(F.inline(A.variants(F.col("e"), F.col("s"), F.col("p")))).collect()]
    assert got == [("s", "G", 103), ("d", "3", 105), ("i", "AC", 119)]


@pytest.mark.parametrize(("s0", "e0", "r0", "s1", "e1", "r1", "want"), [(2, 4, False, 8, 9, True, 8), (7, 9, True, 3, 5, False, -7)])
def test_insert_size(spark, s0, e0, r0, s1, e1, r1, want):
    assert one(spark, A.insert_size(*(F.lit(x) for x in (s0, e0, r0, s1, e1, r1))), a=1) == want


def test_cigar_and_reverse(spark):
    assert one(spark, A.edit_to_cigar(F.col("e"), F.lit(3), F.lit(12), F.lit(14)), e="3A2(AC)--1x1") == "2S6M2I2D2M2S"
    e = "3A(AC)--G4"
    assert one(spark, A.reverse_edit(A.reverse_edit(F.col("e"))), e=e) == e
    p = A.cigar_parts(F.col("c"))
    assert one(spark, A.render_cigar(p), c="3S5M1I2D4M") == "3S5M1I2D4M"
    assert one(spark, A.genome_end(F.lit(10), p), c="3S5M1I2D4M") == 20


def test_colours_round_trip(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 37):
        s = "".join(rng.choice("ACGT") for _ in range(n))
        assert one(spark, S.colours_to_letters(S.letters_to_colours(F.col("s"))), s=s) == s
    assert one(spark, S.letters_to_colours(F.col("s")), s="TACNA") == "03144"
    assert one(spark, S.colours_to_letters(F.lit("02.1")), a=1) == "TCNN"


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="ACGTNRYkm") == "kmRYNACGT"
    assert one(spark, S.reverse_complement(F.col("s"), rna=True), s="ACGU") == "ACGU"
    assert one(spark, S.reverse_complement_text(F.col("s")), s="AcGTR") == "RacgT".replace("T", "t")


def test_score_models():
    m, c = P.letter_model(), P.colour_model()
    assert abs(m.alpha - 3.0435) < 1e-3 and abs(m.beta - 3.957) < 1e-2
    assert abs(c.alpha - 3.0103) < 1e-3 and abs(c.beta - 3.9846) < 1e-2


def test_partitions_and_chance():
    p = P.partitions_table(12)
    assert [int(p[n].sum()) for n in range(1, 8)] == [1, 2, 3, 5, 7, 11, 15]
    t = P.lgamma_table(200)
    perfect = P.chance_probability(10**9, 25, 0, 0, 25, [], [], t, p)
    worse = P.chance_probability(10**9, 25, 2, 0, 25, [], [], t, p)
    assert P.ALMOST_ZERO <= perfect < worse < 1
    assert math.isclose(perfect, 2e9 / 4**25, rel_tol=1e-4) and math.isclose(worse, 2e9 * math.comb(25, 2) * 9 / 4**25, rel_tol=1e-2)
    assert P.chance_probability(10**6, 30, 0, 0, 29, [1], [], t, p) == P.chance_probability(10**6, 30, 0, 0, 29, [], [], t, p) == P.ALMOST_ZERO
    assert P.chance_probability(10**9, 10, 5, 0, 10, [], [], t, p) > 0.99


def naive_local(g, r, s):
    n, m, neg = len(r), len(g), -(10**9)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e, f = [[neg] * (m + 1) for _ in range(n + 1)], [[neg] * (m + 1) for _ in range(n + 1)]
    best = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i - 1][j] + s["open"], e[i - 1][j]) + s["ext_ins"]
            f[i][j] = max(h[i][j - 1] + s["open"], f[i][j - 1]) + s["ext_del"]
            d = h[i - 1][j - 1] + (s["match"] if g[j - 1] == r[i - 1] and g[j - 1] in "ACGT" else s["mismatch"])
            h[i][j] = max(0, d, e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_local_scores_against_naive():
    rng = random.Random(8)
    cheap = P.LETTER | {"open": -6, "ext_ins": -2, "ext_del": -3}
    for s in (P.LETTER, cheap):
        g = ["".join(rng.choice("ACGTN") for _ in range(30)) for _ in range(40)]
        r = ["".join(rng.choice("ACGT") for _ in range(12)) if k % 2 else x[5:11] + x[13:19] for k, x in enumerate(g)]
        assert K.local_scores(K.encode(g), K.encode(r), s).tolist() == [naive_local(a, b, s) for a, b in zip(g, r)]


def score_of(ops, s):
    total, i = 0, 0
    while i < len(ops):
        j = i
        while j < len(ops) and ops[j] == ops[i]:
            j += 1
        total += (j - i) * {"=": s["match"], "X": s["mismatch"], "I": s["ext_ins"], "D": s["ext_del"]}[ops[i]] + (s["open"] if ops[i] in "ID" else 0)
        i = j
    return total


def test_global_alignments_explain_their_score():
    rng = random.Random(9)
    g = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(60)]
    r = []
    for k, x in enumerate(g):
        y = x[6:30]
        r.append({0: y, 1: y[:10] + "ACGT"[("ACGT".index(y[10]) + 1) % 4] + y[11:], 2: y[:9] + y[12:] + x[30:33], 3: y[:12] + "GG" + y[12:22]}[k % 4])
    back = np.array([k % 2 == 1 for k in range(len(g))])
    for (score, start, ops), a, b in zip(K.global_alignments(K.encode(g), K.encode(r), reverse_ties=back), g, r):
        assert score_of(ops, P.LETTER) == score
        i, j = start, 0
        for o in ops:
            if o in "=X":
                assert (a[i] == b[j]) == (o == "=")
            i, j = i + (o != "I"), j + (o != "D")
        assert j == len(b)
    exact = K.global_alignments(K.encode(g[:1]), K.encode(r[:1]))[0]
    assert exact == (240, 6, "=" * 24)
    assert K.edit_string("==X=II=DD=", "", "ACGTAACG") == "2G1(AA)1--1"


def test_local_score_udf_of_odd_rows(spark):
    df = spark.createDataFrame([("ACGTACGT", "ACGT"), (None, "A"), ("", "A"), ("ACGT", None), ("AC", "GTGTGTGT")], "t string, s string")
    assert [r[0] for r in df.select(K.local_score("t", "s")).collect()] == [40, 0, 0, 0, 0]


def test_colour_alignment_explains_colour_errors():
    rng = random.Random(10)
    code = {b: n for n, b in enumerate("ACGT")}
    colour = lambda s: "".join(str(code[a] ^ code[b]) for a, b in zip("T" + s, s))
    g = ["".join(rng.choice("ACGT") for _ in range(44)) for _ in range(20)]
    for wrong in (0, 1, 2):
        r = [x[5:35] for x in g]
        c = [list(colour(x)) for x in r]
        for x in c:
            for at in rng.sample(range(4, 26, 5), wrong):
                x[at] = str((int(x[at]) + 1) % 4)
        for score, start, ops, crossed in K.colour_alignments(K.encode(g), K.decode_layers(["".join(x) for x in c]), P.COLOUR):
            assert (score, start, crossed, len(ops)) == (300 - 20 * wrong, 5, wrong, 30)
    snp = g[0][5:20] + "ACGT"[(code[g[0][20]] + 1) % 4] + g[0][21:35]
    assert K.colour_alignments(K.encode(g[:1]), K.decode_layers([colour(snp)]), P.COLOUR)[0][:2] == (290 - 24, 5)
    gap = g[1][5:20] + g[1][22:37]
    score, start, ops, crossed = K.colour_alignments(K.encode(g[1:2]), K.decode_layers([colour(gap)]), P.COLOUR)[0]
    assert start == 5 and crossed == 0 and ops.count("D") == 2 and score == 300 - 33 - 14
    assert K.pretty("=XID=", "ACGT", "AGTT", 0) == "G: AC-GT\n   |   |\nR: AGT-T"


def test_chance_probability_of_long_indels(spark):
    from helixframe.operators import hit_stats as H

    rows = [(20, 1, 0, 120, [70], [2]), (20, 1, 0, 120, [1], [40, 40]), (5000, 0, 0, 5000, [], []), (20, 1, 0, 30, [2], [])]
    df = spark.createDataFrame(rows, "m int, s int, x int, n int, i array<int>, d array<int>").coalesce(1)
    got = [r[0] for r in df.select(H.chance_probability(10**9)("m", "s", "x", "n", "i", "d")).collect()]
    t, parts = P.lgamma_table(6000), P.partitions_table(100)
    want = [P.chance_probability(10**9, m + s + sum(i), s, x, n, i, d, t, parts) for m, s, x, n, i, d in rows]
    assert got == want and max(want[:2]) > P.ALMOST_ZERO
