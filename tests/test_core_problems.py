import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from helixframe.operators import intervals, ranking, row_parsing, skewed_keys

SEED = 11


def test_key_statistics_against_brute_force(spark, tmp_path):
    rng = random.Random(SEED)
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", f"k{rng.randrange(50)}"]), rng.choice([None, *range(10)]), "x") for i in range(5000)]
    spark.createDataFrame(rows, "id long, key string, score int, n string").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = skewed_keys.key_statistics(df.select("*", *skewed_keys.file_block(700)), ["key"], "score", chunk_rows=300).collect()
    want = defaultdict(list)
    for _, k, s, _ in rows:
        want[k].append(s)
    assert {r["key"] for r in got} == set(want)
    for r in got:
        s = [x for x in want[r["key"]] if x is not None]
        assert (r["n_hits"], r["n_scored"], r["best_score"]) == (len(want[r["key"]]), len(s), max(s, default=None))
        assert (r["mean_score"] is None) == (not s) and (not s or abs(r["mean_score"] - sum(s) / len(s)) < 1e-9)
    assert next(r for r in got if r["key"] == "hot")["n_chunks"] >= 5


def test_ordinals_are_a_permutation_and_keep_keys_together(spark, tmp_path):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "h").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"))
    df.repartition(4).write.parquet(str(tmp_path / "t"))
    n = skewed_keys.number_rows(spark.read.parquet(str(tmp_path / "t")).select("*", *skewed_keys.file_block(128)), ["key"]).collect()
    assert sorted(r["ordinal"] for r in n) == list(range(3000))
    span = defaultdict(list)
    for r in n:
        span[r["key"]].append(r["ordinal"])
    assert all(max(v) - min(v) + 1 == len(v) for v in span.values())


def test_key_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, score int, block long, at long")
    assert skewed_keys.key_statistics(empty, ["key"], "score").collect() == []


def test_heavy_keys(spark):
    s = spark.createDataFrame([("a", "x", 97), ("a", "y", 3), ("a", None, 50), ("b", "z", 1)], "kind string, key string, n_hits long")
    rows = s.select("kind", F.explode(F.sequence(F.lit(1), F.col("n_hits"))).alias("k"))
    assert {(r["kind"], r["key"]) for r in skewed_keys.heavy_keys(s, rows, "kind", "key", 0.03).collect()} == {("a", "x"), ("b", "z")}


def brute_periods(rows):
    by = defaultdict(list)
    for e, a, b in rows:
        if None not in (e, a, b):
            by[e].append((min(a, b), max(a, b)))
    out = set()
    for e, iv in by.items():
        iv.sort()
        merged = [list(iv[0])]
        for a, b in iv[1:]:
            if a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(e, "covered", a, b) for a, b in merged}
        out |= {(e, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


def test_intervals_against_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = []
        for _ in range(400):
            e, a = rng.choice(["g", "g", "h", None]), rng.choice([None, *[rng.randrange(-300, 3000)] * 20])
            rows.append((e, a, None if a is None else a + rng.randrange(-12, 12)))
        rows += rows[:50]
        df = spark.createDataFrame(rows, "e string, a long, b long").withColumn("p", F.lit(1)).withColumn("kind", F.lit("odd"))
        # tiny buckets, so that prefixes and carries cross them
        got = {tuple(r) for r in intervals.merge_intervals(df, "e", "a", "b", bucket_bits=4, rank_span=7).collect()}
        assert got == brute_periods(rows)
    assert intervals.merge_intervals(spark.createDataFrame([], "e string, a long, b long"), "e", "a", "b").count() == 0


def test_last_known_crosses_buckets(spark):
    rows = [(f, i, "v%d" % i if i % 13 == 0 and i else None) for f in ("a", None) for i in range(60)]
    got = ranking.last_known(spark.createDataFrame(rows, "f string, i int, v string"), ["f"], "i", F.col("v"), "w", span=5).collect()
    assert all(r["w"] == (None if r["i"] < 13 else "v%d" % (r["i"] // 13 * 13)) for r in got) and len(got) == len(rows)


HEAD = "#FORMAT: readname contigname score editstring"


def reason(line, cols=("readname", "contigname", "score", "editstring")):
    """A small automaton, written apart from the patterns."""
    body, out, i = line[1:], [], 0
    while True:
        if i < len(body) and body[i] == '"':
            j = i + 1
            while True:
                j = body.find('"', j)
                if j < 0:
                    return "quoting"
                if body[j : j + 2] == '""':
                    j += 2
                    continue
                break
            out.append(body[i + 1 : j].replace('""', '"'))
            i = j + 1
            if i < len(body) and body[i] != "\t":
                return "quoting"
        else:
            j = body.find("\t", i)
            j = len(body) if j < 0 else j
            if '"' in body[i:j]:
                return "quoting"
            out.append(body[i:j])
            i = j
        if i >= len(body):
            break
        i += 1
        if i == len(body):
            out.append("")
            break
    if len(out) != len(cols):
        return "columns"
    s, e = out[2].strip(" "), out[3].strip(" ")
    if not re.fullmatch(r"-?[0-9]+", s) or not -(2**31) <= int(s) < 2**31:
        return "score"
    if not re.fullmatch(r"(?:[0-9]+|[ACGTNacgtnxX-]|\([ACGTUMRWSYKVHDBNXacgtumrwsykvhdbnx]+\))+", e):
        return "edit"
    return None


CASES = [
    ">r\tg\t10\t36", ">r\tg\t10", '>"r\tx"\tg\t10\t36', '>"r""q"\tg\t" 10 "\t" 3A2 "', '>"r"q\tg\t10\t36', '>r"\tg\t10\t36', '>"r\tg\t10\t36', ">r\tg\t1e3\t36",
    ">r\tg\t2147483648\t36", ">r\tg\t-2147483648\t36", ">r\tg\t\t36", ">r\tg\t10\t", ">r\tg\t10\t3(12)4", ">r\tg\t10\t3(ac)--xN", ">r\tg\t10\t()", ">r\tg\t10\t36\t", ">", ">\t\t\t",
    '>r\tg\t"10\t36', ">r\tg\t+5\t36", ">r\tg\t٣\t36", ">r\tg\t10\t36 ", ">r\tg\tx\ty", ">r\tg\t1 0\t36", ">" + "a" * 20000 + "\tg\t10\t" + "A1" * 9000, '>"' + '""' * 9000 + '"\tg\t1\t1', ">r\tg\t10\t36\n", '>""\t""\t1\t1',
]


def test_row_reasons_against_an_automaton(spark):
    rows = [(0, 1, 1, HEAD)] + [(i, 1, i + 1, c) for i, c in enumerate(CASES, 1)] + [(900, 1, 500, None), (901, 1, 501, "#> x"), (902, 2, 1, ">r\tg\t1\t1"), (903, 1, 502, "")]
    df = spark.createDataFrame(rows, "line_id long, file_no int, line_no int, line string").withColumn("reason", F.lit("old")).withColumn("raw", F.lit(1))
    got = {r["line_id"]: r["reason"] for r in row_parsing.classify(df).select("line_id", "reason").collect()}
    assert got == {i: reason(c) for i, c in enumerate(CASES, 1)} | {902: "columns"}


def test_first_broken_field_by_prefix_patterns():
    s = row_parsing.Schema(["readname", "editstring", "contigname", "score"])
    assert s.whole.match('a\t3A2\t"g\th"\t" 12 "').groups() == ("a", "3A2", '"g\th"', '" 12 "')
    for body, want in {
        "a\t3A2\tg\tx": ("score", 4), "a\t??\tg\t1": ("edit", 2), "a\t??\tg\tx": ("score", 4), 'a\t??\t"g\tx': ("quoting", 3), 'a\t3\tg\t1\tq"': ("quoting", 5),
        "a\t??": ("columns", 3), "a\t3\tg\t1\t": ("columns", 5), '"a\tb"\t3': ("columns", 3), "a\t3\tg\t2147483648": ("score", 4), "a\t3\tg\t-2147483649": ("score", 4),
    }.items():
        assert not s.whole.match(body) and s.broken(body) == want, body
    assert all(s.whole.match(f"a\t3\tg\t{n}") for n in ("2147483647", "-2147483648", "0", "-0", "000", "0" * 40 + "7", "1" * 9))
    assert row_parsing.Schema([]).broken("a") == ("columns", 1)


def test_typed_hits(spark):
    rows = [(1, 1, 1, "#FORMAT: score readname editstring pchance"), (2, 1, 2, '>" 7 "\t"a ""b"""\t3A\t0.5'), (3, 1, 3, "#FORMAT: readname contigname"), (4, 1, 4, ">r\tg"), (5, 1, 5, ">r\tg"), (6, 1, 6, ">r")]
    df = spark.createDataFrame(rows, "line_id long, file_no int, line_no int, line string")
    got = {r["line_id"]: r for r in row_parsing.native_hits(df).collect()}
    assert set(got) == {2, 4, 5}
    assert (got[2]["score"], got[2]["readname"], got[2]["editstring"], got[2]["pchance"]) == (7, 'a "b"', "3A", 0.5)
    assert got[4]["contigname"] == "g" and got[4]["score"] is None
    assert row_parsing.failures(df.where("false")).count() == 0
