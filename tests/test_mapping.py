import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import merge, pairs, reads, seeds, select
from helixframe.plans import mapping, paired
from helixframe.sources import fastx, sam
from helixframe.streaming import events


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(4)
    return {n: "".join(rng.choice("ACGT") for _ in range(m)) for n, m in ((0, 3000), (1, 700), (2, 37))}


def test_reads_map_to_where_they_come_from(spark, genome):
    contigs = spark.createDataFrame([(n, f"c{n}", s, len(s)) for n, s in genome.items()], "cn long, name string, seq string, len int")
    g, want = genome[0], {}
    reads = []

    def add(i, seq, st, start, edit):
        reads.append((i, rc(seq) if st else seq))
        want[i] = (0, st, start, edit)

    add(1, g[100:140], 0, 101, "40")
    add(2, g[500:540], 1, 501, "40")
    snp = g[900:920] + ("A" if g[920] != "A" else "C") + g[921:940]
    add(3, snp, 0, 901, f"20{snp[20]}19")
    add(4, g[1500:1518] + g[1520:1542], 0, 1501, None)
    reads += [(5, "ACGTTGCA" * 5), (6, ""), (7, "ACG"), (8, None), (9, g[2000:2020] + "N" + g[2021:2040])]
    df = spark.createDataFrame(reads, "read_id long, seq string")
    hits = mapping.with_quality(mapping.map_reads(df, contigs)).collect()
    got = {r["read_id"]: r for r in hits if r["rank"] == 1}
    assert set(got) == {1, 2, 3, 4, 9}
    for i, (cn, st, start, edit) in want.items():
        r = got[i]
        # a read from the reverse strand is found as its reverse complement
        assert (r["cn"], r["st"], r["genome_start"]) == (cn, st, start)
        assert edit is None or r["edit"] == edit
        assert r["mapq"] > 50
    assert got[4]["cigar"].count("D") == 1 and got[4]["genome_end"] - got[4]["genome_start"] + 1 == 42
    assert got[3]["score"] == 39 * 10 - 15


def test_pair_bounds_hold_each_mode_apart(spark):
    """Mates of 30 and 50 bases: exactly the named mode accepts the planted geometry."""
    w = {30: 42, 50: 70}
    for mode, size, offset in (("opp-in", 200, 150), ("opp-out", 100, 130), ("col-fw", 150, 150), ("col-bw", 150, 130)):
        first = spark.createDataFrame([(1, 10, 0, 0, 1000, w[30], 30, 300)], "pair_id long, hit long, cn long, st int, g_off long, w_len int, read_len int, score int")
        second = spark.createDataFrame([(1, 20, 0, 1, 1000 + offset, w[50], 50, 500)], "pair_id long, hit long, cn long, st int, g_off long, w_len int, read_len int, score int")
        assert pairs.pair_hits(first, second, mode, size - 10, size + 10).count() == 1
        assert pairs.pair_hits(first, second, mode, size + 200, size + 300).count() == 0
    with pytest.raises(ValueError):
        pairs.bounds("sideways", *[F.lit(0)] * 5, 0, 1)


def test_overlap_fold(spark):
    rows = [(1, 0, 0, 0, 100, True), (1, 0, 0, 5, 100, True), (1, 0, 0, 20, 100, False), (1, 0, 0, 30, 100, True), (1, 0, 1, 31, 100, True), (1, 1, 0, 6, 100, True)]
    df = spark.createDataFrame(rows, "read_id long, st int, cn int, g_off long, w_len int, passes boolean")
    got = {(r["st"], r["cn"], r["g_off"]) for r in select.suppress_overlaps(df, 90).collect()}
    assert got == {(0, 0, 0), (0, 0, 30), (0, 1, 31), (1, 0, 6)}


def test_dominant_legs_replace_and_merge(spark):
    hits = spark.createDataFrame([(1, 1, "c", 0, 10, 20, 50), (1, 2, "c", 0, 10, 22, 90), (1, 3, "c", 1, 40, 50, 70), (1, 4, "c", 1, 41, 50, 60)], "pair_id long, hit long, cn string, st int, start long, end long, score int")
    p = spark.createDataFrame([(1, 1, 3), (1, 2, 4)], "pair_id long, hit0 long, hit1 long")
    assert [tuple(r) for r in pairs.dominant_legs(p, hits).collect()] == [(1, 2, 3)]


def test_merge_of_files_equals_one_file(spark):
    rng = random.Random(2)
    rows = [(i, f"r{rng.randrange(30)}", rng.randrange(4), rng.choice([300, 325, 350, 360]), 36) for i in range(400)]
    df = spark.createDataFrame(rows, "hit long, read string, file int, score int, n int")
    runs = [merge.merge_single(merge.partials(d, "read", "file", "score", "n"), "read", "file", "hit", "score", 3) for d in (df, df.withColumn("file", F.lit(0)))]
    a, b = ({(r["hit"], r["mapq"]) for r in x.collect()} for x in runs)
    assert a == b and a


def test_index_of_short_and_long_sequences(spark):
    rng = random.Random(1)
    s = "".join(rng.choice("ACGTN") if k % 50 == 0 else rng.choice("ACGT") for k in range(9500))
    df = spark.createDataFrame([(1, s), (2, "ACG"), (3, ""), (4, None)], "cn long, seq string")
    letters = lambda key, n: "".join("ACGT"[key >> 2 * k & 3] for k in reversed(range(n)))
    s = s[:700] + "é" + s[701:4090] + s[4090:]
    df = df.withColumn("seq", F.when(F.col("cn") == 1, F.lit(s)).otherwise(F.col("seq")))
    got = {(r["sn"], r["pos"], letters(r["key"], (seeds.CONTIGUOUS, seeds.SPACED)[r["sn"]].weight)) for r in seeds.kmers(df, ["cn"], "seq", (seeds.CONTIGUOUS, seeds.SPACED)).collect()}
    want = set()
    for n, p in enumerate((seeds.CONTIGUOUS, seeds.SPACED)):
        for i in range(len(s) - p.span + 1):
            w = s[i : i + p.span]
            if "N" not in w and "é" not in w:
                want.add((n, i, "".join(c for c, b in zip(w, p.pattern) if b == "1")))
    assert got == want
    assert seeds.auto_cutoff(3 * 10**9, 12) == 17881


def test_sam_lines(spark):
    lines = ["@HD\tVN:1.0", "", None, "r\t16\tc\t5\t255\t3M\t*\t0\t0\t*\t*\tAS:i:30\tZZ:Z:a:b\tAS:i:31", "q\t4"]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, line string")
    got = {r["n"]: r for r in sam.parse(df).collect()}
    assert set(got) == {3, 4}
    assert got[3]["mapq"] is None and got[3]["pos"] == 5 and got[3]["seq"] is None and got[3]["tags"] == {"AS": "31", "ZZ": "a:b"}
    assert got[4]["qname"] == "q" and got[4]["rname"] is None and got[4]["tags"] == {}


def test_fastx_reads_in_slices_what_was_written(spark, tmp_path):
    rng = random.Random(6)
    recs = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 200)))) for i in range(200)]
    df = spark.createDataFrame(recs, "name string, seq string")
    fastx.fasta_text(df, "name", "seq").coalesce(1).write.text(str(tmp_path / "fa"))
    for split in (1 << 20, 500):
        got = fastx.read(spark, str(tmp_path / "fa"), split)
        assert {(r["name"], r["seq"]) for r in got.collect()} == set(recs) and got.count() == len(recs)
    q = df.withColumn("qual", F.expr("repeat('@', length(seq))"))
    fastx.fastq_text(q, "name", "seq", "qual").coalesce(1).write.text(str(tmp_path / "fq"))
    got = fastx.interleaved(fastx.read(spark, str(tmp_path / "fq"), 700)).collect()
    assert {(r["name"], r["seq"], len(r["qual"])) for r in got} == {(n, s, len(s)) for n, s in recs}
    assert sorted((r["pair_id"], r["nip"]) for r in got) == [(i // 2, i % 2) for i in range(200)]
    assert [r["name"] for r in sorted(got, key=lambda r: r["ordinal"])] == [n for n, _ in recs]


def test_stream_drains(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' + make_dt_interval(0, 0, cast(id as int)) ts, id % 2 k, 1.0D v from range(120)").write.parquet(str(tmp_path / "e"))
    got = events.drain(events.tumbling(events.stream_of(spark, str(tmp_path / "e")), "ts", "k", "v"), "t_events").collect()
    assert sum(r["n"] for r in got) == 120 and len(got) == 6


def test_genome_chunks():
    chunks = merge.genome_chunks([("a", 60), ("b", 50), ("c", 40), ("d", 30)], 100)
    assert sorted(n for c in chunks for n in c) == list("abcd") and len(chunks) == 2
    sizes = dict(zip("vwxyz", (6, 6, 4, 4, 4)))
    assert sorted(sum(sizes[n] for n in c) for c in merge.genome_chunks(list(sizes.items()), 12)) == [12, 12]
    assert merge.genome_chunks([], 10) == []
    with pytest.raises(ValueError):
        merge.genome_chunks([("e", 500)], 100)
    rng = random.Random(7)
    many = [(f"c{k}", rng.randrange(0, 60)) for k in range(300)]
    got = merge.genome_chunks(many, 100)
    assert sorted(n for c in got for n in c) == sorted(n for n, _ in many) and max(sum(dict(many)[n] for n in c) for c in got) <= 100


@pytest.mark.parametrize("mode", pairs.MODES)
def test_pairs_are_mapped_in_every_mode(spark, mode):
    rng = random.Random(3)
    c = "".join(rng.choice("ACGT") for _ in range(6000))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    fw, bw = (lambda x: c[x : x + 36]), (lambda x: rc(c[x : x + 36]))
    first, second = {"opp-in": (fw, bw), "opp-out": (bw, fw), "col-fw": (fw, fw), "col-bw": (bw, bw)}[mode]
    rows, want = [], {}
    for n in range(12):
        x = 400 * n + 100
        y = x + rng.randrange(80, 300)
        rows.append((n, first(x), second(y)))
        want[n] = (x + 1, y + 1, {"opp-in": y + 36 - x, "opp-out": y - x - 36}.get(mode, y - x))
    rows += [(50, fw(100), fw(4500)), (51, fw(100), None), (52, fw(100) * 30, bw(200))]
    df = spark.createDataFrame(rows, "pair_id long, seq0 string, seq1 string")
    contigs = spark.createDataFrame([(0, c, len(c))], "cn long, seq string, len int")
    got = paired.map_pairs(df, contigs, paired.PairOptions(mode=mode)).where("rank = 1").collect()
    assert {r["pair_id"]: (r["start0"], r["start1"], abs(r["size"])) for r in got} == want
    assert {r["st"] for r in got} == {int(first is bw)}


def test_rows_of_reads_and_skips(spark):
    reads_ = spark.createDataFrame([("a/1 x",), ("b:2",), (None,)], "name string")
    rows = spark.createDataFrame([("a", 1), ("a/2", 2), ("c", 3), (None, 4)], "qname string, row int")
    got = {(r["name"], r["row"]) for r in reads.rows_of_reads(reads_, rows, "name", "qname").collect()}
    assert got == {("a/1 x", 1), ("a/1 x", 2), ("b:2", None), (None, None)}
    s = spark.createDataFrame([(1, 10, "5M100N3M1I2M7N4M"), (2, 10, "9M"), (3, 10, None)], "id int, s long, c string")
    assert sorted((r["id"], r["part"], r["part_start"], r["part_cigar"]) for r in reads.split_at_skips(s, "s", "c").collect()) == [(1, 0, 10, "5M"), (1, 1, 115, "3M1I2M"), (1, 2, 127, "4M"), (2, 0, 10, "9M")]
    q = spark.createDataFrame([(1, 30, 20.0), (1, 30, 5.0), (2, 2000, 20.0), (3, 30, None), (None, 30, 30.0)], "p int, n int, q double")
    assert {r["p"] for r in reads.usable(q, F.col("n"), F.col("q"), pair="p").collect()} == {3, None} and reads.usable(q, F.col("n"), F.col("q")).count() == 3


def test_saved_index(spark, tmp_path):
    i = seeds.kmers(spark.createDataFrame([(1, "ACGTACGTACGTACGTA")], "cn long, seq string"), ["cn"], "seq", (seeds.CONTIGUOUS, seeds.SPACED))
    seeds.save_index(i, str(tmp_path / "i"))
    order = ["sn", "pos"]
    assert [tuple(r) for r in seeds.load_index(spark, str(tmp_path / "i")).select(i.columns).orderBy(order).collect()] == [tuple(r) for r in i.orderBy(order).collect()]
    assert seeds.load_index(spark, str(tmp_path / "i"), [1]).count() == i.where("sn = 1").count()


def test_mate_support(spark):
    schema = "pair_id long, read_id long, st int, cn int, x long, y int"
    a = spark.createDataFrame([(1, 1, 0, 0, 100, 0), (1, 1, 0, 0, 110, 10), (1, 1, 0, 0, 90000, 3)], schema)
    b = spark.createDataFrame([(1, 2, 1, 0, 300, 0), (1, 2, 1, 0, 90500, 0), (1, 2, 1, 0, 90510, 0)], schema)
    from helixframe.operators.anchors import mate_supported

    got = {m: {r["x"] for r in mate_supported(a, b, m).collect()} for m in range(4)}
    assert got == {0: {100, 110, 90000}, 1: set(), 2: {100, 110, 90000}, 3: {100, 110, 90000}}
