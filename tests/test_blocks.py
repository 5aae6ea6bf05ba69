import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import anchors as A, blocks, seeds
from helixframe.plans import mapping, paired
from helixframe.queries import mapping as Q

SEEDS = (seeds.CONTIGUOUS, seeds.SPACED)


@pytest.fixture(scope="module")
def genome(spark):
    """Contigs with repeats within and between them, of which one spans several stretches of 2,048 bases."""
    rng = random.Random(9)
    new = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit = new(60)
    texts = [new(3000) + unit + new(4000) + unit + "N" + new(1500) + unit[:40], unit + new(30) + unit, new(11), new(700) + unit, "", "ACGT" * 30 + "RY" + new(500)]
    return spark.createDataFrame([(n, f"c{n}", s, len(s)) for n, s in enumerate(texts)] + [(9, "c9", None, None)], "cn long, name string, seq string, len int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cutoff", (1, 2, 4, 300))
def test_light_postings_equal_those_of_the_join(spark, genome, cutoff):
    want = seeds.without_heavy(seeds.kmers(genome, ["cn"], "seq", SEEDS), cutoff).groupBy("cn", "sn").agg(F.count(F.lit(1)).alias("postings"), F.sum("pos").alias("pos_sum"))
    for stretch in (None, 2048):
        assert rows(blocks.light_postings(genome, SEEDS, cutoff, stretch)) == rows(want)


def contig_table(genome, path):
    genome.where("seq is not null").select(F.col("cn").alias("contig_id"), "name", F.lit(0).cast("long").alias("size"), F.lit(0).alias("chunk"), "seq").write.parquet(f"{path}/contig.parquet")
    return str(path)


def test_heavy_keys_are_cut_without_postings_on_disk(spark, genome, tmp_path):
    got = Q.heavy_key_cutoff(spark, contig_table(genome, tmp_path))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() > 0


@pytest.fixture(scope="module")
def stranded(spark, genome):
    """Stranded reads of 30 to 36 bases from all over the contigs, one of them twice, and some that have no seeds."""
    rng, out = random.Random(5), []
    for r in genome.where("seq is not null").collect():
        out += [(len(out) + n, r["seq"][p : p + rng.choice((30, 36))]) for n, p in enumerate(range(0, len(r["seq"]), 37))]
    out += [(9000, out[3][1]), (9001, "N" * 36), (9002, ""), (9003, None), (9004, "ACG")]
    return A.both_strands(spark.createDataFrame(out, "read_id long, seq string"))


@pytest.fixture(scope="module")
def anchors(spark, genome, stranded):
    """Anchors by the join of rows, per cut-off."""
    return {c: A.seed_anchors(stranded, seeds.without_heavy(seeds.kmers(genome, ["cn"], "seq", SEEDS), c), SEEDS).cache() for c in (2, 1000)}


@pytest.mark.parametrize("stretch", (None, 2048))
@pytest.mark.parametrize("cutoff", (2, 1000))
def test_anchor_sums_equal_those_of_the_join(genome, stranded, anchors, cutoff, stretch):
    want = anchors[cutoff].groupBy("read_id", "st").agg(F.count(F.lit(1)), F.countDistinct("cn"), F.sum("x"), F.sum("y"))
    assert rows(blocks.anchor_sums(stranded, genome, SEEDS, cutoff, 36, stretch)) == rows(want)


def test_seed_join_has_no_rows_of_postings(spark, genome, tmp_path):
    got = Q.seed_join_anchors(spark, contig_table(genome, tmp_path))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stretch", (None, 2048))
def test_supported_anchors_equal_those_of_the_join(genome, stranded, anchors, stretch):
    for cutoff in anchors:
        assert rows(blocks.supported_anchors(stranded, genome, SEEDS, cutoff, 36, stretch)) == rows(A.supported(anchors[cutoff]))


@pytest.mark.parametrize("stretch", (None, 2048))
def test_windows_equal_those_of_all_islands(genome, stranded, anchors, stretch):
    lens = stranded.where("st = 0").select("read_id", F.length("seq").alias("read_len"))
    for support in (False, True):
        a = A.supported(anchors[1000]) if support else anchors[1000]
        every = A.diagonal_islands(a.join(lens, "read_id"), "read_len", 14).join(lens, "read_id").join(genome.select("cn", F.col("len").alias("contig_len")), "cn")
        cols = ["read_id", "st", "cn", "x", "y", "length", "weight", "read_len", "contig_len"]
        assert rows(blocks.islands(stranded, genome, SEEDS, 1000, 36, 140, support, None, stretch).select(cols)) == rows(every.select(cols))
        few = blocks.islands(stranded, genome, SEEDS, 1000, 36, 140, support, (55, 10), stretch)
        assert few.count() < every.count()
        want = rows(A.candidate_windows(every, "read_len", "contig_len", 10, -33, -3))
        assert rows(A.candidate_windows(few, "read_len", "contig_len", 10, -33, -3)) == want and want


def test_mapping_writes_no_postings(spark, genome, monkeypatch):
    """Neither single reads nor pairs are mapped by an index in rows."""
    monkeypatch.setattr(seeds, "without_heavy", None)
    g = genome.where("cn = 0").first()["seq"]
    reads = spark.createDataFrame([(1, g[100:136])], "read_id long, seq string")
    assert [r["genome_start"] for r in mapping.map_reads(reads, genome).collect()] == [101]
    pair = spark.createDataFrame([(1, g[100:136], g[100:400].translate(str.maketrans("ACGT", "TGCA"))[::-1][:36])], "pair_id long, seq0 string, seq1 string")
    assert [(r["start0"], r["end1"]) for r in paired.map_pairs(pair, genome).collect()] == [(101, 400)]
