"""FASTA and FASTQ: a splittable Python data source, record views, and sinks."""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.operators.ranking import ordinal_in_key

SPLIT = 64 << 20
SCHEMA = "file string, at bigint, name string, comment string, seq string, plus string, qual string"


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def detect(path: str) -> str:
    """'fasta' or 'fastq' by the first byte of the first line that is neither empty nor a comment."""
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        for line in f:
            if line.strip() and not line.startswith(b"#"):
                kind = {b">": "fasta", b"@": "fastq"}.get(line[:1])
                if kind is None:
                    raise ValueError(f"{path}: neither FASTA nor FASTQ")
                return kind
    return "fasta"


def _records(f, kind: str, start: int, end: int | None) -> Iterator[tuple]:
    """Records that begin within [start, end). Sequence and quality may wrap; comments are left out. The
    quality of a record is as long as its sequence, or one shorter in colour space, so that a quality line
    that begins with the record mark isn't taken for one."""
    mark = b">" if kind == "fasta" else b"@"
    f.seek(max(start - 1, 0))
    if start:
        f.readline()
        if kind == "fastq":
            # the next record is where a mark is followed, two lines on, by a plus
            while True:
                here = f.tell()
                a = f.readline()
                if not a:
                    return
                rest = f.tell()
                f.readline()
                c = f.readline()
                f.seek(rest)
                if a.startswith(mark) and c.startswith(b"+"):
                    f.seek(here)
                    break
    here, line = f.tell(), f.readline()
    while line:
        if not line.startswith(mark):
            here, line = f.tell(), f.readline()
            continue
        if end is not None and here >= end:
            return
        head, seq, plus, qual, at = line[1:].rstrip(b"\r\n"), [], None, [], here
        here, line = f.tell(), f.readline()
        while line and not line.startswith(mark) and not (kind == "fastq" and line.startswith(b"+")):
            if not line.startswith(b"#"):
                seq.append(line.strip())
            here, line = f.tell(), f.readline()
        s = b"".join(seq)
        if kind == "fastq" and line.startswith(b"+"):
            plus, got = line[1:].rstrip(b"\r\n"), 0
            colour = s[1:2].isdigit() or s[1:2] == b"."
            need = len(s) - 1 if colour else len(s)
            while got < need:
                q = f.readline()
                if not q:
                    break
                qual.append(q.rstrip(b"\r\n"))
                got += len(qual[-1])
            here, line = f.tell(), f.readline()
        name, _, comment = head.decode("utf-8", "replace").replace("\t", " ", 1).partition(" ")
        text = lambda b: b.decode("ascii", "replace")
        # characters below '!' in a quality are no quality
        q = "".join(c if c >= "!" else "!" for c in text(b"".join(qual))) if kind == "fastq" else None
        yield at, name, comment or None, text(s), text(plus) if plus is not None else None, q


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Slice]:
        p = self.path.removeprefix("file:")
        files = sorted(x for x in (glob.glob(f"{p}/**", recursive=True) if os.path.isdir(p) else glob.glob(p)) if os.path.isfile(x) and not os.path.basename(x).startswith(("_", ".")))
        if not files:
            raise FileNotFoundError(self.path)
        out: list[Slice] = []
        for x in files:
            n = os.path.getsize(x)
            out += [Slice(x, 0, None)] if x.endswith(".gz") else [Slice(x, s, min(s + self.split, n)) for s in range(0, max(n, 1), self.split)]
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        kind = detect(partition.path)
        with (gzip.open if partition.path.endswith(".gz") else open)(partition.path, "rb") as f:
            for at, *rest in _records(f, kind, partition.start, partition.end):
                yield (partition.path, at, *rest)


class Fastx(DataSource):
    """spark.read.format('fastx').load(path): one row per record, with the place in its file as order.

    Plain files are read in slices, each beginning at the first record mark after its start; gzip files
    whole. The folder must be visible to all executors."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(Fastx)
    return spark.read.format("fastx").option("split", str(split)).load(path)


def numbered(records: DataFrame) -> DataFrame:
    """Adds `ordinal`: 0-based place of a record within its file."""
    return ordinal_in_key(records, ["file"], F.shiftright("at", 22), "at")


def interleaved(records: DataFrame) -> DataFrame:
    """Successive records as pairs: pair_id and nip (0, 1) from the ordinal."""
    n = numbered(records)
    return n.withColumn("pair_id", F.floor(F.col("ordinal") / 2)).withColumn("nip", (F.col("ordinal") % 2).cast("int"))


def zipped(first: DataFrame, second: DataFrame, strict: bool = True) -> DataFrame:
    """The n-th record of one file with the n-th of the other; unequal counts are an error if strict."""
    a, b = (numbered(r).select(F.col("ordinal").alias("pair_id"), *(F.col(c).alias(f"{c}{n}") for c in ("name", "seq", "qual"))) for n, r in ((0, first), (1, second)))
    j = a.join(b, "pair_id", "full")
    if strict:
        odd = F.col("name0").isNull() | F.col("name1").isNull()
        j = j.withColumn("name0", F.when(odd, F.raise_error(F.lit("the files have different numbers of reads"))).otherwise(F.col("name0")))
    return j


def split_every(records: DataFrame, n: int) -> DataFrame:
    return numbered(records).withColumn("part", F.floor(F.col("ordinal") / n))


def fasta_text(df: DataFrame, name: str, seq: str, wrap: int = 79) -> DataFrame:
    """line: a record as text, its sequence broken after `wrap` characters."""
    body = F.regexp_replace(F.col(seq), f"(.{{{wrap}}})(?!$)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("line"))


def fastq_text(df: DataFrame, name: str, seq: str, qual: str) -> DataFrame:
    return df.select(F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual)).alias("line"))


def with_numeric_quality(seqs: DataFrame, quals: DataFrame, offset: int = 33) -> DataFrame:
    """FASTA and integer qualities of the same names as FASTQ columns: name, seq, qual."""
    q = F.array_join(F.transform(F.filter(F.split("quals", r"\s+"), lambda x: x != ""), lambda x: F.chr(x.try_cast("int") + offset)), "")
    return seqs.select("name", "seq").join(quals.select("name", q.alias("qual")), "name")
