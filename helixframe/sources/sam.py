"""Alignment text: rows, tags and headers, rendered and parsed as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIXED = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
INTS = ("flag", "pos", "mapq", "pnext", "tlen")
HEADER_ORDER = ("@HD", "@SQ", "@RG", "@PG", "@CO")


def render(fields: dict[str, Column], tags: dict[str, Column] | None = None) -> Column:
    """One line; null text is '*', a null number 0 (255 for the quality). Null tags are left out. A tag name
    carries its type, as in 'AS:i'."""
    out = []
    for c in FIXED:
        v = fields.get(c, F.lit(None))
        out.append(F.coalesce(v.cast("string"), F.lit("255" if c == "mapq" else "0" if c in INTS else "*")))
    extra = [F.concat(F.lit(f"\t{t}:"), v.cast("string")) for t, v in (tags or {}).items()]
    return F.concat(F.concat_ws("\t", *out), *(F.coalesce(x, F.lit("")) for x in extra))


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Fixed columns with sentinels as null, and `tags`: two-letter name to value. Header, empty and null lines
    are no rows; of a tag given twice the last holds; other columns come out as they are."""
    f = F.split(F.col(line), "\t")
    rows = lines.where(F.col(line).isNotNull() & (F.col(line) != "") & ~F.col(line).startswith("@"))

    def field(n: int, c: str) -> Column:
        v = F.get(f, n)
        if c in INTS:
            v = v.try_cast("bigint")
            return F.when(v != 255, v) if c == "mapq" else F.when(v != 0, v) if c in ("pos", "pnext") else v
        return F.when(v != "*", v)

    tag = F.filter(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    uniq = F.aggregate(tag, F.create_map().cast("map<string,string>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != F.substring(t, F.lit(1), F.lit(2))), F.create_map(F.substring(t, F.lit(1), F.lit(2)), F.substring(t, F.lit(6), F.length(t)))))
    return rows.select(*(c for c in lines.columns if c != line), *(field(n, c).alias(c) for n, c in enumerate(FIXED)), uniq.alias("tags"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path).withColumnRenamed("value", "line").withColumn("file", F.col("_metadata.file_path")))


def header(contigs: DataFrame, name: str = "name", length: str = "len", program: str = "helixframe", version: str = "0.1.0") -> DataFrame:
    """rank, line: the header of a file over these contigs."""
    spark = contigs.sparkSession
    sq = contigs.select(F.lit(1).alias("rank"), F.concat(F.lit("@SQ\tSN:"), F.col(name), F.lit("\tLN:"), F.col(length).cast("string")).alias("line"))
    return spark.createDataFrame([(0, "@HD\tVN:1.0\tSO:unsorted"), (3, f"@PG\tID:{program}\tVN:{version}")], "rank int, line string").unionByName(sq)


def genome_length(headers: DataFrame, line: str = "line") -> DataFrame:
    """One row: contigs and the sum of their lengths, a contig counting once."""
    sq = headers.where(F.col(line).startswith("@SQ")).select(F.regexp_extract(line, r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract(line, r"\tLN:([0-9]+)", 1).try_cast("bigint").alias("len")).distinct()
    return sq.agg(F.count(F.lit(1)).alias("contigs"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("genome_length"))


def merge_headers(headers: DataFrame, file: str = "file_no", line: str = "line") -> DataFrame:
    """rank, line: header lines of all files in the order of their kinds, equal ones once; the ids of program
    lines get their file's number before them."""
    numbered = F.when(F.col(line).startswith("@PG"), F.regexp_replace(F.col(line), F.lit(r"\tID:"), F.concat(F.lit("\tID:"), F.col(file).cast("string"), F.lit("-")))).otherwise(F.col(line))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, HEADER_ORDER)), F.substring(line, 1, 3)), F.lit(0))
    return headers.select(F.when(rank > 0, rank).otherwise(99).cast("int").alias("rank"), numbered.alias("line")).distinct()


def write(lines: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """Lines in order, range-sorted over the files of a folder."""
    lines.orderBy(*order).select(line).write.mode("overwrite").text(path)


def native_line(c: dict[str, Column], sequence: Column | None = None) -> Column:
    """A native hit row: a leading mark, then tab-separated fields, 1-based and inclusive."""
    f = [F.concat(F.lit(">"), c["readname"]), *(c[k].cast("string") for k in ("contigname", "strand", "contigstart", "contigend", "readstart", "readend", "readlength", "score", "editstring"))]
    if sequence is not None:
        f.append(sequence)
    return F.concat_ws("\t", *(F.coalesce(x, F.lit("")) for x in f))
