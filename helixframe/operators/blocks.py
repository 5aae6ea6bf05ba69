"""Seeds of reads and contigs met block by block in memory, so that neither index nor anchors go to disk.

Contigs and reads are packed into blobs of some million bases. Each block of contigs meets each block of reads in
one task: the seeds of the reads are sorted in memory and those of the contigs stream past. All that is decided
about an anchor depends on the anchors of its read, strand and contig nearby, so the task decides it and
returns sums, supported anchors or islands. Contigs longer than a stretch are cut into stretches that overlap by
more than any decision reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.operators.anchors import REGION_BITS, REGION_OVERLAP
from helixframe.operators.seeds import BASE, Seed, _pieces
from helixframe.session import cut

#: seeds of at most so many bases have tables over all their keys: 64 MB of counts, 2 MB of bits
DENSE = 12
REGION = 1 << REGION_BITS
STRETCH, BLOB = 1 << 18, 1 << 23
#: a block of contigs and of stranded reads; positions looked up and anchors held at a time
BASES, READ_BASES, CHUNK, MOST = 1 << 25, 1 << 23, 1 << 20, 1 << 20
SLICE = 1 << 18


def dense(seeds: Sequence[Seed]) -> bool:
    return all(s.weight <= DENSE for s in seeds)


def _blob(meta: pa.RecordBatch, raw: bytes) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, meta.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(meta)
    z = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_HUFFMAN_ONLY)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([z.compress(raw) + z.flush()], pa.binary()), pa.array([len(raw)], pa.int64())], names=["meta", "data", "bases"])


PACKED = "meta binary, data binary, bases bigint"


def _unpack(meta: pa.Array, data: pa.Array) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for m, d in zip(meta, data):
        yield pa.ipc.open_stream(m.as_buffer()).read_all(), np.frombuffer(zlib.decompress(d.as_buffer()), np.uint8)


def pack_contigs(contigs: DataFrame, halo: int = REGION, stretch: int | None = None) -> DataFrame:
    """Blobs of stretches of contigs (cn, seq): their own part and `halo` bases on either side."""
    size = stretch or STRETCH
    if size % REGION or halo % REGION:
        raise ValueError("stretches and halos are whole regions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, held = [], [], 0

        def blob() -> pa.RecordBatch:
            cn, own, start, total, n = zip(*rows)
            return _blob(pa.RecordBatch.from_arrays([pa.array(cn, pa.int64()), *(pa.array(x, pa.int64()) for x in (own, start, total, n))], names=["cn", "own", "start", "len", "n"]), b"".join(texts))

        for b in batches:
            names = b.column("cn").to_pylist()
            for first, raw, lens in _pieces(b.column("seq").fill_null("")):
                ends = np.cumsum(lens)
                for i, (end, n) in enumerate(zip(ends.tolist(), lens.tolist())):
                    for own in range(0, n, size):
                        start = max(own - halo, 0)
                        text = raw[end - n + start : min(end - n + own + size + halo, end)].tobytes()
                        rows.append((names[first + i], own, start, n, len(text)))
                        texts.append(text)
                        held += len(text)
                        if held >= BLOB:
                            yield blob()
                            rows, texts, held = [], [], 0
        if rows:
            yield blob()

    return cut(contigs.select(F.col("cn").cast("bigint").alias("cn"), "seq").mapInArrow(run, PACKED))


def pack_reads(stranded: DataFrame) -> DataFrame:
    """Blobs of stranded reads (read_id of any type, st, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, held = [], [], 0

        def blob() -> pa.RecordBatch:
            return _blob(pa.Table.from_batches(rows).combine_chunks().to_batches()[0], b"".join(texts))

        for b in batches:
            for first, raw, lens in _pieces(b.column("seq").fill_null("")):
                ids = [b.column(c).slice(first, len(lens)) for c in ("read_id", "st")]
                rows.append(pa.RecordBatch.from_arrays([*ids, pa.array(lens.astype(np.int32))], names=["read_id", "st", "n"]))
                texts.append(raw.tobytes())
                held += len(raw)
                if held >= BLOB // 2:
                    yield blob()
                    rows, texts, held = [], [], 0
        if rows:
            yield blob()

    return cut(stranded.select("read_id", "st", "seq").mapInArrow(run, PACKED))


def _keys(raw: np.ndarray, lens: np.ndarray, seeds: Sequence[Seed]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per seed the places in `raw` where its windows of only A, C, G and T begin, within one text, and their keys."""
    code = BASE[raw]
    odd = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(code > 3, out=odd[1:])
    ends = np.cumsum(lens)[:-1, None]
    for s in seeds:
        m = len(raw) - s.span + 1
        if m < 1:
            yield np.zeros(0, np.int64), np.zeros(0, np.int32)
            continue
        fits = odd[s.span :] == odd[:m]
        over = (ends - np.arange(1, s.span)).ravel()  # windows that would run into the next text
        fits[over[(over >= 0) & (over < m)]] = False
        good = np.flatnonzero(fits)
        key = np.zeros(m, np.int32)
        for k, c in enumerate(s.pattern):
            if c == "1":
                key <<= 2
                key |= code[k : k + m]
        yield good, key[good]


class _Stretches:
    """Stretches of contigs; places are positions in their texts laid end to end, whole regions apart."""

    def __init__(self, meta: pa.Table, size: int) -> None:
        self.cn, self.own, self.start, self.len, self.n = (meta.column(c).to_numpy() for c in ("cn", "own", "start", "len", "n"))
        self.first = np.cumsum(self.n) - self.n
        room = (self.n + REGION - 1) // REGION + 1
        self.at = (np.cumsum(room) - room + 1) * REGION
        self.room = np.concatenate([[0], np.repeat(np.arange(len(room)), room)])
        self.size, self.split, self.owner = size, self.len > size, None

    def pick(self, a: int, b: int) -> _Stretches:
        cols = {c: pa.array(getattr(self, c)[a:b]) for c in ("cn", "own", "start", "len", "n")}
        return _Stretches(pa.table(cols), self.size)

    def of(self, p: np.ndarray) -> np.ndarray:
        if self.owner is None:
            self.owner = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        return self.owner[p]

    def holding(self, place: np.ndarray) -> np.ndarray:
        return self.room[place >> REGION_BITS]

    def is_own(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (x >= self.own[s]) & (x < self.own[s] + self.size)


def _chunks(packed: Iterator[tuple[pa.Table, np.ndarray]], size: int) -> Iterator[tuple[_Stretches, np.ndarray]]:
    """Whole stretches of about CHUNK bases together."""
    for meta, raw in packed:
        every = _Stretches(meta, size)
        a = 0
        while a < len(every.n):
            b = max(a + 1, int(np.searchsorted(every.first, every.first[a] + CHUNK)))
            part = every.pick(a, b)
            yield part, raw[every.first[a] : every.first[a] + part.n.sum()]
            a = b


def _own_keys(st: _Stretches, raw: np.ndarray, seeds: Sequence[Seed]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per seed stretch, position and key of the windows that begin in the stretches' own parts."""
    for p, key in _keys(raw, st.n, seeds):
        s = st.of(p)
        x = p - st.first[s] + st.start[s]
        if st.split.any():
            keep = st.is_own(s, x)
            s, x, key = s[keep], x[keep], key[keep]
        yield s, x, key


def heavy_keys(packed: DataFrame, seeds: Sequence[Seed], cutoff: int, stretch: int | None = None) -> Broadcast:
    """Bits per seed of the keys that occur more than `cutoff` times.

    Each task counts into a table over all keys; the tables are added up slice by slice. What reaches the driver and
    is broadcast has 4^weight bits a seed (2 MB at most), whatever the input."""
    size = stretch or STRETCH

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, some = [np.zeros(4**s.weight, np.uint32) for s in seeds], False
        for b in batches:
            for st, raw in _chunks(_unpack(b.column("meta"), b.column("data")), size):
                some = True
                for t, (_, _, key) in zip(tables, _own_keys(st, raw, seeds)):
                    np.add.at(t, key, np.uint32(1))
        for sn, t in enumerate(tables if some else []):
            np.minimum(t, cutoff + 1, out=t)
            for k in range(0, len(t), SLICE):
                part = t[k : k + SLICE]
                # a byte of the counts after the other, as far as there are any
                planes = [zlib.compress((part >> 8 * i).astype(np.uint8), 1) for i in range((int(part.max()).bit_length() + 7) // 8)]
                yield pa.RecordBatch.from_arrays([pa.array([sn], pa.int32()), pa.array([k // SLICE], pa.int32()), pa.array([planes], pa.list_(pa.binary()))], names=["sn", "part", "planes"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(min(SLICE, 4 ** seeds[t.column("sn")[0].as_py()].weight), np.int64)
        for planes in t.column("planes"):
            for i, x in enumerate(planes):
                total = total + (np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8).astype(np.int64) << 8 * i)
        return pa.table({"sn": t.column("sn").slice(0, 1), "part": t.column("part").slice(0, 1), "bits": pa.array([np.packbits(total > cutoff, bitorder="little").tobytes()], pa.binary())})

    rows = packed.mapInArrow(count, "sn int, part int, planes array<binary>").groupBy("sn", "part").applyInArrow(add, "sn int, part int, bits binary").collect()
    bits = [b"".join(r["bits"] for r in sorted((r for r in rows if r["sn"] == sn), key=lambda r: r["part"])) or bytes(max(1, 4**s.weight // 8)) for sn, s in enumerate(seeds)]
    return packed.sparkSession.sparkContext.broadcast([np.frombuffer(b, np.uint8) for b in bits])


def _is_heavy(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (bits[key >> 3] >> (key & 7).astype(np.uint8) & 1).astype(bool)


def light_postings(contigs: DataFrame, seeds: Sequence[Seed], cutoff: int, stretch: int | None = None) -> DataFrame:
    """cn, sn, postings, pos_sum: the postings of each contig whose keys occur at most `cutoff` times in all contigs."""
    size = stretch or STRETCH
    packed = pack_contigs(contigs, stretch=size)
    heavy = heavy_keys(packed, seeds, cutoff, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for st, raw in _chunks(_unpack(b.column("meta"), b.column("data")), size):
                for sn, (s, x, key) in enumerate(_own_keys(st, raw, seeds)):
                    light = ~_is_heavy(heavy.value[sn], key)
                    s, x = s[light], x[light]
                    n = np.bincount(s, minlength=len(st.n))
                    # positions and their number in a stretch keep the sum far below 2^53
                    total = np.bincount(s, x, len(st.n)).astype(np.int64)
                    k = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(st.cn[k]), pa.array(np.full(len(k), sn, np.int32)), pa.array(n[k]), pa.array(total[k])], names=["cn", "sn", "postings", "pos_sum"])

    return packed.mapInArrow(run, "cn bigint, sn int, postings bigint, pos_sum bigint").groupBy("cn", "sn").agg(F.sum("postings").alias("postings"), F.sum("pos_sum").alias("pos_sum"))


def _supported(a: np.ndarray, place_shift: int) -> np.ndarray:
    """Which of the sorted anchors lie in a region with two incidences, or at its edge next to one."""
    group = a >> (place_shift + REGION_BITS)  # read and region; stretches are whole regions apart
    near = ((a >> place_shift) & (REGION - 1)) < REGION_OVERLAP
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    g, which = group[head], np.repeat(np.arange(len(head)), np.diff(np.append(head, len(a))))
    own, edge = np.bincount(which), np.bincount(which, near).astype(np.int64)
    follows = np.concatenate([g[1:] == g[:-1] + 1, [False]])
    n = own + np.where(follows, np.append(edge[1:], 0), 0)
    # a region without anchors of its own may still have those at the edge of the next one
    before = np.where(np.concatenate([[False], follows[:-1]]), np.concatenate([[0], n[:-1]]), edge)
    return (n[which] >= 2) | near & (before[which] >= 2)


class _Reads:
    """The seeds of a block of stranded reads, by key."""

    def __init__(self, blobs: Iterator[tuple[pa.Table, np.ndarray]], seeds: Sequence[Seed], heavy: list[np.ndarray], longest: int) -> None:
        metas, raws = zip(*blobs)
        self.meta, raw = pa.concat_tables(metas).combine_chunks(), np.concatenate(raws)
        self.len = self.meta.column("n").to_numpy().astype(np.int64)
        if self.len.max(initial=0) > longest:
            raise ValueError(f"a read has more than {longest} bases")
        self.first = np.cumsum(self.len) - self.len
        row = np.repeat(np.arange(len(self.len), dtype=np.int32), self.len)
        self.y_bits, self.sn_bits = longest.bit_length(), len(seeds).bit_length()
        self.given = seeds
        self.seeds = []
        for (p, key), bits, s in zip(_keys(raw, self.len, seeds), heavy, seeds):
            light = ~_is_heavy(bits, key)
            p, key = p[light], key[light]
            begin = np.zeros(4**s.weight + 1, np.int32)
            np.add.at(begin[1:], key, np.int32(1))
            np.cumsum(begin, out=begin)
            both = key.astype(np.int64) << 32
            both |= p
            both.sort()
            both &= 0xFFFFFFFF
            r = row[both]
            self.seeds.append((begin, r, (both - self.first[r]).astype(np.int32)))
            del both, p, key

    def met(self, st: _Stretches, raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per seed the first entry and the number of entries that windows of some stretches meet, stretch and window."""
        met = []
        for (begin, _, _), (p, key) in zip(self.seeds, _keys(raw, st.n, self.given)):
            lo = begin[key]
            n = begin[key + 1] - lo
            some = np.flatnonzero(n)
            p = p[some]
            met.append((lo[some], n[some], st.of(p), p))
        return met

    def pairs(self, sn: int, lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """About MOST anchors at a time: which windows they are of, their numbers, and their entries."""
        ends, a = np.cumsum(n, dtype=np.int64), 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST)))
            m = n[a:b]
            skip = ends[a:b] - m - (ends[a - 1] if a else 0)
            yield slice(a, b), m, np.repeat(lo[a:b] - skip, m) + np.arange(int(m.sum(dtype=np.int64)))
            a = b

    def anchors(self, st: _Stretches, raw: np.ndarray) -> Iterator[_Anchors]:
        """The anchors on some stretches, all of a read together, about MOST at a time."""
        place_bits = int(st.at[-1] + st.n[-1]).bit_length()
        shift = self.y_bits + self.sn_bits
        if len(self.len).bit_length() + place_bits + shift > 63:
            raise ValueError("a block of reads or contigs is too large")
        met = self.met(st, raw)
        passes = 1 + sum(int(n.sum(dtype=np.int64)) for _, n, _, _ in met) // MOST
        for j in range(passes):
            got = []
            for sn, ((lo, n, s, p), (_, rows, ys)) in enumerate(zip(met, self.seeds)):
                place = (p - st.first[s] + st.at[s]) << shift | sn
                for k, m, e in self.pairs(sn, lo, n):
                    r, y, at = rows[e], ys[e], np.repeat(place[k], m)
                    if passes > 1:
                        keep = r % passes == j
                        r, y, at = r[keep], y[keep], at[keep]
                    at |= r.astype(np.int64) << (place_bits + shift)
                    at |= y.astype(np.int64) << self.sn_bits
                    got.append(at)
            if got:
                yield _Anchors(np.concatenate(got), self, st, place_bits)

    def rows(self, r: np.ndarray, rest: dict, out: pa.Schema) -> pa.Table:
        at = pa.array(r)
        cols = {c: self.meta.column(c).take(at) for c in ("read_id", "st")} | {k: pa.array(v) for k, v in rest.items()}
        return pa.Table.from_arrays([cols[f.name] if f.name == "read_id" else cols[f.name].cast(f.type) for f in out], names=out.names)


class _Anchors:
    """Anchors as numbers of read, place, y and seed."""

    def __init__(self, code: np.ndarray, reads: _Reads, st: _Stretches, place_bits: int) -> None:
        self.code, self.reads, self.st, self.place_bits, self.shift = code, reads, st, place_bits, reads.y_bits + reads.sn_bits

    def fields(self) -> tuple[np.ndarray, ...]:
        """Read, stretch, x, y and seed."""
        place = (self.code >> self.shift) & ((1 << self.place_bits) - 1)
        s = self.st.holding(place)
        y = (self.code >> self.reads.sn_bits) & ((1 << self.reads.y_bits) - 1)
        return self.code >> (self.place_bits + self.shift), s, place - self.st.at[s] + self.st.start[s], y, self.code & ((1 << self.reads.sn_bits) - 1)

    def keep(self, support: bool, window_pct: int | None) -> None:
        """Those supported by their region; those with another one of their read and contig within a window of the read."""
        self.code.sort()
        if support and len(self.code):
            self.code = self.code[_supported(self.code, self.shift)]
        if window_pct is not None and len(self.code):
            reach = self.reads.len * window_pct // 100 + 1
            close = np.diff(self.code >> self.shift) <= reach[self.code[1:] >> (self.place_bits + self.shift)]
            self.code = self.code[np.append(False, close) | np.append(close, False)]


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


Work = Callable[["_Reads", Iterator[tuple[_Stretches, np.ndarray]], pa.Schema], Iterator[pa.Table]]


def _cells(stranded: DataFrame, contigs: DataFrame, seeds: Sequence[Seed], cutoff: int, longest: int, reach: int, work: Work, out: str, stretch: int | None) -> DataFrame:
    """What `work` makes of every block of reads and every block of contigs."""
    size = stretch or STRETCH
    # a decision reaches two regions (support) from an anchor of an island or window, which reaches a read and `reach`
    c, r = pack_contigs(contigs, REGION * (5 + (longest + reach) // REGION), size), pack_reads(stranded)
    heavy = heavy_keys(c, seeds, cutoff, size)
    (c_bases, c_blobs), (r_bases, _) = (x.agg(F.coalesce(F.sum("bases"), F.lit(0)), F.count(F.lit(1))).first() for x in (c, r))
    rows = max(1, -(-r_bases // READ_BASES))
    parts = int(stranded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = max(1, -(-c_bases // BASES), min(-(-2 * parts // rows), c_blobs))

    def dealt(n: int) -> Column:
        # the blobs are written, so that their numbers stand; they are dealt out in turn
        i = F.monotonically_increasing_id()
        return F.pmod(F.shiftright(i, 33) + i.bitwiseAND((1 << 33) - 1), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = c.select("meta", "data", dealt(cols).alias("cb")).select(F.lit(0).alias("kind"), "cb", every(rows).alias("rb"), "meta", "data")
    right = r.select("meta", "data", dealt(rows).alias("rb")).select(F.lit(1).alias("kind"), every(cols).alias("cb"), "rb", "meta", "data")
    schema = T.StructType([stranded.schema["read_id"], stranded.schema["st"], *T.StructType.fromDDL(out).fields])
    arrow = to_arrow_schema(schema)

    def cell(t: pa.Table) -> pa.Table:
        ours, theirs = (t.filter(pc.equal(t.column("kind"), k)) for k in (0, 1))
        if not len(ours) or not len(theirs):
            return arrow.empty_table()
        reads = _Reads(_unpack(theirs.column("meta"), theirs.column("data")), seeds, heavy.value, longest)
        got = list(work(reads, _chunks(_unpack(ours.column("meta"), ours.column("data")), size), arrow))
        return pa.concat_tables(got) if got else arrow.empty_table()

    # a block pair a task: neither hashes nor adaptive coalescing put several into one
    both = left.unionByName(right).select("*", (F.col("cb") * rows + F.col("rb")).alias("cell"))
    return both.repartitionById(rows * cols, "cell").groupBy("cell").applyInArrow(cell, schema)


def anchor_sums(stranded: DataFrame, contigs: DataFrame, seeds: Sequence[Seed], cutoff: int, longest: int, stretch: int | None = None) -> DataFrame:
    """read_id, st, anchors, contigs, x_sum, y_sum: the anchors of a stranded read, summed up where they are found."""

    def work(reads: _Reads, chunks: Iterator[tuple[_Stretches, np.ndarray]], out: pa.Schema) -> Iterator[pa.Table]:
        size, st = len(reads.len), None
        n, contigs_, x_sum, y_sum = (np.zeros(size, np.int64) for _ in range(4))
        for st, raw in chunks:
            count, seen = len(st.n), []
            for sn, (lo, m, s, p) in enumerate(reads.met(st, raw)):
                x = p - st.first[s] + st.start[s]
                if st.split.any():
                    own = st.is_own(s, x)
                    lo, m, s, x = lo[own], m[own], s[own], x[own]
                for k, each, e in reads.pairs(sn, lo, m):
                    r = reads.seeds[sn][1][e]
                    n += np.bincount(r, minlength=size)
                    # the sums of MOST anchors stay far below 2^53
                    x_sum += np.bincount(r, np.repeat(x[k].astype(np.float64), each), size).astype(np.int64)
                    y_sum += np.bincount(r, reads.seeds[sn][2][e], size).astype(np.int64)
                    seen.append(_distinct(r.astype(np.int64) * count + np.repeat(s[k], each)))
            met = _distinct(np.concatenate(seen))
            r, s = met // count, met % count
            whole = ~st.split[s]
            contigs_ += np.bincount(r[whole], minlength=size)
            r, s = r[~whole], s[~whole]
            if len(r):  # a contig in several stretches counts once, in the end
                zero = np.zeros(len(r), np.int64)
                yield reads.rows(r, {"cn": st.cn[s], "n": zero, "contigs": zero, "x_sum": zero, "y_sum": zero}, out)
        k = np.flatnonzero(n)
        yield reads.rows(k, {"cn": pa.nulls(len(k), pa.int64()), "n": n[k], "contigs": contigs_[k], "x_sum": x_sum[k], "y_sum": y_sum[k]}, out)

    sums = _cells(stranded, contigs, seeds, cutoff, longest, 0, work, "cn bigint, n bigint, contigs bigint, x_sum bigint, y_sum bigint", stretch)
    sums = sums.groupBy("read_id", "st", "cn").agg(*(F.sum(c).alias(c) for c in ("n", "contigs", "x_sum", "y_sum")))
    return sums.groupBy("read_id", "st").agg(F.sum("n").alias("anchors"), (F.sum("contigs") + F.count("cn")).alias("contigs"), F.sum("x_sum").alias("x_sum"), F.sum("y_sum").alias("y_sum"))


def supported_anchors(stranded: DataFrame, contigs: DataFrame, seeds: Sequence[Seed], cutoff: int, longest: int, stretch: int | None = None) -> DataFrame:
    """read_id, st, cn, x, y, sn of anchors in a region with two incidences, or at its edge next to one."""

    def work(reads: _Reads, chunks: Iterator[tuple[_Stretches, np.ndarray]], out: pa.Schema) -> Iterator[pa.Table]:
        for st, raw in chunks:
            for a in reads.anchors(st, raw):
                a.keep(True, None)
                r, s, x, y, sn = a.fields()
                own = st.is_own(s, x)
                yield reads.rows(r[own], {"cn": st.cn[s[own]], "x": x[own], "y": y[own], "sn": sn[own]}, out)

    return _cells(stranded, contigs, seeds, cutoff, longest, 0, work, "cn bigint, x bigint, y int, sn int", stretch)


def islands(stranded: DataFrame, contigs: DataFrame, seeds: Sequence[Seed], cutoff: int, longest: int, window_pct: int, support: bool, least: tuple[int, int] | None, stretch: int | None = None) -> DataFrame:
    """Diagonal islands (anchors.diagonal_islands) with read_len and contig_len, of the supported anchors or of all.

    With `least`, the threshold of windows in per cent and the score of a match, only those that can make a candidate
    window: long enough by themselves, or with another island of the read within a window. An anchor without another
    one within a window is no island of these, and ends none."""
    reach = longest * window_pct // 100
    span = max(s.span for s in seeds)

    def work(reads: _Reads, chunks: Iterator[tuple[_Stretches, np.ndarray]], out: pa.Schema) -> Iterator[pa.Table]:
        for st, raw in chunks:
            for a in reads.anchors(st, raw):
                a.keep(support, window_pct if least else None)
                if not len(a.code):
                    continue
                r, s, x, y, _ = a.fields()
                slot = (x - y) % reads.len[r]
                order = np.lexsort((y, x, s, slot, r))
                r, s, x, y, slot = r[order], s[order], x[order], y[order], slot[order]
                fresh = np.append(True, np.diff(r).astype(bool) | np.diff(slot).astype(bool) | np.diff(s).astype(bool) | np.diff(x - y).astype(bool))
                head = np.flatnonzero(fresh)
                weight = np.diff(np.append(head, len(x)))
                first, last, low = np.minimum.reduceat(x, head), np.maximum.reduceat(x, head), np.minimum.reduceat(y, head)
                r, s = r[head], s[head]
                n, total = reads.len[r], st.len[s]
                keep = st.is_own(s, first)
                if least:
                    pct, match = least
                    w = n * window_pct // 100
                    place = (r << a.place_bits) + first - st.start[s] + st.at[s]
                    at = np.argsort(place)
                    close = np.diff(place[at]) <= w[at[1:]] + 1
                    near = np.zeros(len(at), bool)
                    near[at] = np.append(False, close) | np.append(close, False)
                    need = pct * np.minimum(n, np.minimum(w, total)) * match // 100
                    keep &= near | ((weight > 1) & ((last + span - first) * match >= need))
                k = np.flatnonzero(keep)
                yield reads.rows(r[k], {"cn": st.cn[s[k]], "x": first[k], "y": low[k], "length": (last + span - first)[k], "weight": weight[k], "read_len": n[k], "contig_len": total[k]}, out)

    # windows read the islands several times: the blocks meet once
    return cut(_cells(stranded, contigs, seeds, cutoff, longest, reach, work, "cn bigint, x bigint, y int, length int, weight int, read_len int, contig_len int", stretch))
