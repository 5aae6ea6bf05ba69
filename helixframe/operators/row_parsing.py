"""Header-described delimited rows: valid rows typed, failing rows with the reason."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from helixframe.operators.ranking import last_known

# What a field may look like.
# A quoted field doubles its inner quotes and may hold tabs; a plain one holds neither. Quantifiers are
# possessive, so that no line is gone over twice.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
PLAIN = r'[^"\t]*+'
FIELD = rf"(?:{QUOTED}|{PLAIN})"
EDIT = r"(?:[0-9ACGTNacgtnxX\-]++|\([ACGTUMRWSYKVHDBNXacgtumrwsykvhdbnx]+\))++"
MARK, HEADER = ">", "#FORMAT:"


def at_most(n: int) -> str:
    """Pattern of the decimal numbers from 0 to n, with any number of leading zeros."""
    d = str(n)
    below = [rf"{d[:k]}[0-{int(c) - 1}][0-9]{{{len(d) - k - 1}}}" for k, c in enumerate(d) if c > "0"]
    return rf"(?:0++(?![0-9])|0*+(?:{d}|{'|'.join(below)}|[0-9]{{1,{max(len(d) - 1, 1)}}})(?![0-9]))"


INTEGER = rf"(?:-{at_most(1 << 31)}|{at_most((1 << 31) - 1)})"
#: typed columns, in the order in which they give a row its reason, with the pattern of their values and the reason
TYPED = {"score": (INTEGER, "score"), "editstring": (EDIT, "edit")}


def wrapped(pattern: str) -> str:
    """A typed value with optional surrounding spaces and optional quotes around all of it."""
    return rf'(?:" *{pattern} *"| *{pattern} *)'


class Schema:
    """The patterns generated from the column names of a header line.

    `whole` is the anchored pattern of a valid row and captures its fields. Prefix pattern k stands for the first k
    fields, each ended by a tab or the end of the row: as a row that matches prefix k matches all shorter
    ones, the first broken field is the one after the longest matching prefix.
    """

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.whole = self._compile(self._fields(TYPED), r"\Z", capture=True)
        self.prefixes: dict[tuple[frozenset, int], re.Pattern] = {}

    def _fields(self, typed) -> list[str]:
        return [wrapped(TYPED[c][0]) if c in typed else FIELD for c in self.columns]

    @staticmethod
    def _compile(fields: list[str], end: str, capture: bool = False) -> re.Pattern:
        # a line end inside a field is a character like any other
        return re.compile(r"\A" + r"\t".join(f"({f})" if capture else f for f in fields) + end, re.S)

    def longest_prefix(self, body: str, typed: frozenset) -> int:
        """How many of the first fields are sound, those of the columns `typed` by their own patterns."""
        fields, lo, hi = self._fields(typed), 0, len(self.columns)
        while lo < hi:
            k = (lo + hi + 1) // 2
            p = self.prefixes.get((typed, k))
            if p is None:
                p = self.prefixes[typed, k] = self._compile(fields[:k], r"(?=\t|\Z)")
            if p.match(body):
                lo = k
            else:
                hi = k - 1
        return lo

    def broken(self, body: str) -> tuple[str, int]:
        """Reason of a row that `whole` doesn't match, and its first broken field by that reason (from 1)."""
        n = self.longest_prefix(body, frozenset())
        if not _SOUND.match(body):
            # the broken quote may stand behind the last column that the header names
            return "quoting", min(n, len(self.columns)) + 1
        if n < len(self.columns) or body.count("\t") - _tabs_within(body) != n - 1 or not n:
            return "columns", n + 1
        for c, (_, why) in TYPED.items():
            if c in self.columns and (k := self.longest_prefix(body, frozenset([c]))) < n:
                return why, k + 1
        raise AssertionError("a row fails by no field")


_SOUND = re.compile(rf"\A{FIELD}(?:\t{FIELD})*+\Z", re.S)
_QUOTED_FIELD = re.compile(rf"(?:\A|(?<=\t)){QUOTED}(?=\t|\Z)", re.S)


def _tabs_within(body: str) -> int:
    """Tabs inside the quoted fields of a soundly quoted row."""
    return sum(m.count("\t") for m in _QUOTED_FIELD.findall(body)) if '"' in body else 0


@lru_cache(maxsize=1024)
def schema_of(header: str | None) -> Schema:
    return Schema((header or "").lower().split())


def unquoted(raw: Column) -> Column:
    """Value of a field: outer quotes off, doubled ones single."""
    return F.when(raw.startswith('"'), F.replace(F.substring(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0))), F.lit('""'), F.lit('"'))).otherwise(raw)


def classify(df: DataFrame, file: str = "file_no", order: str = "line_no", line: str = "line") -> DataFrame:
    """Hit rows of header-described text with `cols` (their columns), `raw` (the fields of a valid row), `reason` and
    `broken` (the number of the first field that is broken by that reason; both null for a valid row).

    The columns of a row are those of the nearest header line at or before it in its file; a file of any
    length is taken in spans of lines. A row that matches the whole-row pattern of its schema is valid, and just that
    one; the others go through prefix patterns one field longer each time, of which the first that doesn't
    match names the broken field: first with fields of any type ('quoting', 'columns'), then with the typed
    columns ('score', also beyond 32 bits, before 'edit'). The patterns of a schema are generated once a task
    and the lines go through them in Arrow batches, as a pattern that changes with the row would be
    compiled anew for every row in the JVM.
    Defined cases: lines without the mark (null and empty ones too) are no rows; a row before any
    header of its file has no columns and fails as 'columns' unless its quoting is broken; repeated
    lines are repeated rows; a schema without score or edit can't fail by them, one that names a column
    twice checks each; other columns of the input come out as they are, but for those named like one of the four.
    """
    text = F.col(line)
    head = F.when(text.startswith(HEADER), F.trim(F.substring(text, len(HEADER) + 1, 1 << 20)))
    marked = df.where(text.startswith(MARK) | text.startswith(HEADER))
    rows = last_known(marked, [file], order, head, "__format").where(text.startswith(MARK))
    own = T.StructType.fromDDL("cols array<string>, raw array<string>, reason string, broken int")
    given = [f for f in df.schema.fields if f.name not in own.names]
    kept, out = [f.name for f in given], T.StructType([*given, *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, raw, reason, broken = [], [], [], []
            for head, t in zip(b.column("__format").to_pylist(), b.column(line).to_pylist()):
                s, body = schema_of(head), t[len(MARK) :]
                m = s.whole.match(body) if s.columns else None
                why, at = (None, None) if m else s.broken(body)
                cols.append(s.columns)
                raw.append(m.groups() if m else None)
                reason.append(why)
                broken.append(at)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(cols, pa.list_(pa.string())), pa.array(raw, pa.list_(pa.string())), pa.array(reason, pa.string()), pa.array(broken, pa.int32())], names=out.names)

    return rows.select(*kept, "__format").mapInArrow(run, out)


def failures(df: DataFrame, row_id: str = "line_id", **names: str) -> DataFrame:
    """row_id and reason of every failing hit row (see classify)."""
    return classify(df, **names).where(F.col("reason").isNotNull()).select(row_id, "reason")


# The named columns of a native hit row and their types.
NATIVE = {
    "readname": "string", "contigname": "string", "strand": "string", "contigstart": "bigint", "contigend": "bigint",
    "readstart": "int", "readend": "int", "readlength": "int", "score": "int", "editstring": "string",
    "readsequence": "string", "normodds": "double", "pgenome": "double", "pchance": "double",
}


def native_hits(df: DataFrame, row_id: str = "line_id", **names: str) -> DataFrame:
    """The valid hit rows as typed native hits: row_id and the columns of NATIVE.

    A column that the row's header doesn't name is null, as is a number that can't be read: only the
    reasons of classify make a row fail.
    """
    ok = classify(df, **names).where(F.col("reason").isNull())
    named = F.map_from_entries(F.arrays_zip(F.transform("cols", lambda c: c).alias("key"), F.col("raw").alias("value")))
    first = F.array_distinct("cols")
    ok = ok.withColumn("__m", F.when(F.size(first) == F.size("cols"), named))
    got = {c: F.trim(unquoted(F.coalesce(F.col("__m")[c], F.get(F.col("raw"), (F.array_position("cols", c) - 1).cast("int"))))) for c in NATIVE}
    return ok.select(row_id, *(got[c].alias(c) if t == "string" else got[c].try_cast(t).alias(c) for c, t in NATIVE.items()))
