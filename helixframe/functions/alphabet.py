"""Letter- and colour-space sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# IUPAC letters with their complements, and the codes of the colour alphabet.
LETTERS, COMPLEMENTS = "ACGTUMRWSYKVHDBNX", "TGCAAKYWSRMBDHVNN"
CODED, CODES = "ACGTU", "01233"
AMBIGUOUS = "[^ACGTacgt]"


def is_rna(seq: Column) -> Column:
    """U without T. Null gives null."""
    return seq.rlike("[Uu]") & ~seq.rlike("[Tt]")


def reverse_complement(seq: Column, rna: bool = False) -> Column:
    """Reverse complement with ambiguity codes; letter case is kept, other characters too."""
    c = COMPLEMENTS.replace("T", "U") if rna else COMPLEMENTS
    return F.reverse(F.translate(seq, LETTERS + LETTERS.lower(), c + c.lower()))


def reverse_complement_text(seq: Column) -> Column:
    """Reverse complement of A, C, G and T only, which come out in lower case; the rest stays."""
    return F.reverse(F.translate(seq, "ACGTacgt", "tgcatgca"))


def bases_of(text: Column) -> Column:
    """The bases among the letters of any text."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", ""))


def mask_ambiguous(seq: Column) -> Column:
    """Upper case with every letter but A, C, G and T as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def illegal(seq: Column) -> Column:
    """Whether a letter-space sequence has a character outside its alphabet."""
    return seq.rlike(f"[^{LETTERS}{LETTERS.lower()}.\\-]")


def codes(seq: Column) -> Column:
    """Letters as colour-alphabet codes, anything ambiguous as 4."""
    return F.regexp_replace(F.translate(F.upper(seq), CODED, CODES), "[^0123]", "4")


def letters_to_colours(seq: Column, first: str = "T") -> Column:
    """Colour of each letter with the one before it (`first` before the first); ambiguous ones give 4."""
    d = codes(seq)
    prev = F.concat(F.lit(CODES[CODED.index(first)]), F.substring(d, F.lit(1), F.greatest(F.length(d) - 1, F.lit(0))))
    one = lambda a, b: F.when((a == "4") | (b == "4"), "4").otherwise(a.cast("int").bitwiseXOR(b.cast("int")).cast("string"))
    pairs = F.zip_with(F.split(prev, ""), F.split(d, ""), one)
    return F.when(F.length(seq) == 0, "").otherwise(F.array_join(pairs, ""))


def colours_to_letters(colours: Column, first: str = "T") -> Column:
    """Letters of a colour read: every base follows from the one before; an unknown colour makes it and all
    later ones N."""
    start = F.struct(F.lit("").alias("s"), F.lit(int(CODES[CODED.index(first)])).alias("b"))

    def step(acc: Column, c: Column) -> Column:
        ok = (acc["b"] < 4) & c.isin("0", "1", "2", "3")
        b = F.when(ok, acc["b"].bitwiseXOR(F.coalesce(c.try_cast("int"), F.lit(0)))).otherwise(4)
        return F.struct(F.concat(acc["s"], F.substring(F.lit("ACGTN"), b + 1, F.lit(1))).alias("s"), b.alias("b"))

    return F.when(F.length(colours) == 0, "").otherwise(F.aggregate(F.split(colours, ""), start, step)["s"])


def reverse_colours(colours: Column, last_letter: Column) -> Column:
    """Colour read of the reverse complement: colours reversed, the first re-derived from the last letter
    of the read (its complement follows the leading T)."""
    lead = F.substring(letters_to_colours(reverse_complement(last_letter)), F.lit(1), F.lit(1))
    return F.concat(lead, F.reverse(F.substring(colours, F.lit(2), F.length(colours))))


def slice_circular(seq: Column, first: Column, last: Column) -> Column:
    """Bases first..last (1-based, inclusive) of a circular sequence; positions below 1 wrap round."""
    n = F.length(seq)
    inner = F.substring(seq, F.greatest(first, F.lit(1)), last - F.greatest(first, F.lit(1)) + 1)
    return F.when(first < 1, F.concat(F.substring(seq, n + first, F.lit(1) - first), inner)).otherwise(inner)


def trim(seq: Column, front: Column | int, end: Column | int) -> Column:
    front, end = (x if isinstance(x, Column) else F.lit(x) for x in (front, end))
    return F.substring(seq, front + 1, F.greatest(F.length(seq) - front - end, F.lit(0)))


def trailing(qual: Column, letter: str = "B") -> Column:
    """Length of the run of a letter at the end of a quality string."""
    return F.length(qual) - F.length(F.regexp_replace(qual, f"{letter}+$", ""))


def quality_values(qual: Column, offset: int) -> Column:
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def average_quality(qual: Column, read_len: Column, offset: int) -> Column:
    """Sum of the quality values over the read length, as integer division."""
    total = F.aggregate(quality_values(qual, offset), F.lit(0), lambda a, x: a + x)
    return F.when(read_len > 0, F.floor(total / read_len)).cast("int")


def crossover_scores(qual: Column, offset: int, alpha: float, crossover: int) -> Column:
    """Per-colour crossover score from the error probability, held within [2 * crossover, -1]."""
    p = lambda q: F.when(q <= 0, 0.99999999).when(q >= 250, 1e-25).otherwise(F.pow(F.lit(10.0), -q / 10.0))
    score = lambda q: (F.lit(alpha) * F.ln(p(q) / 3.0) / F.ln(F.lit(2.0))).cast("int")
    return F.transform(quality_values(qual, offset), lambda q: F.greatest(F.least(score(q), F.lit(-1)), F.lit(2 * crossover)))


def requality(qual: Column, offset_in: int, offset_out: int = 33, reverse: bool = False) -> Column:
    q = F.array_join(F.transform(quality_values(qual, offset_in), lambda x: F.chr(F.greatest(x, F.lit(0)) + offset_out)), "")
    return F.reverse(q) if reverse else q


def window_length(read_len: Column, spec: str) -> Column:
    """'140%' (or '1.4'-like percentages with a dot) of the read length, or an absolute number."""
    if "%" in spec or "." in spec:
        return F.floor(read_len * float(spec.rstrip("%")) / 100).cast("int")
    return F.lit(int(spec))
