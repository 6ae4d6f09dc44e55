"""Column functions over base strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: The three stop codons of the standard genetic code.
STOPS = ("TAA", "TAG", "TGA")


def category(seq: Column) -> Column:
    """Bases as digits 0 to 3 in the order ACGT, anything else 4, case folded."""
    return F.regexp_replace(F.translate(F.upper(seq), BASES, "0123"), "[^0-3]", "4")


def soft_masked(seq: Column) -> Column:
    """1 for every lower-case base, else 0."""
    return F.regexp_replace(F.regexp_replace(seq, "[acgt]", "1"), "[^1]", "0")


def reverse_complement(seq: Column) -> Column:
    """Case is kept; other characters stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def oriented(seq: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def codons(seq: Column) -> Column:
    """Complete codons from the first base, upper case; an empty array below three bases."""
    return F.coalesce(F.regexp_extract_all(F.upper(seq), F.lit("(?s).{3}"), 0), F.array().cast("array<string>"))


def amino_letters(stops: tuple[str, ...] = STOPS) -> dict[str, str]:
    """The standard code by rule: the letters of all codons in TCAG order."""
    letters = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    order = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    return dict(zip(order, letters, strict=True)) | {s: "*" for s in stops}


def translate(seq: Column) -> Column:
    """Amino-acid letters of the complete codons; X for one with an unknown base."""
    code = F.create_map(*[F.lit(x) for kv in amino_letters().items() for x in kv])
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def is_complete_coding(cds: Column, least: int = 61) -> Column:
    """Strict coding test of an oriented CDS string: long enough, whole codons, a stop at
    the end and none before it. Null is not complete."""
    parts, n = codons(cds), F.length(cds)
    inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    stop = lambda c: c.isin(*STOPS)
    return F.coalesce((n >= least) & (n % 3 == 0) & stop(F.upper(F.right(cds, F.lit(3)))) & ~F.exists(inner, stop), F.lit(False))


def terminal_codons(cds: Column) -> Column:
    """struct(start, stop): first and last three bases; '.' below three, null without a sequence."""
    short = F.length(cds) < 3

    def end(x):
        return F.when(cds.isNull(), F.lit(None)).when(short, F.lit(".")).otherwise(x)

    return F.struct(end(F.left(cds, F.lit(3))).alias("start"), end(F.right(cds, F.lit(3))).alias("stop"))


def kmers(seq: Column, k: int) -> Column:
    """All overlapping k-mers in order, found in one walk along the sequence."""
    found = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)
    return F.coalesce(found, F.array().cast("array<string>"))


def crop(seq: Column, n: Column, strand: Column) -> Column:
    """The first n bases of a plus window, the last n of a minus one."""
    return F.when(strand == "-", F.right(seq, n)).otherwise(F.left(seq, n))


def trim_flanks(values: Column, flank: int) -> Column:
    """An array without its flanks; an error if nothing would be left."""
    n = F.size(values)
    fits = F.slice(values, flank + 1, n - 2 * flank)
    return F.when(n > 2 * flank, fits).otherwise(F.raise_error(F.lit("the window is no longer than its flanks")))
