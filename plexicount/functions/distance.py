"""Distances between short strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What strings of unequal length are apart.
FAR = 4294967295


def hamming(a: Column, b: Column) -> Column:
    """Differing positions; FAR for unequal lengths.  Any alphabet, any length."""
    places = F.sequence(F.lit(1), F.length(a))
    differ = F.aggregate(places, F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(FAR)).when(F.length(a) == 0, F.lit(0)).otherwise(differ).cast("long")


def packed(s: Column) -> Column:
    """Two bits a base, for strings of at most 31 of A, C, G and T."""
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long")


def packed_hamming(a: Column, b: Column) -> Column:
    """Of two packed strings of one length: stays in generated code."""
    z = a.bitwiseXOR(b)
    return F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def masks(s: Column) -> Column:
    """The string with each position in turn masked.  Two strings of one length share a
    mask exactly if they differ in at most one position."""
    one = lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.lit("*"), F.substring(s, i + 1, F.length(s)))
    return F.when(F.length(s) == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.length(s)), one))


def blocks(s: Column, threshold: int) -> Column:
    """threshold + 1 numbered blocks: strings of one length that differ in at most
    ``threshold`` positions agree in one of them."""
    n = threshold + 1
    bound = lambda k: F.floor(F.length(s) * k / n).cast("int")
    return F.array(*[F.concat(F.lit(f"{k}:"), F.length(s).cast("string"), F.lit(":"), F.substring(s, bound(k) + 1, bound(k + 1) - bound(k))) for k in range(n)])


def prefix_edit_distance(a: Column, b: Column) -> Column:
    """Smallest edit distance of ``a`` to a prefix of ``b``, the empty one included."""
    return F.array_min(F.transform(F.sequence(F.lit(0), F.length(b)), lambda k: F.levenshtein(a, F.substring(b, F.lit(1), k))))
