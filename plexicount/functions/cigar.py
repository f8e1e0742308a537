"""Positions from CIGAR strings, without leaving generated code for a parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_clip(cigar: Column) -> Column:
    """Length of the first operation if it is a soft clip; a hard clip before it hides it."""
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"^(\d+)S", 1), F.lit("")).cast("long"), F.lit(0))


def trailing_clip(cigar: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(cigar, r"(\d+)S$", 1), F.lit("")).cast("long"), F.lit(0))


def reference_length(cigar: Column) -> Column:
    spans = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def group_position(pos: Column, cigar: Column, reverse: Column) -> Column:
    """Where the read's 5' end lies: clips undone; of a reverse read, its end."""
    cigar = F.coalesce(cigar, F.lit(""))
    return F.when(reverse, pos + reference_length(cigar) + trailing_clip(cigar)).otherwise(pos - leading_clip(cigar))
