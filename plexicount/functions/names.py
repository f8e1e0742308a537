"""Read names: barcodes written into them and read from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_char(separator: str) -> str:
    """Only the first character of a separator counts; none means ``_``."""
    return separator[:1] or "_"


def read_name(header: Column) -> Column:
    return F.substring_index(header, " ", 1)


def comment(header: Column) -> Column:
    """What follows the first space, or null."""
    at = F.instr(header, " ")
    return F.when(at > 0, F.substring(header, at + 1, F.length(header)))


def strip_pair_suffix(name: Column) -> Column:
    return F.regexp_replace(name, "/[12]$", "")


def build_header(header: Column, cell: Column, umi: Column, separator: str = "_", strip_suffix: bool = False) -> Column:
    """NAME[_CELL]_UMI[ COMMENT]; an empty cell is left out."""
    sep = F.lit(first_char(separator))
    name = strip_pair_suffix(read_name(header)) if strip_suffix else read_name(header)
    with_cell = F.when(F.coalesce(cell, F.lit("")) != "", F.concat(name, sep, cell)).otherwise(name)
    return F.concat(with_cell, sep, umi, F.coalesce(F.concat(F.lit(" "), comment(header)), F.lit("")))


def umi_from_name(name: Column, separator: str = "_") -> Column:
    """What follows the last separator; the whole name if there is none."""
    return F.substring_index(name, first_char(separator), -1)


def _last_field(name: Column, prefix: str) -> Column:
    fields = F.filter(F.split(name, ":"), lambda x: F.startswith(x, F.lit(prefix)))
    return F.when(F.size(fields) > 0, F.substring(F.element_at(fields, -1), len(prefix) + 1, 1 << 30))


def umi_field(name: Column) -> Column:
    """The last ``UMI_`` field of a colon-separated name; empty if there is none."""
    return F.coalesce(_last_field(name, "UMI_"), F.lit(""))


def cell_field(name: Column) -> Column:
    """The last ``CELL_`` field; null if there is none."""
    return _last_field(name, "CELL_")


def tab_barcodes(name: Column, separator: str = "_", per_cell: bool = False) -> tuple[Column, Column]:
    """(umi, cell) of a table's read name: the last part, and the one before it."""
    parts = F.split(name, re.escape(first_char(separator)))
    cell = F.when(F.size(parts) >= 2, F.element_at(parts, -2)) if per_cell else F.lit(None).cast("string")
    return F.element_at(parts, -1), cell


def tag(tags: Column, name: str) -> Column:
    """The value of a string tag; tags of other types count as missing."""
    found = F.element_at(tags, F.lit(name))
    return F.when(found["type"] == "Z", found["value"])
