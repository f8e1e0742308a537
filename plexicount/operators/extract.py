"""Barcode extraction from reads: the four modes of pairing, filters, and corrections.

Every mode adds a ``status`` to each read (or pair), so one pass serves the output, the
reads that fell out and the run's counters.  Nothing is exchanged but for the join
of a pair's two files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.patterns import Expression, Parts, Slices, compile_pattern

OFFSETS = {"phred33": 33, "phred64": 64, "solexa": 59}
OUT, SHORT, UNMATCHED, QUALITY, BLACKLISTED, UNLISTED, BOTH = "output", "too_short", "no_match", "quality_filtered", "blacklisted", "whitelist_filtered", "both_matched"


class ExtractError(ValueError):
    """Options or inputs that can't be used together."""


@dataclass(frozen=True)
class ExtractOptions:
    pattern: str | None = None
    pattern2: str | None = None
    method: str = "string"
    three_prime: bool = False
    separator: str = "_"
    quality_threshold: int | None = None
    quality_encoding: str = "phred33"
    strip_suffix: bool = False

    def compiled(self, which: str = "pattern") -> Slices | Parts | Expression:
        pattern = getattr(self, which)
        if pattern is None:
            raise ExtractError(f"this mode needs {which}")
        return compile_pattern(pattern, self.method, self.three_prime)


def low_quality(quality: Column, options: ExtractOptions) -> Column:
    """Whether some base's quality is under the threshold, as one character class."""
    if not options.quality_threshold:
        return F.lit(False)
    if options.quality_encoding not in OFFSETS:
        raise ExtractError(f"quality encodings are {', '.join(OFFSETS)}")
    top = OFFSETS[options.quality_encoding] + options.quality_threshold - 1
    return F.coalesce(quality, F.lit("")).rlike(f"[\\x00-\\x{min(top, 255):02X}]")


def _judged(found: Column, seq: Column, pattern: Slices | Parts | Expression, options: ExtractOptions) -> Column:
    return F.when(pattern.too_short(seq), SHORT).when(found.isNull(), UNMATCHED).when(low_quality(found["umi_quality"], options), QUALITY).otherwise(OUT)


def extract(reads: DataFrame, options: ExtractOptions) -> DataFrame:
    """Single reads.  reads: ordinal, id, seq, qual.  Adds umi, cell, status; id, seq and qual are the new ones."""
    pattern = options.compiled()
    found = reads.withColumn("found", pattern.extract(F.col("seq"), F.col("qual")))
    judged = found.withColumn("status", _judged(F.col("found"), F.col("seq"), pattern, options))
    ok = F.col("status") == OUT
    header = names.build_header(F.col("id"), F.col("found.cell"), F.col("found.umi"), options.separator)
    return judged.select(
        "ordinal", F.when(ok, header).otherwise(F.col("id")).alias("id"), F.when(ok, F.col("found.seq")).otherwise(F.col("seq")).alias("seq"),
        F.when(ok, F.col("found.qual")).otherwise(F.col("qual")).alias("qual"), F.col("found.umi").alias("umi"), F.col("found.cell").alias("cell"), "status",
    )


def zip_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """ordinal, r1, r2 (structs) of two files read in step.  Raises where one is longer."""
    pack = lambda df, name: df.select(F.col("ordinal").alias(f"{name}_ordinal"), F.struct("id", "seq", "qual").alias(name))
    joined = pack(first, "r1").join(pack(second, "r2"), F.col("r1_ordinal") == F.col("r2_ordinal"), "full_outer")
    checked = F.when(F.col("r1").isNull() | F.col("r2").isNull(), F.raise_error(F.lit("the two files have different numbers of reads"))).otherwise(F.col("r1_ordinal"))
    return joined.select(checked.cast("long").alias("ordinal"), "r1", "r2")


def reconcile_pairs(first: DataFrame, second: DataFrame, strip_suffix: bool = False) -> DataFrame:
    """Pairs by read name: the second file may have more reads.  The n-th read of a name meets the n-th."""
    from pyspark.sql import Window

    def named(df: DataFrame, side: str) -> DataFrame:
        name = names.read_name(F.col("id"))
        keyed = df.select("ordinal", F.struct("id", "seq", "qual").alias(side), (names.strip_pair_suffix(name) if strip_suffix else name).alias("name"))
        return keyed.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("ordinal")))

    joined = named(first, "r1").join(named(second, "r2").drop("ordinal"), ["name", "n"], "left")
    found = F.when(F.col("r2").isNull(), F.raise_error(F.lit("a read of the first file is missing from the second"))).otherwise(F.col("ordinal"))
    return joined.select(found.cast("long").alias("ordinal"), "r1", "r2")


def extract_second(pairs: DataFrame, options: ExtractOptions) -> DataFrame:
    """Barcodes on the second read by pattern2: it is trimmed, the first isn't."""
    pattern = options.compiled("pattern2")
    judged = pairs.withColumn("found", pattern.extract(F.col("r2.seq"), F.col("r2.qual"))).withColumn("status", _judged(F.col("found"), F.col("r2.seq"), pattern, options))
    header = lambda r: names.build_header(F.col(f"{r}.id"), F.col("found.cell"), F.col("found.umi"), options.separator)
    return judged.select(
        "ordinal", "r1", "r2", "status", F.col("found.umi").alias("umi"), F.col("found.cell").alias("cell"),
        F.struct(header("r1").alias("id"), F.col("r1.seq").alias("seq"), F.col("r1.qual").alias("qual")).alias("out1"),
        F.struct(header("r2").alias("id"), F.col("found.seq").alias("seq"), F.col("found.qual").alias("qual")).alias("out2"),
    )


def extract_first_to_second(pairs: DataFrame, options: ExtractOptions, whitelist: DataFrame | None = None, corrections: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Barcodes on the first read, written to the untrimmed second.

    whitelist, blacklist: ``barcode``; corrections: ``variant``, ``barcode``.  The raw
    barcode meets the blacklist first."""
    pattern = options.compiled()
    judged = pairs.withColumn("found", pattern.extract(F.col("r1.seq"), F.col("r1.qual"))).withColumn("status", _judged(F.col("found"), F.col("r1.seq"), pattern, options)).withColumn("cell", F.col("found.cell"))
    keyed = lambda df, col, mark: df.select(F.col(col).alias("listed")).distinct().withColumn(mark, F.lit(True))
    if blacklist is not None:
        judged = judged.join(keyed(blacklist, "barcode", "black"), F.col("cell") == F.col("listed"), "left").drop("listed")
        judged = judged.withColumn("status", F.when((F.col("status") == OUT) & F.col("black"), BLACKLISTED).otherwise(F.col("status"))).drop("black")
    if whitelist is not None:
        judged = judged.join(keyed(whitelist, "barcode", "white"), F.col("cell") == F.col("listed"), "left").drop("listed")
        right = F.lit(None).cast("string")
        if corrections is not None:
            judged = judged.join(corrections.select(F.col("variant").alias("listed"), F.col("barcode").alias("right")), F.col("cell") == F.col("listed"), "left").drop("listed")
            right = F.col("right")
        ok = F.col("status") == OUT
        known = F.coalesce(F.col("white"), F.lit(False))
        judged = judged.withColumn("status", F.when(ok & ~known & right.isNull(), UNLISTED).otherwise(F.col("status"))).withColumn("cell", F.when(ok & ~known, F.coalesce(right, F.col("cell"))).otherwise(F.col("cell")))
    header = names.build_header(F.col("r2.id"), F.col("cell"), F.col("found.umi"), options.separator, options.strip_suffix)
    return judged.select("ordinal", "r1", "r2", "status", F.col("found.umi").alias("umi"), "cell", F.struct(header.alias("id"), F.col("r2.seq").alias("seq"), F.col("r2.qual").alias("qual")).alias("out2"))


def extract_either(pairs: DataFrame, options: ExtractOptions) -> DataFrame:
    """Barcodes on the read that matches; pairs of which both match fall out.  Both headers come from the first."""
    p1, p2 = options.compiled(), options.compiled("pattern2")
    both = pairs.withColumn("f1", p1.extract(F.col("r1.seq"), F.col("r1.qual"))).withColumn("f2", p2.extract(F.col("r2.seq"), F.col("r2.qual")))
    one, two = F.col("f1").isNotNull(), F.col("f2").isNotNull()
    status = F.when(one & two, BOTH).when(~one & ~two, UNMATCHED).when(low_quality(F.coalesce(F.col("f1.umi_quality"), F.col("f2.umi_quality")), options), QUALITY).otherwise(OUT)
    found = both.withColumn("status", status).withColumn("umi", F.coalesce("f1.umi", "f2.umi")).withColumn("cell", F.coalesce("f1.cell", "f2.cell"))
    header = names.build_header(F.col("r1.id"), F.col("cell"), F.col("umi"), options.separator)
    side = lambda f, r: F.struct(header.alias("id"), F.coalesce(f"{f}.seq", f"{r}.seq").alias("seq"), F.coalesce(f"{f}.qual", f"{r}.qual").alias("qual"))
    return found.select("ordinal", "r1", "r2", "status", "umi", "cell", side("f1", "r1").alias("out1"), side("f2", "r2").alias("out2"))


def kept(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("status") == OUT)


def filtered_out(extracted: DataFrame) -> DataFrame:
    """What fell out, with its original headers."""
    return extracted.where(F.col("status") != OUT)


def counters(extracted: DataFrame) -> DataFrame:
    """Reads by status."""
    return extracted.groupBy("status").agg(F.count("*").alias("n"))
