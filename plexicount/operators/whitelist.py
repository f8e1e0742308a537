"""Cell-barcode whitelists: counting, the knee, and error correction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import blocks, hamming, masks, prefix_edit_distance
from ..functions.patterns import compile_pattern
from ..sources.files import FILE_SPAN
from ..storage import staged
from .knee import density_threshold, distance_knee


@dataclass(frozen=True)
class WhitelistOptions:
    """knee: distance or density; cell_number fixes the number of cells; above: discard, correct or None."""

    pattern: str
    method: str = "string"
    three_prime: bool = False
    knee: str = "distance"
    cell_number: int | None = None
    expect_cells: int | None = None
    threshold: int = 1
    above: str | None = None
    subset_reads: int | None = 100_000_000


def _within(sizes: dict[int, int], limit: int) -> Column | None:
    """What keeps the first ``limit`` reads of files in order, by the files' sizes; None if that is all."""
    if sum(sizes.values()) <= limit:
        return None
    before, keep = 0, F.lit(False)
    for number in sorted(sizes):
        if before >= limit:
            break
        keep = keep | ((_file() == number) & (F.pmod("ordinal", F.lit(FILE_SPAN)) < limit - before))
        before += sizes[number]
    return keep


def _file() -> Column:
    return F.floor(F.col("ordinal") / FILE_SPAN)


def first_reads(reads: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` reads over all files: whole files in order, then a part of one."""
    if limit is None:
        return reads
    sizes = {r["file"]: r["n"] for r in reads.groupBy(_file().alias("file")).agg(F.count("*").alias("n")).collect()}
    keep = _within(sizes, limit)
    return reads if keep is None else reads.where(keep)


def barcode_counts(reads: DataFrame, options: WhitelistOptions) -> DataFrame:
    """cell, n, first; of the first ``subset_reads`` reads over all files.

    The pass over the reads also counts them by file; only where there are more reads than
    the limit a second pass leaves out what is beyond it."""
    found = compile_pattern(options.pattern, options.method, options.three_prime).extract(F.col("seq"), F.col("qual"))

    def counted(some: DataFrame) -> DataFrame:
        cells = some.select("ordinal", F.coalesce(found["cell"], F.lit("")).alias("cell"))
        return staged(cells.groupBy("cell", _file().alias("file")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first")), "barcodes")

    made = counted(reads)
    if options.subset_reads is not None:
        keep = _within({r["file"]: r["n"] for r in made.groupBy("file").agg(F.sum("n").alias("n")).collect()}, options.subset_reads)
        made = made if keep is None else counted(reads.where(keep))
    return made.where("cell <> ''").groupBy("cell").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def unmatched(reads: DataFrame, options: WhitelistOptions) -> DataFrame:
    """The reads without a barcode, as they were."""
    found = compile_pattern(options.pattern, options.method, options.three_prime).extract(F.col("seq"), F.col("qual"))
    return first_reads(reads, options.subset_reads).withColumn("found", found).where("found IS NULL").drop("found")


def choose(counts: DataFrame, options: WhitelistOptions) -> DataFrame:
    """The barcodes above the knee.  Ties at the knee go to the barcode seen first."""
    histogram = counts.groupBy("n").agg(F.count("*").alias("barcodes")).orderBy(F.col("n").desc()).collect()
    if not histogram:
        return counts.limit(0)
    values, many = np.array([r["n"] for r in histogram]), np.array([r["barcodes"] for r in histogram])
    if options.cell_number is not None:
        at = int(np.searchsorted(np.cumsum(many), min(options.cell_number, int(many.sum()))))
        return counts.where(F.col("n") > int(values[at]))
    if options.knee == "density":
        threshold = density_threshold(values, many, options.expect_cells)
        return counts.limit(0) if threshold is None else counts.where(F.col("n") > float(threshold))
    if options.knee != "distance":
        raise ValueError("a knee is found by distance or density")
    last = distance_knee(values, many)
    # Whole counts above the knee's, and as many of its own count as are left.
    above = int(many[values > values[np.searchsorted(np.cumsum(many), last, "right")]].sum())
    cut = int(values[np.searchsorted(np.cumsum(many), last, "right")])
    tied = counts.where(F.col("n") == cut).orderBy("first").limit(last + 1 - above)
    return counts.where(F.col("n") > cut).unionByName(tied)


def corrections(counts: DataFrame, chosen: DataFrame, threshold: int = 1) -> DataFrame:
    """barcode, variant, n: barcodes off the list within the distance of exactly one on it.

    An equi-join on masks (or blocks) finds the neighbours."""
    probes = masks if threshold == 1 else lambda c: blocks(c, threshold)
    off = counts.join(chosen.select("cell"), "cell", "left_anti").select(F.col("cell").alias("variant"), "n", F.explode(probes(F.col("cell"))).alias("probe"))
    on = chosen.select(F.col("cell").alias("barcode"), F.explode(probes(F.col("cell"))).alias("probe"))
    near = off.join(on, "probe").where((F.length("variant") == F.length("barcode")) & (hamming(F.col("variant"), F.col("barcode")) <= threshold))
    one = near.groupBy("variant", "n").agg(F.count_distinct("barcode").alias("k"), F.min("barcode").alias("barcode"))
    return one.where("k = 1").select("barcode", "variant", "n")


def near_misses(chosen: DataFrame, threshold: int = 1) -> DataFrame:
    """cell, n, misses, one: how many of the barcodes after it (by count, then first seen)
    it could be an error of, and the only one if there is one.

    Rows meet on pieces: within ``threshold`` edits of a prefix, one of threshold + 1
    pieces of the barcode stands unchanged, at most ``threshold`` places off."""
    ranked = chosen.select("cell", "n", "first")
    size = F.length("cell")
    k = threshold + 1
    bound = lambda j: F.floor(size * j / k).cast("int")
    own = F.array(*[F.struct(F.lit(j).alias("j"), (bound(j + 1) - bound(j)).alias("len"), F.substring(F.col("cell"), bound(j) + 1, bound(j + 1) - bound(j)).alias("piece"), bound(j).alias("at")) for j in range(k)])
    shapes = ranked.select(F.inline(own)).groupBy("j", "at", "len").agg(F.count("*").alias("_"))
    low = ranked.select("*", F.inline(own))
    # The few shapes that pieces have tell where the other barcodes are cut.
    other = ranked.select(F.col("cell").alias("higher"), F.col("n").alias("n2"), F.col("first").alias("first2"))
    cuts = other.crossJoin(F.broadcast(shapes.drop("_")))
    high = cuts.select("higher", "n2", "first2", "j", "at", "len", F.explode(F.sequence(F.lit(-threshold), F.lit(threshold))).alias("shift"))
    high = high.where(F.col("at") + F.col("shift") >= 0).select("higher", "n2", "first2", "j", "at", "len", F.expr("substring(higher, at + shift + 1, len)").alias("piece"))
    after = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("first2") > F.col("first")))
    close = F.abs(F.length("cell") - F.length("higher")) <= threshold
    pairs = low.join(high, ["j", "at", "len", "piece"]).where(after & close).select("cell", "n", "higher").distinct()
    met = pairs.where(prefix_edit_distance(F.col("cell"), F.col("higher")) <= threshold)
    return met.groupBy("cell", "n").agg(F.count("*").alias("misses"), F.min("higher").alias("one"))


def whitelist(reads: DataFrame, options: WhitelistOptions) -> DataFrame:
    """barcode, n, corrections (array of variant, n, by variant); order by barcode to write it."""
    counts = barcode_counts(reads, options)
    chosen = choose(counts, options)
    fixed = corrections(counts, chosen, options.threshold) if options.threshold else None
    if options.above is not None:
        if options.above not in ("discard", "correct"):
            raise ValueError("above the knee errors are discarded or corrected")
        missed = near_misses(chosen, options.threshold)
        if options.above == "correct" and fixed is not None:
            pure = missed.where((F.col("misses") == 1) & (hamming(F.col("cell"), F.col("one")) <= options.threshold))
            fixed = fixed.unionByName(pure.select(F.col("one").alias("barcode"), F.col("cell").alias("variant"), "n"))
        chosen = chosen.join(missed.select("cell"), "cell", "left_anti")
    listed = chosen.select(F.col("cell").alias("barcode"), "n")
    none = F.array().cast("array<struct<variant:string,n:bigint>>")
    if fixed is None:
        return listed.withColumn("corrections", none)
    made = fixed.groupBy("barcode").agg(F.sort_array(F.collect_list(F.struct("variant", "n"))).alias("corrections"))
    return listed.join(made, "barcode", "left").withColumn("corrections", F.coalesce("corrections", none))


def whitelist_table(listed: DataFrame) -> DataFrame:
    """barcode, variants, n, variant_counts; lists joined by commas."""
    join = lambda field: F.array_join(F.transform("corrections", lambda c: c[field].cast("string")), ",")
    return listed.select("barcode", join("variant").alias("variants"), "n", join("n").alias("variant_counts"))

