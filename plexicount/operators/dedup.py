"""Deduplication of alignments: one read for each group of UMIs at a place or on a gene."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .alignments import MATE_UNMAPPED, SECOND, UNMAPPED, AlignmentError, KeyOptions, best_reads, best_reads_exact, flag, key_columns, keyed
from .kernels import umi_groups

PRODUCT_LIMIT = 10_000_000


@dataclass(frozen=True)
class DedupOptions:
    method: str = "directional"
    threshold: int = 1
    keys: KeyOptions = field(default_factory=KeyOptions)
    exact: bool = False


def observations(alignments: DataFrame, options: DedupOptions) -> DataFrame:
    """keys, umi, n, first, best."""
    keys = key_columns(options.keys)
    if not options.exact:
        return best_reads(keyed(alignments, options.keys), keys, options.keys.seed)
    whole = KeyOptions(**{**vars(options.keys), "subset": None})
    return best_reads_exact(keyed(alignments, whole, keep_null=True), keys, options.keys)


def leads(alignments: DataFrame, options: DedupOptions, umi_whitelist: DataFrame | None = None, obs: DataFrame | None = None) -> DataFrame:
    """keys, umi, n, first, best, lead_n of the leading UMIs.  A whitelist (``umi``) is met
    by the lead alone, so a lead that isn't on it takes its whole group with it.

    ``obs``: the staged observations, where they have been made already."""
    keys = key_columns(options.keys)
    obs = staged(observations(alignments, options), "observations") if obs is None else obs
    led = umi_groups(obs, keys, options.method, options.threshold, held=True).where(F.col("umi") == F.col("lead")).drop("n", "first", "lead", "rank")
    out = obs.join(led, [*keys, "umi"])
    return out if umi_whitelist is None else out.join(umi_whitelist.select("umi").distinct(), "umi", "left_semi")


def mates(alignments: DataFrame, selected: DataFrame) -> DataFrame:
    """Of each selected read the first second read at its mate's place, each place once."""
    wanted = selected.select(F.col("qname").alias("w_name"), F.col("mtid").alias("w_tid"), F.col("mpos").alias("w_pos")).distinct()
    seconds = alignments.where(flag(SECOND) & ~flag(UNMAPPED) & ~flag(MATE_UNMAPPED))
    met = seconds.join(wanted, (F.col("qname") == F.col("w_name")) & (F.col("tid") == F.col("w_tid")) & (F.col("pos") == F.col("w_pos"))).drop("w_name", "w_tid", "w_pos")
    first = Window.partitionBy("qname", "tid", "pos").orderBy("ordinal")
    return met.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def dedup(alignments: DataFrame, options: DedupOptions, umi_whitelist: DataFrame | None = None, obs: DataFrame | None = None) -> DataFrame:
    """The reads that stay, with all their columns; in paired mode, with their mates.

    Sort by ``coordinate_order`` to write them."""
    chosen = leads(alignments, options, umi_whitelist, obs).select(F.col("best").alias("ordinal"))
    selected = alignments.join(chosen, "ordinal", "left_semi")
    return selected.unionByName(mates(alignments, selected)) if options.keys.paired else selected


def coordinate_order(alignments: DataFrame) -> DataFrame:
    """By contig and position, unmapped last, else in input order."""
    return alignments.orderBy(flag(UNMAPPED) & (F.col("tid") < 0), "tid", "pos", "ordinal")


def whitelist_product(first: DataFrame, second: DataFrame, limit: int = PRODUCT_LIMIT) -> DataFrame:
    """Every concatenation of a UMI of each list.  Both sides are counted first: a product
    of more than ``limit`` is refused, so this stated query set stays bounded."""
    size = first.count() * second.count()
    if size > limit:
        raise ValueError(f"the two lists make {size} UMIs; the limit is {limit}")
    return first.select(F.col("umi").alias("a")).crossJoin(second.select(F.col("umi").alias("b"))).select(F.concat("a", "b").alias("umi"))


def summary(alignments: DataFrame, options: DedupOptions, obs: DataFrame | None = None) -> DataFrame:
    """input_reads, output_reads, positions: one row."""
    keys = key_columns(options.keys)
    obs = staged(observations(alignments, options), "observations") if obs is None else obs
    led = umi_groups(obs, keys, options.method, options.threshold, held=True)
    totals = obs.agg(F.sum("n").alias("input_reads"))
    places = led.where(F.col("umi") == F.col("lead")).groupBy(*keys).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("output_reads"), F.count("*").alias("positions"))
    return totals.crossJoin(places)
