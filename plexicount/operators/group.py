"""Annotation of reads with their UMI group."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .alignments import MATE_UNMAPPED, SECOND, UNMAPPED, AlignmentError, KeyOptions, contig_runs, flag, keyed, on_contig, sampled
from .kernels import umi_groups

POLICIES = ("discard", "output", "use")


@dataclass(frozen=True)
class GroupOptions:
    method: str = "directional"
    keys: KeyOptions = field(default_factory=KeyOptions)
    chimeric: str = "use"
    unmapped: str = "discard"
    output_unmapped: bool = False
    per_contig: bool = False


def _roles(alignments: DataFrame, options: GroupOptions) -> DataFrame:
    """Adds ``role``: use (grouped), pass and told (written untagged) or drop."""
    if options.chimeric not in POLICIES or options.unmapped not in POLICIES:
        raise AlignmentError(f"policies are {', '.join(POLICIES)}")
    if options.per_contig and not options.keys.per_gene:
        raise AlignmentError("per_contig needs per_gene")
    told = lambda policy: F.lit({"discard": "drop", "output": "told", "use": "use"}[policy])
    unmapped = F.lit("pass") if options.unmapped != "discard" or options.output_unmapped else F.lit("drop")
    role = F.when(flag(UNMAPPED), unmapped).when(flag(SECOND), "pass")
    if options.keys.paired:
        role = role.when(~flag(MATE_UNMAPPED) & (F.col("mtid") >= 0) & (F.col("tid") != F.col("mtid")), told(options.chimeric))
        role = role.when(flag(MATE_UNMAPPED), told(options.unmapped))
    return alignments.withColumn("role", role.otherwise("use"))


def group(alignments: DataFrame, options: GroupOptions, exact: bool = False) -> DataFrame:
    """All reads that are written, with umi, umi_count, final_umi, final_umi_count and
    unique_id where they were grouped, and the tags UG and BX unless they have them."""
    roles = _roles(alignments, options)
    # Contig and subset apply to mapped first reads, whatever becomes of them, not to what passes.
    first = sampled(on_contig(roles.where(~flag(UNMAPPED) & ~flag(SECOND)), options.keys.chrom), options.keys, exact)
    passing = roles.where("role = 'pass'").unionByName(first.where("role = 'told'"))
    plain = KeyOptions(**{**vars(options.keys), "chrom": None, "subset": None, "paired": False, "per_contig": options.per_contig})
    reads = keyed(first.where("role = 'use'"), plain)
    if options.keys.per_gene:
        keys = ["contig_run", "gene"]
        reads = contig_runs(reads)
    else:
        keys = ["tid", "start", "is_reverse", "tlen_key"]
        same = ~flag(MATE_UNMAPPED) & (F.col("tid") == F.col("mtid"))
        reads = reads.withColumn("tlen_key", F.when(same, F.col("tlen")).otherwise(0) if options.keys.paired else F.lit(0).cast("long"))
    obs = reads.groupBy(*keys, "umi").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    # Numbering reads the groups three times.
    led = numbered(staged(umi_groups(obs, keys, options.method), "grouped"), keys)
    told = led.select(*keys, "umi", F.col("n").alias("umi_count"), F.col("lead").alias("final_umi"), F.col("lead_n").alias("final_umi_count"), "unique_id")
    annotated = reads.join(told, [*keys, "umi"])
    add = lambda name, kind, value: F.when(F.map_contains_key("tags", name), F.col("tags")).otherwise(F.map_concat("tags", F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.alias("value")))))
    annotated = annotated.withColumn("tags", add("UG", "i", F.col("unique_id").cast("string"))).withColumn("tags", add("BX", "Z", F.col("final_umi")))
    columns = [*alignments.columns, "umi", "umi_count", "final_umi", "final_umi_count", "unique_id", "gene"]
    annotated = annotated if options.keys.per_gene else annotated.withColumn("gene", F.lit(None).cast("string"))
    return annotated.select(*columns).unionByName(passing.select(*alignments.columns), allowMissingColumns=True)


def numbered(led: DataFrame, keys: list[str], spread: int = 16) -> DataFrame:
    """Adds ``unique_id``: groups numbered from 0 by key and rank, over all rows.

    Numbers are given inside buckets of neighbouring keys, shifted by what the buckets
    before hold, so the only window over everything runs on one row per bucket."""
    place = "start" if "start" in keys else None
    bucket = [F.col(keys[0]).alias("b0"), (F.shiftright(F.col(place), spread) if place else F.lit(0).cast("long")).alias("b1")]
    groups = led.where(F.col("umi") == F.col("lead")).select(*keys, "lead", "rank", *bucket)
    sizes = groups.groupBy("b0", "b1").agg(F.count("*").alias("size"))
    before = sizes.select("b0", "b1", (F.sum("size").over(Window.orderBy("b0", "b1")) - F.col("size")).alias("before"))
    inside = groups.withColumn("nth", F.row_number().over(Window.partitionBy("b0", "b1").orderBy(*keys, "rank", "lead")) - 1)
    ids = inside.join(before, ["b0", "b1"]).select(*keys, "lead", (F.col("before") + F.col("nth")).cast("long").alias("unique_id"))
    return led.join(ids, [*keys, "lead"])


def group_table(grouped: DataFrame) -> DataFrame:
    """The table of grouped reads."""
    return grouped.where("unique_id IS NOT NULL").select(F.col("qname").alias("read_id"), "contig", F.col("pos").alias("position"), F.coalesce("gene", F.lit("NA")).alias("gene"), "umi", "umi_count", "final_umi", "final_umi_count", "unique_id")
