"""What dedup, group and count share: filters, group keys, read selection."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.cigar import group_position
from ..schemas import MATE_UNMAPPED, PAIRED, REVERSE, SECOND, UNMAPPED


class AlignmentError(ValueError):
    """Options that can't be used with each other or with the input."""


def flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0


@dataclass(frozen=True)
class KeyOptions:
    """How reads are named, filtered and keyed.  umi_from: read_id, tag or umis."""

    separator: str = "_"
    umi_from: str = "read_id"
    umi_tag: str = "RX"
    ignore_umi: bool = False
    chrom: str | None = None
    subset: float | None = None
    seed: int = 0
    paired: bool = False
    ignore_tlen: bool = False
    per_gene: bool = False
    gene_tag: str = "XF"
    skip_tags: str | None = None
    per_contig: bool = False


def umi_of(options: KeyOptions) -> Column:
    if options.ignore_umi:
        return F.lit("")
    if options.umi_from == "tag":
        return names.tag(F.col("tags"), options.umi_tag)
    if options.umi_from == "umis":
        return names.umi_field(F.col("qname"))
    if options.umi_from != "read_id":
        raise AlignmentError("a UMI comes from read_id, tag or umis")
    return names.umi_from_name(F.col("qname"), options.separator)


def gene_of(options: KeyOptions) -> Column:
    """The gene, or the contig in its place; null where the tag is missing, not text, or to be skipped."""
    gene = F.col("contig") if options.per_contig else names.tag(F.col("tags"), options.gene_tag)
    if options.skip_tags is None:
        return gene
    try:
        re.compile(options.skip_tags)
    except re.error as e:
        raise AlignmentError(f"not a regular expression: {e}") from e
    return F.when(~gene.rlike(options.skip_tags), gene)


def on_contig(alignments: DataFrame, chrom: str | None, contigs: DataFrame | None = None) -> DataFrame:
    """The rows of one contig; an unknown name raises if the header's contigs are given."""
    if chrom is None:
        return alignments
    if contigs is not None and contigs.where(F.col("name") == chrom).isEmpty():
        raise AlignmentError(f"the header has no contig {chrom}")
    return alignments.where(F.col("contig") == chrom)


def sampled(reads: DataFrame, options: KeyOptions, exact: bool) -> DataFrame:
    """A share of the reads.  Not exact: by a hash of seed and name, in any order and
    partitioning.  Exact: one draw per read in file order, in one task."""
    if options.subset is None:
        return reads
    share = float(np.float32(options.subset))
    if not exact:
        drawn = F.pmod(F.xxhash64(F.lit(options.seed), "qname"), F.lit(1 << 53)) / F.lit(float(1 << 53))
        return reads.where(drawn < share)
    seed, column = options.seed, reads.schema.names.index("ordinal")

    def draw(batches):
        rng = random.Random(seed & 0xFFFFFFFF)
        for batch in batches:
            keep = [rng.random() < share for _ in range(batch.num_rows)]
            yield batch.filter(pa.array(keep))

    assert column >= 0
    return reads.repartition(1).sortWithinPartitions("ordinal").mapInArrow(draw, reads.schema)


def keyed(alignments: DataFrame, options: KeyOptions, exact: bool = False, keep_null: bool = False) -> DataFrame:
    """Eligible reads with umi, gene or start, is_reverse and tlen_key.  ``keep_null``: also
    those without a UMI or gene, on which a draw of the subset is spent all the same."""
    reads = alignments.where(~flag(UNMAPPED))
    if options.paired:
        reads = reads.where(~flag(SECOND) & ~flag(MATE_UNMAPPED))
    reads = sampled(on_contig(reads, options.chrom), options, exact).withColumn("umi", umi_of(options))
    reads = reads if keep_null else reads.where("umi IS NOT NULL")
    if options.per_gene:
        reads = reads.withColumn("gene", gene_of(options))
        return reads if keep_null else reads.where("gene IS NOT NULL")
    tlen = F.col("tlen") if options.paired and not options.ignore_tlen else F.lit(0).cast("long")
    return reads.withColumn("is_reverse", flag(REVERSE)).withColumn("start", group_position(F.col("pos"), F.col("cigar"), flag(REVERSE))).withColumn("tlen_key", tlen)


def key_columns(options: KeyOptions) -> list[str]:
    return ["gene"] if options.per_gene else ["tid", "start", "is_reverse", "tlen_key"]


def best_reads(reads: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """keys, umi, n, first, best (ordinal): of each UMI the read of the highest mapping
    quality; ties go by a hash of seed and name, the same in every run and partitioning.
    One map-side combined aggregation, whatever the duplication."""
    tie = F.xxhash64(F.lit(seed), "qname", "ordinal")
    return reads.groupBy(*keys, "umi").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max(F.struct("mapq", tie.alias("tie"), "ordinal"))["ordinal"].alias("best"))


def best_reads_exact(reads: DataFrame, keys: list[str], options: KeyOptions) -> DataFrame:
    """As ``best_reads``, with ties (and the subset) drawn from one random stream in file
    order: the k-th read of equal quality replaces the kept one with chance 1 / k.  One
    task, by the nature of the stream; for comparing runs, not for large inputs."""
    share = None if options.subset is None else float(np.float32(options.subset))
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema}
    seed, columns = options.seed, [*keys, "umi"]

    def run(batches):
        rng, slots = random.Random(seed & 0xFFFFFFFF), {}
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("ordinal", "mapq", *columns)]):
                if share is not None and not rng.random() < share:
                    continue
                ordinal, mapq, key = row[0], row[1], row[2:]
                if any(k is None for k in key):
                    continue
                slot = slots.setdefault(key, [ordinal, mapq, 0, 0, ordinal])
                slot[3] += 1
                if slot[3] == 1:
                    continue
                if mapq > slot[1]:
                    slot[:3] = [ordinal, mapq, 0]
                elif mapq == slot[1]:
                    slot[2] += 1
                    if rng.random() < 1.0 / slot[2]:
                        slot[0] = ordinal
        rows = [(*k, s[3], s[4], s[0]) for k, s in slots.items()]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist([dict(zip([*columns, "n", "first", "best"], r)) for r in rows[at : at + 10_000]], schema)

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([*[(c, arrow[kinds[c]]) for c in columns], ("n", pa.int64()), ("first", pa.int64()), ("best", pa.int64())])
    ddl = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", n bigint, first bigint, best bigint"
    return reads.repartition(1).sortWithinPartitions("ordinal").mapInArrow(run, ddl)


def contig_runs(alignments: DataFrame) -> DataFrame:
    """Adds ``contig_run``: 0 for the file's first stretch of one contig, and so on.

    Two passes, so no task sees all rows: stretches are cut inside buckets of
    neighbouring ordinals, then the buckets' few ends are put together."""
    bucket = F.floor(F.col("ordinal") / (1 << 20))
    inside = Window.partitionBy("bucket").orderBy("ordinal")
    cut = alignments.withColumn("bucket", bucket).withColumn("starts", F.when(F.col("tid").eqNullSafe(F.lag("tid").over(inside)) & (F.row_number().over(inside) > 1), 0).otherwise(1))
    cut = cut.withColumn("run_in_bucket", F.sum("starts").over(inside))
    ends = cut.groupBy("bucket").agg(F.max("run_in_bucket").alias("runs"), F.min_by("tid", "ordinal").alias("head"), F.max_by("tid", "ordinal").alias("tail"))
    order = Window.orderBy("bucket")
    joined = F.when(F.col("head").eqNullSafe(F.lag("tail").over(order)) & F.lag("bucket").over(order).isNotNull(), 1).otherwise(0)
    ends = ends.withColumn("joined", joined).withColumn("before", F.sum(F.col("runs") - F.col("joined")).over(order) - F.col("runs"))
    return cut.join(ends.select("bucket", "before"), "bucket").withColumn("contig_run", (F.col("before") + F.col("run_in_bucket") - 1).cast("long")).drop("bucket", "starts", "run_in_bucket", "before")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


__all__ = ["MATE_UNMAPPED", "PAIRED", "REVERSE", "SECOND", "UNMAPPED", "AlignmentError", "KeyOptions"]
