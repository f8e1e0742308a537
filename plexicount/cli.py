"""The commands: extract, whitelist, group, dedup, count and count_tab.

Every file may also be a path that pyarrow opens.  Outputs are single files, or
standard output where none is named; for large results use the operators and Spark's
own writers.  A summary goes to standard error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import count as counting
from .operators import dedup as deduping
from .operators import extract as extraction
from .operators import group as grouping
from .operators import null_model, stats
from .operators import whitelist as listing
from .operators.alignments import KeyOptions, key_columns, keyed
from .operators.kernels import METHODS, umi_groups
from .sources import files, lists, sinks
from .storage import staged


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plexicount", description="Barcodes and UMIs of sequencing reads, on Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **needs) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("-I", "--stdin", required=True, help="input file")
        p.add_argument("-S", "--stdout", default="-", help="output file")
        p.add_argument("-L", "--log", help="not used")
        return p

    def clustered(p: argparse.ArgumentParser, threshold: bool = True) -> None:
        p.add_argument("--method", choices=METHODS, default="directional")
        if threshold:
            p.add_argument("--edit-distance-threshold", type=int, default=1)

    def barcoded(p: argparse.ArgumentParser, needed: bool) -> None:
        p.add_argument("--bc-pattern", required=needed)
        p.add_argument("--extract-method", choices=("string", "regex"), default="string")
        p.add_argument("--3prime", dest="three_prime", action="store_true")

    def aligned(p: argparse.ArgumentParser) -> None:
        p.add_argument("--ignore-umi", action="store_true")
        p.add_argument("--out-sam", action="count", default=0)
        p.add_argument("--random-seed", type=int, default=0)
        p.add_argument("--umi-separator", default="_")
        p.add_argument("--chrom")
        p.add_argument("--subset", type=float)
        p.add_argument("--paired", action="store_true")
        p.add_argument("--per-gene", action="store_true")
        p.add_argument("--gene-tag", default="XF")
        p.add_argument("--skip-tags-regex")
        p.add_argument("--exact", action="store_true", help="one random stream in file order, in one task")

    e = command("extract")
    barcoded(e, False)
    e.add_argument("--bc-pattern2")
    e.add_argument("--read2-in")
    e.add_argument("--read2-out")
    e.add_argument("--read2-stdout", action="store_true")
    e.add_argument("--either-read", action="store_true")
    e.add_argument("--whitelist")
    e.add_argument("--blacklist")
    e.add_argument("--error-correct-cell", action="store_true")
    e.add_argument("--umi-separator", default="_")
    e.add_argument("--quality-filter-threshold", type=int)
    e.add_argument("--quality-encoding", choices=tuple(extraction.OFFSETS), default="phred33")
    e.add_argument("--ignore-read-pair-suffixes", action="store_true")
    e.add_argument("--reconcile-pairs", action="store_true")
    e.add_argument("--filtered-out")
    e.add_argument("--filtered-out2")

    w = command("whitelist")
    barcoded(w, True)
    w.add_argument("--knee-method", choices=("distance", "density"), default="distance")
    w.add_argument("--set-cell-number", type=int)
    w.add_argument("--expect-cells", type=int)
    w.add_argument("--error-correct-threshold", type=int, default=1)
    w.add_argument("--ed-above-threshold", choices=("discard", "correct"))
    w.add_argument("--plot-prefix", help="not used")
    w.add_argument("--filtered-out")
    w.add_argument("--subset-reads", type=int, default=100_000_000)

    g = command("group")
    clustered(g, threshold=False)
    aligned(g)
    g.add_argument("--group-out")
    g.add_argument("--output-bam", action="store_true")
    g.add_argument("--no-sort-output", action="store_true")
    g.add_argument("--output-unmapped", action="store_true")
    g.add_argument("--chimeric-pairs", choices=grouping.POLICIES, default="use")
    g.add_argument("--unmapped", choices=grouping.POLICIES, default="discard")
    g.add_argument("--per-contig", action="store_true")

    d = command("dedup")
    clustered(d)
    aligned(d)
    d.add_argument("--extract-umi-method", choices=("read_id", "tag", "umis"), default="read_id")
    d.add_argument("--umi-tag", default="RX")
    d.add_argument("--output-stats")
    d.add_argument("--ignore-tlen", action="store_true")
    d.add_argument("--filter-umi", action="store_true")
    d.add_argument("--umi-whitelist")
    d.add_argument("--umi-whitelist-paired")

    c = command("count")
    clustered(c)
    c.add_argument("--gene-tag", default="XF")
    c.add_argument("--skip-tags-regex")
    c.add_argument("--extract-umi-method", default="read_id", help="not used: names have UMI_ and CELL_ fields")
    c.add_argument("--per-cell", action="store_true")
    c.add_argument("--wide-format-cell-counts", action="store_true")
    c.add_argument("--random-seed", type=int, help="not used")

    t = command("count_tab")
    clustered(t)
    t.add_argument("--per-cell", action="store_true")
    t.add_argument("--barcode-separator", default="_")
    return top


def _say(what: str, rows: DataFrame) -> None:
    for row in rows.collect():
        print(f"{what}: " + ", ".join(f"{k} {v}" for k, v in row.asDict().items()), file=sys.stderr)


def _fastq(reads: DataFrame, path: str | None) -> None:
    if path:
        sinks.one_file(sinks.fastq_lines(reads), path)


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    options = extraction.ExtractOptions(a.bc_pattern, a.bc_pattern2, a.extract_method, a.three_prime, a.umi_separator, a.quality_filter_threshold, a.quality_encoding, a.ignore_read_pair_suffixes)
    first = files.read(spark, "fastq", a.stdin)
    side = lambda rows, s: rows.select("ordinal", f"{s}.id", f"{s}.seq", f"{s}.qual")
    if not a.read2_in:
        if a.either_read or a.read2_stdout:
            raise extraction.ExtractError("this mode needs --read2-in")
        done = extraction.extract(first, options)
        _fastq(extraction.kept(done), a.stdout)
        return _say("extract", extraction.counters(done))
    if a.reconcile_pairs:
        pairs = extraction.reconcile_pairs(first, files.read(spark, "fastq", a.read2_in), a.ignore_read_pair_suffixes)
    else:
        pairs = files.read_pairs(spark, a.stdin, a.read2_in)
    if a.read2_stdout and not a.either_read:
        white = lists.whitelist(spark, a.whitelist) if a.whitelist else None
        fixes = lists.whitelist_corrections(spark, a.whitelist) if a.whitelist and a.error_correct_cell else None
        done = extraction.extract_first_to_second(pairs, options, white, fixes, lists.blacklist(spark, a.blacklist) if a.blacklist else None)
        _fastq(side(extraction.kept(done), "out2"), a.stdout)
        _fastq(side(extraction.filtered_out(done), "r1"), a.filtered_out)
        _fastq(side(extraction.filtered_out(done), "r2"), a.filtered_out2)
        return _say("extract", extraction.counters(done))
    if not a.read2_out:
        raise extraction.ExtractError("this mode needs --read2-out")
    done = extraction.extract_either(pairs, options) if a.either_read else extraction.extract_second(pairs, options)
    _fastq(side(extraction.kept(done), "out1"), a.stdout)
    _fastq(side(extraction.kept(done), "out2"), a.read2_out)
    _say("extract", extraction.counters(done))


def run_whitelist(spark: SparkSession, a: argparse.Namespace) -> None:
    options = listing.WhitelistOptions(a.bc_pattern, a.extract_method, a.three_prime, a.knee_method, a.set_cell_number, a.expect_cells, a.error_correct_threshold, a.ed_above_threshold, a.subset_reads)
    reads = files.read(spark, "fastq", a.stdin)
    listed = listing.whitelist_table(listing.whitelist(reads, options)).cache()
    sinks.one_file(sinks.tsv_lines(listed.orderBy("barcode")), a.stdout)
    _fastq(listing.unmatched(reads, options), a.filtered_out)
    _say("whitelist", listed.agg(F.count("*").alias("barcodes"), F.sum("n").alias("reads")))


def _keys(a: argparse.Namespace, **more) -> KeyOptions:
    return KeyOptions(separator=a.umi_separator, ignore_umi=a.ignore_umi, chrom=a.chrom, subset=a.subset, seed=a.random_seed, paired=a.paired, per_gene=a.per_gene, gene_tag=a.gene_tag, skip_tags=a.skip_tags_regex, **more)


def _aligned(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, str, list]:
    header, contigs = files.header_of(a.stdin)
    if a.chrom is not None and a.chrom not in [n for n, _ in contigs]:
        raise deduping.AlignmentError(f"the header has no contig {a.chrom}")
    return files.read(spark, "alignments", a.stdin), header, contigs


def _write(rows: DataFrame, a: argparse.Namespace, header: str, contigs: list) -> None:
    (sinks.write_sam if a.out_sam else sinks.write_bam)(rows, a.stdout, header, contigs)


def run_group(spark: SparkSession, a: argparse.Namespace) -> None:
    alignments, header, contigs = _aligned(spark, a)
    options = grouping.GroupOptions(a.method, _keys(a), a.chimeric_pairs, a.unmapped, a.output_unmapped, a.per_contig)
    grouped = grouping.group(alignments, options, exact=a.exact).cache()
    if a.group_out:
        table = grouping.group_table(grouped)
        sinks.one_file(sinks.tsv_lines(table.orderBy("unique_id", "umi", "read_id")), a.group_out, ["\t".join(table.columns)])
    rows = grouped.orderBy("ordinal") if a.no_sort_output else deduping.coordinate_order(grouped)
    _write(rows if a.output_bam else rows.limit(0), a, header, contigs)
    _say("group", grouped.agg(F.count("unique_id").alias("reads"), F.count_distinct("unique_id").alias("groups")))


def run_dedup(spark: SparkSession, a: argparse.Namespace) -> None:
    alignments, header, contigs = _aligned(spark, a)
    if a.filter_umi and not a.umi_whitelist:
        raise deduping.AlignmentError("--filter-umi needs --umi-whitelist")
    options = deduping.DedupOptions(a.method, a.edit_distance_threshold, _keys(a, umi_from=a.extract_umi_method, umi_tag=a.umi_tag, ignore_tlen=a.ignore_tlen), a.exact)
    white = None
    if a.filter_umi:
        white = lists.umi_list(spark, a.umi_whitelist)
        white = deduping.whitelist_product(white, lists.umi_list(spark, a.umi_whitelist_paired)) if a.umi_whitelist_paired else white
    obs = staged(deduping.observations(alignments, options), "observations")
    _write(deduping.coordinate_order(deduping.dedup(alignments, options, white, obs)), a, header, contigs)
    if a.output_stats:
        write_stats(alignments, options, a.output_stats, obs)
    _say("dedup", deduping.summary(alignments, options, obs))


def write_stats(alignments: DataFrame, options: deduping.DedupOptions, prefix: str, obs: DataFrame) -> None:
    keys = key_columns(options.keys)
    post = staged(stats.totals(umi_groups(obs, keys, options.method, options.threshold, held=True), keys, options.method, options.threshold), "leads")
    drawn = staged(null_model.umi_frequencies(null_model.drawn_from(alignments, options.keys)), "frequencies")
    if options.exact:
        nulls = null_model.exact_nulls(obs, post, drawn, keys, options.keys.seed)
    else:
        sizes = lambda df, salt: df.groupBy(*keys).agg(F.count("*").alias("size")).select("size", F.xxhash64(F.lit(salt), *keys).alias("group_id"))
        nulls = tuple(null_model.null_distances(sizes(df, salt), drawn, options.keys.seed) for df, salt in ((obs, 0), (post, 1)))
    distances = stats.edit_distance(obs, post, keys, nulls).orderBy("bin")
    m = options.method
    tables = {
        "per_umi_per_position": stats.per_umi_per_position(obs, post).orderBy("counts"),
        "per_umi": stats.per_umi(obs, post).withColumnRenamed("umi", "UMI").orderBy("UMI"),
        "edit_distance": distances.select("unique", "unique_null", F.col("deduplicated").alias(m), F.col("deduplicated_null").alias(f"{m}_null"), "edit_distance"),
    }
    for name, table in tables.items():
        sinks.one_file(sinks.tsv_lines(table), f"{prefix}_{name}.tsv", ["\t".join(table.columns)])


def run_count(spark: SparkSession, a: argparse.Namespace) -> None:
    alignments = files.read(spark, "alignments", a.stdin)
    options = KeyOptions(umi_from="umis", per_gene=True, gene_tag=a.gene_tag, skip_tags=a.skip_tags_regex)
    if a.per_cell and a.wide_format_cell_counts:
        cells, lines = counting.wide_lines(alignments, options, a.method, a.edit_distance_threshold)
        return sinks.one_file(lines.orderBy("gene").select("value"), a.stdout, ["\t".join(["gene", *cells])])
    table = counting.count(alignments, options, a.per_cell, a.method, a.edit_distance_threshold)
    table = table.orderBy("gene", "cell") if a.per_cell else table.orderBy("gene")
    sinks.one_file(sinks.tsv_lines(table), a.stdout, ["\t".join(table.columns)])


def run_count_tab(spark: SparkSession, a: argparse.Namespace) -> None:
    table = counting.count_tab(files.read(spark, "numbered_lines", a.stdin), a.barcode_separator, a.per_cell, a.method, a.edit_distance_threshold)
    table = table.orderBy("run", "first").select("cell", "gene", "count") if a.per_cell else table.orderBy("run").select("gene", "count")
    sinks.one_file(sinks.tsv_lines(table), a.stdout, ["\t".join(table.columns)])


RUN = {"extract": run_extract, "whitelist": run_whitelist, "group": run_group, "dedup": run_dedup, "count": run_count, "count_tab": run_count_tab}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"plexicount {a.command}").getOrCreate()
    try:
        RUN[a.command](spark, a)
    except ValueError as e:
        print(f"plexicount {a.command}: {e}", file=sys.stderr)
        return 2
    return 0
