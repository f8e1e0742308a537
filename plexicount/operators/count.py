"""Molecules per gene, and per gene and cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..storage import staged
from .alignments import PAIRED, SECOND, UNMAPPED, KeyOptions, flag, gene_of
from .kernels import count_molecules


def gene_observations(alignments: DataFrame, options: KeyOptions | None = None, per_cell: bool = False) -> DataFrame:
    """gene, cell, umi, n, first, from names with ``UMI_`` and ``CELL_`` fields."""
    options = options or KeyOptions(per_gene=True, umi_from="umis")
    reads = alignments.where(~flag(UNMAPPED) & ~(flag(PAIRED) & flag(SECOND))).withColumn("gene", gene_of(options)).where("gene IS NOT NULL")
    umi = names.umi_field(F.col("qname")) if options.umi_from == "umis" else names.umi_from_name(F.col("qname"), options.separator)
    cell = names.cell_field(F.col("qname")) if per_cell else F.lit(None).cast("string")
    return reads.groupBy("gene", cell.alias("cell"), umi.alias("umi")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


def count(alignments: DataFrame, options: KeyOptions | None = None, per_cell: bool = False, method: str = "directional", threshold: int = 1) -> DataFrame:
    """gene, count; or gene, cell, count, without reads that name no cell."""
    counted = count_molecules(gene_observations(alignments, options, per_cell), ["gene", "cell"], method, threshold)
    return counted.where("cell IS NOT NULL").select("gene", "cell", "count") if per_cell else counted.select("gene", "count")


def wide(alignments: DataFrame, options: KeyOptions | None = None, method: str = "directional", threshold: int = 1) -> DataFrame:
    """A row per gene, a column per cell in order, 0 where nothing was counted; genes seen without a cell keep their row."""
    obs = gene_observations(alignments, options, per_cell=True)
    counted = count_molecules(obs, ["gene", "cell"], method, threshold)
    cells = [r["cell"] for r in obs.select("cell").where("cell IS NOT NULL").distinct().orderBy("cell").collect()]
    pivoted = counted.groupBy("gene").pivot("cell", cells).agg(F.sum("count"))
    return pivoted.select("gene", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in cells])


def wide_lines(alignments: DataFrame, options: KeyOptions | None = None, method: str = "directional", threshold: int = 1) -> tuple[list[str], DataFrame]:
    """The cells in order, and the rows of ``wide`` as tab-separated lines (gene, value).

    A line is put together from the gene's own counts and the gaps between them, so the
    plan doesn't grow with the cells and a row costs what was counted for its gene."""
    obs = staged(gene_observations(alignments, options, per_cell=True), "gene-observations")
    counted = count_molecules(obs, ["gene", "cell"], method, threshold)
    cells = [r["cell"] for r in obs.select("cell").where("cell IS NOT NULL").distinct().orderBy("cell").collect()]
    places = obs.sparkSession.createDataFrame(list(enumerate(cells)), "at int, cell string")
    told = counted.join(places, "cell", "left").groupBy("gene").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "count")))).alias("held"))
    zeros = lambda n: F.repeat(F.lit("\t0"), n.cast("int"))
    piece = lambda x, k: F.concat(zeros(x["at"] - F.coalesce(F.get("held", k - 1)["at"], F.lit(-1)) - 1), F.lit("\t"), x["count"].cast("string"))
    end = zeros(F.lit(len(cells) - 1) - F.coalesce(F.get("held", F.size("held") - 1)["at"], F.lit(-1)))
    return cells, told.select("gene", F.concat("gene", F.array_join(F.transform("held", piece), ""), end).alias("value"))


def tab_observations(lines: DataFrame, separator: str = "_", per_cell: bool = False) -> DataFrame:
    """run, gene, cell, umi, n, first of a two-column table.  A run is a stretch of rows of
    one gene; a gene that comes back makes a new one.

    Runs are cut in buckets of neighbouring rows that are then put together."""
    parts = lines.select("ordinal", F.rtrim(F.col("value"), F.lit("\r")).alias("value")).where("instr(value, '\t') > 0")
    rows = parts.select("ordinal", F.substring_index("value", "\t", 1).alias("name"), F.expr("substring(value, instr(value, '\t') + 1)").alias("gene"))
    inside = Window.partitionBy("bucket").orderBy("ordinal")
    cut = rows.withColumn("bucket", F.floor(F.col("ordinal") / (1 << 20))).withColumn("starts", F.when(F.col("gene") == F.lag("gene").over(inside), 0).otherwise(1))
    cut = cut.withColumn("run_in_bucket", F.sum("starts").over(inside))
    ends = cut.groupBy("bucket").agg(F.max("run_in_bucket").alias("runs"), F.min_by("gene", "ordinal").alias("head"), F.max_by("gene", "ordinal").alias("tail"))
    order = Window.orderBy("bucket")
    joined = F.when(F.col("head") == F.lag("tail").over(order), 1).otherwise(0)
    ends = ends.withColumn("joined", joined).withColumn("before", F.sum(F.col("runs") - F.col("joined")).over(order) - F.col("runs"))
    numbered = cut.join(ends.select("bucket", "before"), "bucket").withColumn("run", (F.col("before") + F.col("run_in_bucket") - 1).cast("long"))
    umi, cell = names.tab_barcodes(F.col("name"), separator, per_cell)
    return numbered.groupBy("run", "gene", cell.alias("cell"), umi.alias("umi")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


def count_tab(lines: DataFrame, separator: str = "_", per_cell: bool = False, method: str = "directional", threshold: int = 1) -> DataFrame:
    """run, gene, count; or run, first, cell, gene, count.  Order by run (and first) to write it."""
    obs = tab_observations(lines, separator, per_cell)
    counted = count_molecules(obs, ["run", "gene", "cell"], method, threshold)
    if not per_cell:
        return counted.groupBy("run", "gene").agg(F.sum("count").alias("count"))
    seen = obs.groupBy("run", "cell").agg(F.min("first").alias("first"))
    a, b = counted.alias("a"), seen.alias("b")
    return a.join(b, (F.col("a.run") == F.col("b.run")) & F.col("a.cell").eqNullSafe(F.col("b.cell"))).select("a.run", "b.first", F.coalesce("a.cell", F.lit("")).alias("cell"), "a.gene", "a.count")
