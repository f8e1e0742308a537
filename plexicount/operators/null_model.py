"""The null model of edit distances: groups of UMIs drawn by how often each was read.

Exact draws follow one random stream over all groups in order, on the driver: the
table of distinct UMIs and the group sizes go there, which suits comparisons of runs.
``null_distances`` draws each group from its own seed instead, in any partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignments import SECOND, UNMAPPED, KeyOptions, flag, on_contig, umi_of
from .stats import mean_distances

FILL = 100_000


def umi_frequencies(reads: DataFrame) -> DataFrame:
    """umi, n, first of the reads that are mapped and not second."""
    return reads.groupBy("umi").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


class Sampler:
    """UMIs with chance proportional to their counts, from one stream, filled in blocks."""

    def __init__(self, umis: list[str], counts: list[int], seed: int = 0):
        self.umis, self.stream, self.fill = umis, np.random.RandomState(seed), FILL
        self.bounds = np.cumsum(np.asarray(counts, float) / sum(counts))
        self.held: np.ndarray = np.empty(0, int)
        self.at = 0
        self._refill()

    def _refill(self) -> None:
        drawn = np.searchsorted(self.bounds, self.stream.random_sample(self.fill), "right")
        self.held, self.at = np.minimum(drawn, len(self.umis) - 1), 0

    def take(self, n: int) -> list[str]:
        if n >= len(self.held) - self.at:
            if n > self.fill:
                self.fill = 2 * n
            self._refill()
        out = self.held[self.at : self.at + n]
        self.at += n
        return [self.umis[k] for k in out]


def mean_distance(umis: list[str]) -> float:
    """-1 for at most one UMI; pairs of unequal length are left out."""
    total = pairs = 0
    by_length: dict[int, list[str]] = {}
    for u in umis:
        by_length.setdefault(len(u), []).append(u)
    for size, same in by_length.items():
        n = len(same) * (len(same) - 1) // 2
        pairs += n
        for at in range(size):
            counts = np.unique([ord(u[at]) for u in same], return_counts=True)[1]
            total += n - int((counts * (counts - 1) // 2).sum())
    return total / pairs if pairs else -1.0


def exact_null_distances(frequencies: DataFrame, sizes: list[int], seed: int = 0) -> list[float]:
    """For group sizes in order, the mean distances of groups drawn from one stream."""
    rows = frequencies.orderBy("first").collect()
    sampler = Sampler([r["umi"] for r in rows], [r["n"] for r in rows], seed)
    return [mean_distance(sampler.take(n)) for n in sizes]


def drawn_from(alignments: DataFrame, options: KeyOptions) -> DataFrame:
    """The reads whose UMIs are drawn: mapped, not second, on the contig asked for; no subset, whatever their gene."""
    reads = on_contig(alignments.where(~flag(UNMAPPED) & ~flag(SECOND)), options.chrom)
    return reads.withColumn("umi", umi_of(options)).where("umi IS NOT NULL")


def exact_nulls(obs: DataFrame, post: DataFrame, frequencies: DataFrame, keys: list[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """For the groups before and after, in order of their keys, distances drawn in turn from one stream."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = count(obs, "before").join(count(post, "after"), keys, "left").orderBy(*keys).select("before", F.coalesce("after", F.lit(0)).alias("after")).collect()
    flat = exact_null_distances(frequencies, [n for r in sizes for n in (r["before"], r["after"])], seed) if sizes else []
    made = lambda some: obs.sparkSession.createDataFrame([(x,) for x in some], "distance double")
    return made(flat[::2]), made(flat[1::2])


def null_distances(groups: DataFrame, frequencies: DataFrame, seed: int = 0) -> DataFrame:
    """groups: one row per group with ``size`` and ``group_id``.  distance: of as many UMIs drawn.

    A UMI is the one whose stretch of the cumulative counts a draw falls into; draws and
    stretches meet by a range bucket, so neither side is broadcast or collected."""
    total = frequencies.agg(F.sum("n")).first()[0] or 0
    width = max(1, total // 4096)
    ends = frequencies.withColumn("bucket0", F.pmod(F.xxhash64("umi"), F.lit(64)))
    sums = ends.groupBy("bucket0").agg(F.sum("n").alias("s")).select("bucket0", (F.sum("s").over(Window.orderBy("bucket0")) - F.col("s")).alias("before"))
    ends = ends.join(sums, "bucket0").withColumn("z", F.col("before") + F.sum("n").over(Window.partitionBy("bucket0").orderBy("umi"))).withColumn("a", F.col("z") - F.col("n"))
    spread = ends.select("umi", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("z") - 1) / width))).alias("cell"))
    draws = groups.select("group_id", F.explode(F.sequence(F.lit(1), F.col("size").cast("int"))).alias("k"))
    draws = draws.withColumn("x", F.pmod(F.xxhash64(F.lit(seed), "group_id", "k"), F.lit(max(total, 1)))).withColumn("cell", F.floor(F.col("x") / width))
    met = draws.join(spread, "cell").where("x >= a AND x < z")
    return mean_distances(met.select("group_id", "umi"), ["group_id"])
