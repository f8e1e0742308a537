"""Tables about a deduplication: counts per UMI and place, counts per UMI, edit distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import hamming
from .kernels import edges_of


def totals(led: DataFrame, keys: list[str] | None = None, method: str = "directional", threshold: int = 1) -> DataFrame:
    """keys, umi, n of the leads, n being the reads of their groups.

    In adjacency two leads can be neighbours; then the reads of the lower-ranked one also
    count for the first lead it neighbours.  ``keys`` are needed there."""
    leads = led.where(F.col("umi") == F.col("lead"))
    if method != "adjacency":
        return leads.withColumn("n", F.col("lead_n"))
    if keys is None:
        raise ValueError("the totals of adjacency need the keys")
    near = edges_of(leads, keys, threshold).where((F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a"))))
    told = near.groupBy(*keys, "a", "n_a").agg(F.min(F.struct((-F.col("n_b")).alias("_order"), "b"))["b"].alias("_to"))
    extra = told.groupBy(*keys, "_to").agg(F.sum("n_a").alias("_extra"))
    a, b = leads.alias("a"), extra.alias("b")
    on = F.col("a.umi") == F.col("b._to")
    for key in keys:
        on = on & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return a.join(b, on, "left").select("a.*", "b._extra").withColumn("n", F.col("lead_n") + F.coalesce("_extra", F.lit(0))).drop("_extra")


def per_umi_per_position(obs: DataFrame, post: DataFrame) -> DataFrame:
    """counts, instances_pre, instances_post; post: ``totals`` of the leads."""
    tally = lambda df, name: df.groupBy(F.col("n").alias("counts")).agg(F.count("*").alias(name))
    joined = tally(obs, "instances_pre").join(tally(post, "instances_post"), "counts", "full_outer")
    return joined.select("counts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("instances_pre", "instances_post")])


def per_umi(obs: DataFrame, post: DataFrame) -> DataFrame:
    """UMI with median_counts, times_observed and total_counts, before and after."""

    def tally(df: DataFrame, when: str) -> DataFrame:
        return df.groupBy("umi").agg(F.median("n").cast("long").alias(f"median_counts_{when}"), F.count("*").alias(f"times_observed_{when}"), F.sum("n").alias(f"total_counts_{when}"))

    joined = tally(obs, "pre").join(tally(post, "post"), "umi", "full_outer")
    return joined.select("umi", *[F.coalesce(f"{c}_{w}", F.lit(0)).alias(f"{c}_{w}") for w in ("pre", "post") for c in ("median_counts", "times_observed", "total_counts")])


def mean_distances(umis: DataFrame, keys: list[str]) -> DataFrame:
    """keys, distance: the mean over pairs of a key's UMIs of one length; -1 for a single UMI.

    Worked out by position, not by pair: at each position, pairs that differ are all pairs
    less those that agree, so a key costs its UMIs times their length."""
    sized = umis.select(*keys, "umi", F.length("umi").alias("_size"))
    letters = sized.where("_size > 0").select(*keys, "_size", F.posexplode(F.split("umi", "")).alias("_at", "_letter")).where("_letter <> ''")
    agree = letters.groupBy(*keys, "_size", "_at", "_letter").agg(F.count("*").alias("_n")).groupBy(*keys, "_size").agg(F.sum(F.expr("_n * (_n - 1) / 2")).alias("_agreeing"))
    lengths = sized.groupBy(*keys, "_size").agg(F.count("*").alias("_n"))
    a, b = lengths.alias("a"), agree.alias("b")
    on = F.col("a._size") == F.col("b._size")
    for key in keys:
        on = on & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    pairs = F.expr("a._n * (a._n - 1) / 2")
    made = a.join(b, on, "left").select(*[F.col(f"a.{key}").alias(key) for key in keys], pairs.alias("_pairs"), (pairs * F.col("a._size") - F.coalesce("b._agreeing", F.lit(0.0))).alias("_apart"))
    total = made.groupBy(*keys).agg(F.sum("_pairs").alias("_pairs"), F.sum("_apart").alias("_apart"))
    return total.select(*keys, F.when(F.col("_pairs") == 0, F.lit(-1.0)).otherwise(F.col("_apart") / F.col("_pairs")).alias("distance"))


def binned(distances: DataFrame, name: str) -> DataFrame:
    """bin, name: -1 is bin 0, and bin d + 1 holds what is above d - 1 and at most d."""
    at = F.when(F.col("distance") <= -1, 0).otherwise(F.ceil("distance") + 1).cast("long")
    return distances.groupBy(at.alias("bin")).agg(F.count("*").alias(name))


def edit_distance(obs: DataFrame, post: DataFrame, keys: list[str], nulls: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """bin, edit_distance, unique, deduplicated (and their null columns, if given)."""
    parts = [binned(mean_distances(obs, keys), "unique"), binned(mean_distances(post, keys), "deduplicated")]
    parts += [binned(d, n) for d, n in zip(nulls or (), ("unique_null", "deduplicated_null"))]
    top = None
    for p in parts:
        top = p.select("bin") if top is None else top.unionByName(p.select("bin"))
    last = top.agg(F.coalesce(F.max("bin"), F.lit(0)).alias("last"))
    bins = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("last"), F.lit(0)) + 1)).alias("bin"))
    for p in parts:
        bins = bins.join(p, "bin", "left")
    names = [c for c in bins.columns if c != "bin"]
    label = F.when(F.col("bin") == 0, "Single_UMI").otherwise((F.col("bin") - 1).cast("string"))
    return bins.select("bin", label.alias("edit_distance"), *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def pairwise_distances(umis: DataFrame, keys: list[str]) -> DataFrame:
    """The same means by comparing every pair; only to check ``mean_distances`` on small keys."""
    a, b = umis.alias("a"), umis.alias("b")
    on = F.col("a.umi") < F.col("b.umi")
    for key in keys:
        on = on & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return a.join(b, on).where(F.length("a.umi") == F.length("b.umi")).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.avg(hamming(F.col("a.umi"), F.col("b.umi"))).alias("distance"))
