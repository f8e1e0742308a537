"""Clustering of UMIs within groups: who leads whom.

Observations are rows of key columns, ``umi``, ``n`` (reads) and ``first`` (where it
was first seen).  Five methods:

unique        every UMI leads itself
percentile    those above a hundredth of the group's median count; others vanish
cluster       components of UMIs within the distance, led by the most frequent
adjacency     in a component, the shortest prefix in order of frequency whose neighbourhoods cover it
directional   a UMI absorbs neighbours of at most half its count plus one, and theirs

``unique`` and ``percentile`` are expressions and an aggregation.  The others run one array
kernel for each group, several groups to an Arrow batch; groups of one UMI never leave
the JVM.  A group of more than ``ARRAY_LIMIT`` UMIs is not collected: sizes are aggregated
first, and large groups go through equi-joins on masked UMIs and label propagation
instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import blocks, hamming, masks
from ..storage import discard, staged

METHODS = ("unique", "percentile", "cluster", "adjacency", "directional")
ARRAY_LIMIT = 20_000


def neighbours(umis: list[str], threshold: int) -> list[list[int]]:
    """For each UMI the others of its length within the distance, by masks or blocks in common."""
    found: list[set[int]] = [set() for _ in umis]
    held: dict[tuple, list[int]] = {}
    for k, u in enumerate(umis):
        n = len(u)
        if threshold == 1:
            keys = [(n, i, u[:i] + u[i + 1 :]) for i in range(n)]
        else:
            cuts = [n * j // (threshold + 1) for j in range(threshold + 2)]
            keys = [(n, j, u[cuts[j] : cuts[j + 1]]) for j in range(threshold + 1)]
        for key in keys:
            others = held.setdefault(key, [])
            for o in others:
                if o not in found[k] and (threshold == 1 or sum(a != b for a, b in zip(u, umis[o])) <= threshold):
                    found[k].add(o)
                    found[o].add(k)
            others.append(k)
    return [sorted(f) for f in found]


def _reach(start: int, edges: list[list[int]], seen: list[bool]) -> list[int]:
    """What can be reached and hasn't been seen; what a seen one reaches has been seen too."""
    seen[start], out = True, [start]
    for v in out:
        for w in edges[v]:
            if not seen[w]:
                seen[w] = True
                out.append(w)
    return out


def cluster_group(umis: list[str], counts: list[int], firsts: list[int], method: str, threshold: int = 1) -> list[list[int]]:
    """Groups of indexes, leaders first, in the order in which they are given out."""
    near = neighbours(umis, threshold)
    by_count = lambda v: (-counts[v], umis[v])
    if method == "directional":
        edges = [[w for w in near[v] if counts[v] >= 2 * counts[w] - 1] for v in range(len(umis))]
    else:
        edges = near
    seen, groups = [False] * len(umis), []
    for v in sorted(range(len(umis)), key=lambda v: (-counts[v], firsts[v])):
        if seen[v]:
            continue
        members = sorted(_reach(v, edges, seen), key=by_count)
        if method != "adjacency" or len(members) == 1:
            groups.append(members)
            continue
        rank = {m: k for k, m in enumerate(members)}
        # The prefix must reach the lowest-ranked cover of every member.
        last = max(min(rank[m], min((rank[w] for w in near[m]), default=rank[m])) for m in members)
        led = {m: [m] for m in members[: last + 1]}
        for m in members[last + 1 :]:
            led[members[min(rank[w] for w in near[m])]].append(m)
        groups += led.values()
    return groups


def clusters(method: str, threshold: int):
    kind = pa.list_(pa.struct([("umi", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("lead", pa.string()), ("lead_n", pa.int64()), ("rank", pa.int64())]))

    @F.arrow_udf("array<struct<umi:string,n:bigint,first:bigint,lead:string,lead_n:bigint,rank:bigint>>")
    def run(groups: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in groups:
            out = []
            for group in batch.to_pylist():
                umis, counts, firsts = ([g[c] for g in group] for c in ("umi", "n", "first"))
                rows = []
                for rank, members in enumerate(cluster_group(umis, counts, firsts, method, threshold)):
                    lead, total = umis[members[0]], sum(counts[m] for m in members)
                    rows += [{"umi": umis[m], "n": counts[m], "first": firsts[m], "lead": lead, "lead_n": total, "rank": rank} for m in members]
                out.append(rows)
            yield pa.array(out, kind)

    return run


def umi_groups(obs: DataFrame, keys: list[str], method: str = "directional", threshold: int = 1, array_limit: int = ARRAY_LIMIT, held: bool = False) -> DataFrame:
    """obs: keys, umi, n, first; one row for each UMI of a key.  Adds lead, lead_n (reads
    of its whole group) and rank (which orders the groups of a key).  ``held``: obs is
    a staged table already."""
    if method not in METHODS:
        raise ValueError(f"methods are {', '.join(METHODS)}")
    obs = obs.select(*keys, "umi", F.col("n").cast("long").alias("n"), F.col("first").cast("long").alias("first"))
    if method in ("unique", "percentile"):
        if method == "percentile":
            obs = obs if held else staged(obs, "observations")
            # Equal counts combine before they move, so a key's median costs its distinct counts.
            many = obs.groupBy(*keys, "n").agg(F.count("*").alias("many"))
            medians = many.groupBy(*keys).agg(F.percentile("n", F.lit(0.5), F.col("many")).alias("median_n"))
            a, b = obs.alias("a"), medians.alias("b")
            obs = a.join(b, _equal(keys, "a", "b")).where("100 * a.n > b.median_n").select("a.*")
        return obs.select("*", F.col("umi").alias("lead"), F.col("n").alias("lead_n"), F.col("first").alias("rank"))
    # Used by both routes, and once to see whether there is a second.
    obs = obs if held else staged(obs, "observations")
    large = obs.groupBy(*keys).agg(F.count("*").alias("group_size")).where(F.col("group_size") > array_limit).select(*keys)
    several = not large.isEmpty()
    o, g = obs.alias("o"), large.alias("g")
    small = o.join(g, _equal(keys, "o", "g"), "left_anti") if several else obs
    one = F.transform("members", lambda m: F.struct(m.umi.alias("umi"), m.n.alias("n"), m["first"].alias("first"), m.umi.alias("lead"), m.n.alias("lead_n"), F.lit(0).cast("long").alias("rank")))
    collected = small.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "umi", "n"))).alias("members"))
    single = collected.where(F.size("members") == 1).select(*keys, F.inline(one))
    kernel = F.transform("members", lambda m: F.struct(m.umi.alias("umi"), m.n.alias("n"), m["first"].alias("first")))
    many = collected.where(F.size("members") > 1).select(*keys, clusters(method, threshold)(kernel).alias("made")).select(*keys, F.inline("made"))
    out = single.unionByName(many)
    return out.unionByName(relational_groups(o.join(g, _equal(keys, "o", "g"), "left_semi"), keys, method, threshold)) if several else out


def _equal(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def edges_of(nodes: DataFrame, keys: list[str], threshold: int = 1) -> DataFrame:
    """keys, a, b, n_a, n_b: pairs of distinct UMIs within the distance, both ways, found by equi-join on masks or blocks."""
    probes = masks(F.col("umi")) if threshold == 1 else blocks(F.col("umi"), threshold)
    spread = nodes.select(*keys, "umi", "n", F.explode(probes).alias("probe"))
    a, b = spread.alias("a"), spread.alias("b")
    joined = a.join(b, _equal(keys, "a", "b") & (F.col("a.probe") == F.col("b.probe")) & (F.col("a.umi") != F.col("b.umi")))
    if threshold != 1:
        joined = joined.where(hamming(F.col("a.umi"), F.col("b.umi")) <= threshold)
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.umi").alias("a"), F.col("b.umi").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).distinct()


def _least_ancestor(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """nodes: keys, umi, n, first, seed (a struct that orders).  Each node's smallest seed
    over all nodes that reach it along edges a to b; each round is staged."""
    held = staged(edges.select(*keys, "a", "b"), "edges")
    now = before = staged(nodes, "seeds")
    while True:
        s, e = now.alias("s"), held.alias("e")
        told = s.join(e, _equal(keys, "s", "e") & (F.col("s.umi") == F.col("e.a"))).select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.b").alias("umi"), F.col("s.seed").alias("told"))
        told = told.groupBy(*keys, "umi").agg(F.min("told").alias("told"))
        n, t = now.alias("n"), told.alias("t")
        stepped = n.join(t, _equal(keys, "n", "t") & (F.col("n.umi") == F.col("t.umi")), "left")
        stepped = stepped.select("n.*", F.col("t.told").alias("told")).withColumn("changed", F.coalesce(F.col("told") < F.col("seed"), F.lit(False)))
        now_ = stepped.withColumn("seed", F.least("seed", F.coalesce("told", "seed"))).drop("told")
        now_ = staged(now_, "seeds")
        discard(before)
        now, before = now_.drop("changed"), now_
        if now_.where("changed").isEmpty():
            discard(held)
            return now


def relational_groups(nodes: DataFrame, keys: list[str], method: str, threshold: int = 1) -> DataFrame:
    """The same groups by joins, for keys with more UMIs than a task should hold."""
    edges = edges_of(nodes, keys, threshold)
    seeded = nodes.withColumn("seed", F.struct((-F.col("n")).alias("m"), F.col("first").alias("f"), F.col("umi").alias("u")))
    along = edges.where("n_a >= 2 * n_b - 1") if method == "directional" else edges
    placed = _least_ancestor(seeded, along, keys)
    # Within a component UMIs rank by count, then as text: an order, so no row needs a number.
    ranked = placed.withColumn("r", F.struct((-F.col("n")).alias("m"), F.col("umi").alias("u")))
    if method == "adjacency":
        r1, e = ranked.alias("r"), edges.alias("e")
        least = F.min(F.struct((-F.col("e.n_b")).alias("m"), F.col("e.b").alias("u"))).alias("near")
        near = e.groupBy(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.a").alias("a")).agg(least).alias("w")
        ranked = r1.join(near, _equal(keys, "r", "w") & (F.col("r.umi") == F.col("w.a")), "left").select("r.*", F.col("w.near").alias("near"))
        ranked = staged(ranked, "ranked")
        x = ranked.alias("x")
        bounds = ranked.groupBy(*keys, "seed").agg(F.max(F.least("r", F.coalesce("near", "r"))).alias("last")).alias("y")
        told = x.join(bounds, _equal([*keys, "seed"], "x", "y")).select("x.*", F.when(F.col("x.r") <= F.col("y.last"), F.col("x.r")).otherwise(F.col("x.near")).alias("lead_r"))
    else:
        x = ranked.alias("x")
        tops = ranked.groupBy(*keys, "seed").agg(F.min("r").alias("lead_r")).alias("y")
        told = x.join(tops, _equal([*keys, "seed"], "x", "y")).select("x.*", "y.lead_r")
    told = staged(told, "led")
    t, s = told.alias("t"), told.groupBy(*keys, "lead_r").agg(F.sum("n").alias("lead_n")).alias("s")
    out = t.join(s, _equal([*keys, "lead_r"], "t", "s")).select("t.*", F.col("t.lead_r.u").alias("lead"), "s.lead_n")
    # Only annotation asks for the rank; elsewhere it is pruned.
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("seed", "lead_r")) - 1
    return out.withColumn("rank", rank.cast("long")).select(*keys, "umi", "n", "first", "lead", "lead_n", "rank")


def count_molecules(obs: DataFrame, keys: list[str], method: str = "directional", threshold: int = 1) -> DataFrame:
    """keys, count: the number of leads."""
    led = umi_groups(obs, keys, method, threshold)
    return led.where(F.col("umi") == F.col("lead")).groupBy(*keys).agg(F.count("*").alias("count"))
