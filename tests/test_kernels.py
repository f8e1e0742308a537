import random

import pytest

from plexicount.operators.kernels import cluster_group, neighbours, relational_groups, umi_groups


def sequential(umis, counts, firsts, method):
    """The rules one by one, on whole components, with searches that may overlap."""
    far = lambda a, b: sum(x != y for x, y in zip(umis[a], umis[b])) if len(umis[a]) == len(umis[b]) else 99
    n = range(len(umis))
    edge = lambda a, b: far(a, b) <= 1 and (method != "directional" or counts[a] >= 2 * counts[b] - 1)
    lead, found, observed = {}, set(), set()
    for v in sorted(n, key=lambda v: (-counts[v], firsts[v])):
        if v in found:
            continue
        component, todo = {v}, [v]
        while todo:
            x = todo.pop()
            for y in n:
                if y not in component and x != y and edge(x, y):
                    component.add(y)
                    todo.append(y)
        found |= component
        ranked = sorted(component, key=lambda x: (-counts[x], umis[x]))
        if method == "cluster":
            lead |= {x: ranked[0] for x in component}
        elif method == "directional":
            new = [x for x in ranked if x not in observed]
            observed |= component
            lead |= {x: new[0] for x in new}
        else:
            for k in range(1, len(ranked) + 1):
                covered = set(ranked[:k]) | {y for x in ranked[:k] for y in component if far(x, y) <= 1}
                if covered == component:
                    break
            for x in component:
                lead[x] = x if x in ranked[:k] else next(y for y in ranked[:k] if far(x, y) <= 1)
    return lead


@pytest.mark.parametrize("method", ["cluster", "adjacency", "directional"])
def test_random_groups(method):
    rng = random.Random(3)
    for _ in range(500):
        umis = sorted({"".join(rng.choice("AC") for _ in range(rng.choice((3, 4)))) for _ in range(rng.randint(1, 9))})
        counts, firsts = [rng.choice((1, 1, 2, 3, 5, 9)) for _ in umis], rng.sample(range(99), len(umis))
        groups = cluster_group(umis, counts, firsts, method)
        assert {m: g[0] for g in groups for m in g} == sequential(umis, counts, firsts, method)


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_neighbours(threshold):
    rng = random.Random(4)
    umis = sorted({"".join(rng.choice("ACG") for _ in range(rng.choice((4, 5)))) for _ in range(60)})
    want = [[j for j, b in enumerate(umis) if j != i and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= threshold] for i, a in enumerate(umis)]
    assert neighbours(umis, threshold) == want


@pytest.mark.parametrize("method", ["cluster", "adjacency", "directional"])
def test_joins_give_the_same_groups(spark, method):
    rng = random.Random(5)
    rows = []
    for key in range(12):
        umis = sorted({"".join(rng.choice("ACG") for _ in range(4)) for _ in range(rng.randint(1, 25))})
        rows += [(key, u, rng.choice((1, 1, 2, 4, 9)), first) for u, first in zip(umis, rng.sample(range(99), len(umis)))]
    obs = spark.createDataFrame(rows, "k int, umi string, n bigint, first bigint")
    plain = {tuple(r) for r in umi_groups(obs, ["k"], method).select("k", "umi", "lead", "lead_n").collect()}
    assert plain == {tuple(r) for r in relational_groups(obs, ["k"], method).select("k", "umi", "lead", "lead_n").collect()}
    # Large groups are routed to the joins.
    assert plain == {tuple(r) for r in umi_groups(obs, ["k"], method, array_limit=8).select("k", "umi", "lead", "lead_n").collect()}


def test_null_keys_and_empty_tables(spark):
    obs = spark.createDataFrame([(None, "AA", 3, 0), (None, "AC", 1, 1)], "k string, umi string, n bigint, first bigint")
    assert {tuple(r) for r in umi_groups(obs, ["k"]).select("k", "umi", "lead").collect()} == {(None, "AA", "AA"), (None, "AC", "AA")}
    assert umi_groups(obs.limit(0), ["k"]).count() == 0
