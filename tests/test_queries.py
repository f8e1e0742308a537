import pytest

from plexicount.plans import registry

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(same, name):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_distances_of_drawn_groups(spark):
    """Groups drawn by frequency: each has its distance, the mean is what drawing pairs gives, and a run repeats."""
    from collections import Counter

    from plexicount.plans import fixtures as fx

    assert set(registry.queries()) - set(NAMES) == {"null_model_distances"}
    got = {r["group_id"]: r["distance"] for r in registry.queries()["null_model_distances"](spark, "/root/testdata/sf0.001").collect()}
    again = registry.queries()["null_model_distances"](spark, "/root/testdata/sf0.001").collect()
    assert got == {r["group_id"]: r["distance"] for r in again}
    reads = fx.umi_reads(spark, "/root/testdata/sf0.001").collect()
    sizes = Counter()
    for key, _ in {((r["contig"], r["pos"], r["is_reverse"]), r["umi"]) for r in reads}:
        sizes[key] += 1
    assert len(got) == len(sizes)
    umis, total = Counter(r["umi"] for r in reads), len(reads)
    expected = sum(a * b * sum(x != y for x, y in zip(u, v)) for u, a in umis.items() for v, b in umis.items()) / total**2
    several = [d for d in got.values() if d >= 0]
    assert sum(d < 0 for d in got.values()) == sum(n == 1 for n in sizes.values())
    assert sum(several) / len(several) == pytest.approx(expected, abs=0.25)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
