import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexicount.functions.cigar import group_position
from plexicount.functions.distance import FAR, hamming, packed, packed_hamming, prefix_edit_distance
from plexicount.operators import knee, null_model, stats


# The first numbers of the generator with this seed.
SEED, FIRST = 123456789, [0.6414006161858726, 0.5421892680969495, 0.9931750662832721]


def test_random_streams():
    rng = random.Random(SEED)
    assert [rng.random() for _ in range(3)] == FIRST


@pytest.mark.parametrize(("a", "b", "far", "prefix"), [("GATTACA", "GATTACA", 0, 0), ("GATTACA", "GACTATA", 2, 2), ("GAT", "GATTACA", FAR, 0), ("TTTT", "AAAA", 4, 4), ("CAT", "ACTG", FAR, 2)])
def test_distances(spark, a, b, far, prefix):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(hamming(F.col("a"), F.col("b")), packed_hamming(packed(F.col("a")), packed(F.col("b"))), prefix_edit_distance(F.col("a"), F.col("b"))).first()
    assert (row[0], row[2]) == (far, prefix)
    assert far == FAR or row[1] == far


def searched(counts: list[int]) -> int:
    """The knee by looking at every point."""

    def first(n: int) -> int:
        ys = [sum(counts[: k + 1]) for k in range(n)]
        far = [abs(k * (ys[-1] - ys[0]) - (y - ys[0]) * (n - 1)) for k, y in enumerate(ys)]
        return far.index(max(far)) if max(far) else 0

    knee, before = first(len(counts)), 0
    while knee != before:
        before, knee = knee, first(min(3 * knee, len(counts)))
    return knee


@pytest.mark.parametrize("seed", range(40))
def test_knee_at_corners_is_the_knee_of_all_points(seed):
    rng = random.Random(seed)
    counts = sorted((rng.choice((1, 1, 2, 3, rng.randint(1, 9), rng.randint(50, 60), 400)) for _ in range(rng.randint(1, 120))), reverse=True)
    values = sorted(set(counts), reverse=True)
    assert knee.distance_knee(np.array(values), np.array([counts.count(v) for v in values])) == searched(counts)


def test_density():
    xs = np.linspace(-1, 1, 5)
    # Two kernels, of weights 3 and 1, by the formula of the normal density.
    want = [(3 * math.exp(-((x - 0.5) ** 2) / 0.08) + math.exp(-((x + 0.5) ** 2) / 0.08)) / (4 * 0.2 * math.sqrt(2 * math.pi)) for x in xs]
    assert knee.kernel_density(np.array([0.5, -0.5]), np.array([3.0, 1.0]), 0.2, xs) == pytest.approx(want)
    counts = np.array([1000, 990, 980, 12, 11, 10])
    assert 12 < knee.density_threshold(counts, np.array([5, 6, 5, 40, 50, 40])) < 980
    # What isn't above a thousandth of the top takes no part.
    assert 12 < knee.density_threshold(np.append(counts, 1), np.array([5, 6, 5, 40, 50, 40, 10**6])) < 980
    assert knee.density_threshold(np.array([5]), np.array([9])) is None


@pytest.mark.parametrize(("cigar", "reverse", "want"), [("10M", False, 100), ("5S10M", False, 95), ("10M5S", True, 115), ("3S10M2D5M4S", True, 121), ("2H3S10M", False, 100), ("5M100N5M", True, 210), ("4S6M1I3M2H", True, 109)])
def test_positions(spark, cigar, reverse, want):
    row = spark.createDataFrame([(100, cigar, reverse)], "p bigint, c string, r boolean").select(group_position(F.col("p"), F.col("c"), F.col("r"))).first()
    assert row[0] == want


def test_sampler_and_mean_distance():
    sampler = null_model.Sampler(["AA", "CC"], [3, 1], seed=1)
    drawn = sampler.take(10_000)
    assert 0.72 < drawn.count("AA") / len(drawn) < 0.78
    assert len(sampler.take(150_000)) == 150_000 or sampler.fill == 300_000
    assert null_model.mean_distance(["AA", "AC", "CC"]) == pytest.approx(4 / 3)
    assert null_model.mean_distance(["AA"]) == -1.0


def test_mean_distances_by_position(spark):
    rng = random.Random(1)
    rows = sorted({(k, "".join(rng.choice("ACGT") for _ in range(5))) for k in range(4) for _ in range(20)})
    umis = spark.createDataFrame(rows, "k int, umi string")
    pairs = {r["k"]: r["distance"] for r in stats.pairwise_distances(umis, ["k"]).collect()}
    assert {r["k"]: pytest.approx(r["distance"]) for r in stats.mean_distances(umis, ["k"]).collect()} == pairs
