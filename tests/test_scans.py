"""Prefix sums, order statistics and interval joins that no single task holds."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import scans
from ledgerspark.operators import search as G
from ledgerspark.scratch import Scratch


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(f"p{rng.randint(0, 20)}", i, rng.choice([0, 1, 5, 1000])) for i in range(500)]
    df = spark.createDataFrame(rows, "path string, n long, v long").repartition(5)
    got = scans.prefix_sums(df, ["path", "n"], F.col("v"), Scratch(spark, "t"), parts=parts)
    assert "SinglePartition" not in plan(got)
    want, total = {}, 0
    for path, n, v in sorted(rows):
        want[n] = total = total + v
    assert {r.n: r.upto for r in got.collect()} == want
    some = scans.prefix_sums(df, ["path", "n"], F.col("v"), Scratch(spark, "t"), 5000, parts)
    assert {r.n for r in some.collect()} == {n for n, t in want.items() if t <= 5000}
    none = scans.prefix_sums(df.limit(0), ["path", "n"], F.col("v"), Scratch(spark, "t"), 5000, parts)
    assert none.count() == 0 and none.columns == ["path", "n", "v", "upto"]


@pytest.mark.parametrize("n", [0, 1, 2, 101, 1000])
def test_nearest_ranks(spark, n):
    rng, shares = random.Random(n), [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    values = [rng.choice([-5, 7, rng.randint(0, 10**12)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    got = scans.nearest_ranks(df, shares, Scratch(spark, "t"), parts=5)
    assert got == [sorted(values)[int(p * (n - 1) + 0.5)] if n else None for p in shares]


def test_output_cap_has_no_single_task(spark):
    found = spark.createDataFrame([(f"p{i % 9}", i, "x" * (i % 50)) for i in range(400)], "path string, line_no long, line string")
    got = G.output_cap(found, 2000)
    assert "SinglePartition" not in plan(got)
    want, total = set(), 0
    for path, n, line in sorted(found.collect()):
        total += len(line) + 1
        if total <= 2000:
            want.add(n)
    assert {r.line_no for r in got.collect()} == want and want


@pytest.mark.parametrize("width", [4, 256])
def test_overlaps(spark, width):
    rng = random.Random(width)
    make = lambda n: [(i, rng.choice("aab"), a := rng.randint(-20, 300), a + rng.choice([-1, 0, 3, 40, 200])) for i in range(n)]  # noqa: E731, F841
    left, right = make(150), make(120)
    df = lambda rows: spark.createDataFrame(rows, "id long, k string, low long, high long").withColumn("bin", F.lit("x")).drop("bin")
    got = scans.overlaps(df(left), df(right), ["k"], width)
    pairs = sorted((r.id, r.other_id) for r in got.collect())
    assert pairs == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]) and pairs


def test_a_hot_key_of_ranges_is_dealt_by_place(spark):
    """A third of all ranges are one file's: its rows meet in as many bins as it has places for."""
    rows = [(i, "hot", 10 * i, 10 * i + 15) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, low long, high long")
    got = scans.overlaps(df, df, ["k"], 64)
    assert got.count() == 3000 + 2 * 2999
