"""Ordered operators with tiny blocks against plain Python, one key holding most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from stripline.operators import blocks as B


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(11)
    rows = [("hot", p, rnd.randrange(0, 9)) for p in range(400)] + [("cold", p, 1) for p in range(7)] + [("one", 0, 5)]
    return rows, spark.createDataFrame(rows, "k string, p long, v long")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


@pytest.mark.parametrize("ranged", [False, True])
def test_running(data, ranged):
    rows, df = data
    b = B.range_blocks(df, ["k"], ["p"], 5) if ranged else B.id_blocks(df, "p", 16)
    got = {(r.k, r.p): (r.s, r.n, r.t) for r in B.running(b, ["k"], ["p"], {"s": "v"}, "n", {"t": "v"}).collect()}
    for k, rs in by_key(rows).items():
        s, total = 0, sum(r[2] for r in rs)
        for i, (_, p, v) in enumerate(rs, 1):
            assert got[k, p] == (s, i, total)
            s += v


def test_neighbours(data):
    rows, df = data
    got = {(r.k, r.p): (r.a, r.z) for r in B.neighbours(df, ["k"], "p", {"a": "v"}, {"z": "v"}, width=8).collect()}
    for k, rs in by_key(rows).items():
        v = [r[2] for r in rs]
        for i, r in enumerate(rs):
            assert got[k, r[1]] == (v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None)


@pytest.mark.parametrize("gap", [1, 3])
@pytest.mark.parametrize("width", [4, 7, 1000])
def test_sessions(data, gap, width):
    rows, df = data
    kept = [r for r in rows if r[2] > 3]
    got = sorted((r.k, r.start, r.last, r.n, r.s) for r in B.sessions(df.filter("v > 3"), ["k"], "p", gap, {"s": ("sum", "v")}, width).collect())
    want = []
    for k, rs in by_key(kept).items():
        for _, p, v in rs:
            if want and want[-1][0] == k and p - want[-1][2] <= gap:
                w = want[-1]
                want[-1] = (k, w[1], p, w[3] + 1, w[4] + v)
            else:
                want.append((k, p, p, 1, v))
    assert got == sorted(want)


def test_lag_sparse_and_next(spark):
    rnd = random.Random(2)
    ps = sorted(rnd.sample(range(5000), 60))
    df = spark.createDataFrame([("a", p, p * 2) for p in ps], "k string, p long, v long")
    got = {r.p: r.l for r in B.lag_sparse(df, ["k"], ["p"], {"l": "v"}, width=100).collect()}
    assert got == {p: (ps[i - 1] * 2 if i else None) for i, p in enumerate(ps)}
    at = [rnd.randrange(5200) for _ in range(50)]
    pts = spark.createDataFrame([("a", x) for x in at], "k string, at long")
    nxt = B.next_at_or_after(pts, df.select("k", F.col("p").alias("pos")), ["k"], "at", "n", width=64).collect()
    assert sorted((r.at, -1 if r.n is None else r.n) for r in nxt) == sorted((x, min((p for p in ps if p >= x), default=-1)) for x in at)


@pytest.mark.parametrize("width", [10, 10000])
def test_interval_joins(spark, width):
    rnd = random.Random(4)
    iv = lambda n: [("a" if rnd.random() < 0.9 else "b", s, s + rnd.randrange(1, 60)) for s in (rnd.randrange(500) for _ in range(n))]
    left, right = iv(80), iv(80)
    a, b = spark.createDataFrame(left, "k string, s long, e long"), spark.createDataFrame(right, "k string, rs long, re long")
    got = sorted(tuple(r) for r in B.overlap_join(a, b, ["k"], ("s", "e"), ("rs", "re"), width).select("k", "s", "e", "rs", "re").collect())
    assert got == sorted((k, s, e, x, y) for k, s, e in left for k2, x, y in right if k == k2 and max(s, x) < min(e, y))
    pts = B.point_join(a, b, ["k"], "s", ("rs", "re"), width).count()
    assert pts == sum(1 for k, s, _ in left for k2, x, y in right if k == k2 and x <= s < y)


def test_hot_key_is_spread(spark):
    """No task of the ordered operators receives a hot key as a whole."""
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("p"), F.lit(1).alias("v"))
    r = B.running(B.id_blocks(df, "p", 500), ["k"], ["p"], {"s": "v"})
    assert r.groupBy("k", "_b").count().agg(F.max("count")).first()[0] == 500
    ranged = B.range_blocks(df, ["k"], ["p"], 8)
    assert ranged.groupBy("_b").count().agg(F.max("count")).first()[0] < 20000 / 3


def test_range_blocks_are_bounded_when_one_key_holds_most_rows(spark):
    from pyspark.sql import functions as F
    from stripline.operators.blocks import range_blocks

    df = spark.range(30_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), F.xxhash64("id").alias("o"))
    spark.conf.set("spark.stripline.block", "1000")
    try:
        sizes = [r["count"] for r in range_blocks(df, ["k"], ["o"]).groupBy("_b").count().collect()]
    finally:
        spark.conf.unset("spark.stripline.block")
    assert sum(sizes) == 30_000 and len(sizes) >= 25 and max(sizes) < 2500


def test_overlap_semi_equals_all_pairs(spark):
    rnd = random.Random(9)
    span = lambda: (rnd.choice(["a", "a", "b", None]), (x := rnd.randrange(0, 300)), x + rnd.choice([-3, 0, 1, 5, 40, 250]))
    left, right = [(i, *span()) for i in range(300)], [span() for _ in range(25)]
    le, ri = spark.createDataFrame(left, "i long, k string, s long, e long"), spark.createDataFrame(right, "k string, s long, e long")
    want = {i for i, k, s, e in left if any(k is not None and k == k2 and max(s, s2) < min(e, e2) for k2, s2, e2 in right)}
    for width in (7, 1 << 14):
        got = B.overlap_semi(le, ri, ["k"], ("s", "e"), ("s", "e"), width=width)
        assert got.columns == le.columns and sorted(r.i for r in got.collect()) == sorted(want)
        rest = B.overlap_semi(le, ri, ["k"], ("s", "e"), ("s", "e"), anti=True, width=width)
        assert sorted(r.i for r in rest.collect()) == sorted(set(range(300)) - want)
    assert B.overlap_semi(le, ri.limit(0), ["k"], ("s", "e"), ("s", "e")).count() == 0


def test_overlap_semi_of_a_million_nested_intervals(spark):
    n = 1_000_000
    nest = spark.range(n).select(F.lit("a").alias("k"), (F.lit(n) - F.col("id")).alias("s"), (F.lit(n) + F.col("id") + 1).alias("e"))
    points = spark.createDataFrame([("a", n, n + 1), ("a", 2 * n + 5, 2 * n + 6), ("a", 1, 2)], "k string, s long, e long")
    assert sorted(r.s for r in B.overlap_semi(points, nest, ["k"], ("s", "e"), ("s", "e")).collect()) == [1, n]
    assert B.overlap_semi(nest, points.limit(1), ["k"], ("s", "e"), ("s", "e")).count() == n
