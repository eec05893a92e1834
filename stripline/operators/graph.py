"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node that ``edges(a, b)`` name, in a logarithmic number of rounds.

    Alternates the two star steps: every node links its larger neighbours to the smallest of all (large star), then itself and its smaller neighbours to
    the smallest (small star), until each node hangs on one root.  Both are a minimum per node, combined before the shuffle, and a plain join, so that
    a node with very many neighbours is split.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(a, F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(small.select("e.a", "e.b").filter("a > b").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined(n: int, a, b):
    """The same for ``n`` numbered nodes in memory: the smallest node of each node's component, by hooking roots and jumping pointers."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
