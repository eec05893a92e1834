"""The escalation over residuals: every level works on what the level before left open, and on nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from stripline.operators.blocks import point_join
from stripline.operators.cuts import MIN_CHUNK, level1_partition
from stripline.operators.evidence import near_seeds, residual_walk, seeds_per_bin
from stripline.operators.paths import CH, ZONE, balanced_path, complete_path, exhaustive_composition, into_zones, zoned
from stripline.progress import cut_measured
from stripline.session import cut


def directed(regions: DataFrame, decided: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Complete paths through the SAFE positions around the flattest seeds of every 3000 rows of a region."""
    keys = list(keys)
    z = zoned(regions)
    inside = into_zones(decided, z, keys, "y").join(z.select(*keys, ZONE, "s", "e"), [*keys, ZONE])
    seeds = seeds_per_bin(inside, F.col("s") + MIN_CHUNK, F.col("e") - MIN_CHUNK, keys=[*keys, ZONE])
    safe = inside.filter("decision = 'SAFE'").select(*keys, ZONE, "y")
    return complete_path(regions, near_seeds(safe, seeds, keys=[*keys, ZONE]).select(*keys, "y"), keys)


def escalate(bands: DataFrame, pages: DataFrame, totals: DataFrame, decided: DataFrame, radius: int = 200, step: int = 1, keys: Sequence[str] = CH) -> DataFrame:
    """Pieces of every chapter: keys, ``start``, ``end``, ``level`` that settled them and ``part`` (``chunk``, or ``residual`` where level 5 failed too).

    1 cuts at white bands, 2 searches balanced paths through all bands, 3 walks from the start by structural evidence, 4 searches paths around seeds, 5
    searches all SAFE positions and keeps the furthest prefix.  Together the pieces tile the chapter.  Levels that nothing is left for are not run.
    """
    keys = list(keys)
    span = [*keys, "start", "end"]

    def settled(df: DataFrame, level: int, part: str = "chunk") -> DataFrame:
        return df.select(*span, F.lit(level).cast("long").alias("level"), F.lit(part).alias("part"))

    def regions(df: DataFrame) -> tuple[DataFrame, int]:
        left, n = cut_measured(df.select(*keys, F.col("start").alias("s"), F.col("end").alias("e")), "escalate")
        return left, n["rows"]

    one = cut(level1_partition(bands, totals, keys))
    out = settled(one.filter("status = 'passed'"), 1)
    left, n = regions(one.filter("status = 'failed'"))
    if not n:
        return out
    two = cut(balanced_path(left, bands, pages, keys=keys))
    out = out.unionByName(settled(two.filter("part = 'chunk'"), 2))
    left, n = regions(two.filter("part = 'residual'"))
    if not n:
        return out
    proven, stuck = residual_walk(decided, left, radius, keys=keys)
    out = out.unionByName(settled(proven, 3))
    left, n = regions(stuck)
    if not n:
        return out
    four = cut(directed(left, decided, keys))
    out = out.unionByName(settled(four, 4))
    whole = cut(point_join(four.withColumn("_at", F.col("start")), left, keys, "_at", ("s", "e")).select(*keys, "s").distinct())
    left, n = cut_measured(left.join(whole, [*keys, "s"], "left_anti"), "escalate")
    if not n["rows"]:
        return out
    five = cut(exhaustive_composition(left, decided.filter("decision = 'SAFE'").select(*keys, "y"), step, keys))
    return (out.unionByName(settled(five.filter("part <> 'residual'"), 5)).unionByName(settled(five.filter("part = 'residual' and start < end"), 5, "residual")))


def tiling_errors(pieces: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Per chapter: rows covered, gaps and overlaps of its pieces."""
    keys = list(keys)
    before = F.lag("end", 1, 0).over(W.partitionBy(*keys).orderBy("start", "end"))
    p = pieces.withColumn("_d", F.col("start") - before)
    per = p.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count_if(F.col("_d") > 0).alias("n_gaps"), F.count_if(F.col("_d") < 0).alias("n_overlaps"),
                               F.max("end").alias("last_row"))
    return totals.join(per, keys, "left")
