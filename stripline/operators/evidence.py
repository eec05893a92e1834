"""Structural decisions, rankings and candidate searches over a table of evidence per position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripline.functions.rules import cut_rule, text_like
from stripline.operators.blocks import best, point_join, sessions, top_k

CH = ["ch"]
METRICS = ["band_std", "edge_density", "crossing_components", "diagonal_crossings", "text_fx_clusters", "text_fx_background_std"]


def decide(evidence: DataFrame) -> DataFrame:
    """Evidence with decision, reason and the text-like flag."""
    return evidence.withColumn("_v", cut_rule()).withColumns({
        "decision": F.col("_v.decision"), "reason": F.col("_v.reason"),
        "text_like": text_like(F.col("text_fx_clusters"), F.col("text_fx_background_std"))}).drop("_v")


def safe_only(evidence: DataFrame) -> DataFrame:
    return decide(evidence).filter("decision = 'SAFE'")


def decision_histogram(decided: DataFrame) -> DataFrame:
    """Counts by decision and by reason in one pass."""
    g = decided.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("_n"))
    two = g.select(F.explode(F.array(F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("value")),
                                     F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("value")))).alias("k"), "_n")
    return two.groupBy(F.col("k.kind").alias("kind"), F.col("k.value").alias("value")).agg(F.sum("_n").alias("n"))


def top_reasons(decided: DataFrame, k: int) -> DataFrame:
    return decided.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def metric_ranges(decided: DataFrame, keys: Sequence[str] = CH, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Lowest and highest value of every metric; nulls are skipped."""
    a = decided.groupBy(*keys).agg(*[f(F.col(m).cast("double")).alias(f"{n}_{m}") for m in metrics for n, f in (("min", F.min), ("max", F.max))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"min_{m}").alias("lo"), F.col(f"max_{m}").alias("hi")) for m in metrics])
    return a.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").filter("lo is not null")


def local_search(decided: DataFrame, nominal: DataFrame, radius: int = 200, keys: Sequence[str] = CH) -> DataFrame:
    """For every UNSAFE nominal position the best SAFE one within the radius; other decisions stay as they are.

    Ranked by edge density, crossing components, distance, then upwards.  The search is a range join of bounded reach.
    """
    keys = list(keys)
    safe = decided.filter("decision = 'SAFE'").select(*keys, F.col("y").alias("alt_y"), F.col("edge_density").alias("alt_edge"),
                                                      F.col("crossing_components").alias("alt_components"))
    look = nominal.filter("decision = 'UNSAFE'").select(*keys, "y", (F.col("y") - radius).alias("_lo"), (F.col("y") + radius + 1).alias("_hi"))
    look = look.withColumn("_lo", F.greatest("_lo", F.lit(0)))
    found = point_join(safe, look, keys, "alt_y", ("_lo", "_hi"), max(64, 4 * radius)).filter("alt_y <> y")  # a bucket holds few windows
    ranked = best(found.withColumn("_up", F.when(F.col("alt_y") < F.col("y"), 0).otherwise(1)), [*keys, "y"],
                  [F.col("alt_edge"), F.col("alt_components"), F.abs(F.col("alt_y") - F.col("y")), F.col("_up")])
    return nominal.join(ranked.select(*keys, "y", "alt_y", "alt_edge"), [*keys, "y"], "left").withColumn(
        "chosen", F.when(F.col("decision") == "SAFE", F.col("y")).otherwise(F.col("alt_y")))


def seeds_per_bin(candidates: DataFrame, lower: Column, upper: Column, bin_height: int = 3000, seeds: int = 3, keys: Sequence[str] = CH) -> DataFrame:
    """The flattest positions of every bin of the axis."""
    c = candidates.withColumns({"lower": lower, "upper": upper}).filter((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper")))
    c = c.withColumns({"bin": F.floor((F.col("y") - F.col("lower")) / bin_height),
                       "score": F.col("band_std") / F.lit(10.0) + F.col("edge_density") / F.lit(0.015)})
    return top_k(c, [*keys, "bin"], [F.col("score"), F.col("edge_density"), F.col("band_std"), F.col("y")], seeds, "seed_rank")


def _reach(seeds: DataFrame, radius: int, keys: Sequence[str]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Seeds and their bounds ``lo`` and ``hi`` by the buckets ``_k`` of the axis that they reach into, and the bucket of a position."""
    wide = max(1 << 12, 4 * radius)
    lo, hi, y = F.greatest(F.col("lower"), F.col("y") - radius), F.least(F.col("upper"), F.col("y") + radius), F.col("y")
    bucket = lambda at: F.floor(at / wide)
    reach = seeds.select(*keys, F.struct(lo.alias("lo"), hi.alias("hi"), "y").alias("seed"), F.explode(F.sequence(bucket(F.least(lo, y)), bucket(F.greatest(hi, y)))).alias("_k"))
    return reach.groupBy(*keys, "_k").agg(F.collect_list("seed").alias("seeds")), bucket


def refine(seeds: DataFrame, radius: int = 128, step: int = 8, keys: Sequence[str] = CH) -> DataFrame:
    """Positions around every seed, the seed itself included, once each.

    Seeds meet in the buckets of the axis that they reach into, and a bucket gives its own positions only: so the few seeds are exchanged, not the many
    positions, and no task holds more of these at a time than a bucket's.
    """
    met, bucket = _reach(seeds, radius, keys)
    around = F.flatten(F.transform("seeds", lambda x: F.array_append(F.sequence(x["lo"], x["hi"], F.lit(step).cast("long")), x["y"])))
    return met.select(*keys, F.explode(F.array_distinct(F.filter(around, lambda at: bucket(at) == F.col("_k")))).alias("y"))


def near_seeds(points: DataFrame, seeds: DataFrame, radius: int = 128, step: int = 8, keys: Sequence[str] = CH) -> DataFrame:
    """The points that are among the positions of :func:`refine`.

    A point is looked up in the few seeds of its bucket, so the positions, of which there are many more than points, are never made.
    """
    keys = list(keys)
    met, bucket = _reach(seeds, radius, keys)
    on_step = lambda x: (F.col("y") >= x["lo"]) & (F.col("y") <= x["hi"]) & ((F.col("y") - x["lo"]) % step == 0)
    near = points.withColumn("_k", bucket(F.col("y"))).join(met, [*keys, "_k"])
    return near.filter(F.exists("seeds", lambda x: (x["y"] == F.col("y")) | on_step(x))).select(*points.columns)


def axis_grid(regions: DataFrame, lo: Column, hi: Column, step: int, name: str = "pos") -> DataFrame:
    """Positions ``lo, lo+step, .. hi`` of every region, in two explodes so that no array grows with the region."""
    chunk = step * 4096
    r = regions.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")}).filter("_lo <= _hi")
    r = r.withColumn("_c", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(chunk).cast("long"))))
    return r.withColumn(name, F.explode(F.sequence(F.col("_c"), F.least(F.col("_hi"), F.col("_c") + chunk - step), F.lit(step).cast("long")))).drop("_lo", "_hi", "_c")


def window_sweep(regions: DataFrame, keys: Sequence[str], start: str, end: str, count: int = 3, radius: int = 200, step: int = 2) -> DataFrame:
    """Window centres of a region: ideal targets, one centre every two radii with its parity twin, and the last ones."""
    keys = list(keys)
    s, e = F.col(start), F.col(end)
    first, last = s + radius, e - radius
    ideal = F.transform(F.sequence(F.lit(1), F.lit(count - 1)), lambda i: (s + F.round((e - s) / F.lit(float(count)) * i)).cast("long"))
    extra = F.when(first <= last, F.array(last, last - 1)).otherwise(F.array(F.floor((s + e) / 2)))
    fixed = regions.select(*keys, start, end, F.explode(F.concat(ideal, extra)).alias("center"))
    fixed = fixed.filter((F.col("center") != F.col(end) - radius - 1) | (F.col("center") >= F.col(start) + radius) | F.lit(step <= 1))
    grid = axis_grid(regions.select(*keys, start, end), first, last, 2 * radius, "center")
    twin = grid.filter(F.col("center") + 1 <= F.col(end) - radius).withColumn("center", F.col("center") + 1)
    all_ = fixed.unionByName(grid).unionByName(twin) if step > 1 else fixed.unionByName(grid)
    return all_.filter((F.col("center") > F.col(start)) & (F.col("center") < F.col(end))).select(*keys, "center").distinct()


def estimate_validations(height: Column, min_chunk: int = 3000, bin_height: int = 3000, seeds: int = 3, radius: int = 128, step: int = 8) -> Column:
    """Upper bound of the positions a directed search classifies."""
    span = height - 2 * min_chunk + 1
    bins = F.greatest(F.lit(1), F.floor((span + bin_height - 1) / bin_height))
    return F.when(span < 1, F.lit(0)).otherwise(bins * seeds * ((2 * radius) // step + 2)).cast("long")


def safe_zones(safe: DataFrame, gap: int = 2, keys: Sequence[str] = CH) -> DataFrame:
    """Groups of neighbouring SAFE positions, each with the representative nearest its centre."""
    keys = list(keys)
    z = sessions(safe, keys, "y", gap).withColumns({"zone_start": F.col("start"), "zone_end": F.col("last") + 1}).drop("start", "last", "n")
    p = point_join(safe.select(*keys, "y", "edge_density", "crossing_components"), z, keys, "y", ("zone_start", "zone_end"), 1 << 9)
    mid = (F.col("zone_start") + F.col("zone_end") - 1) / 2.0
    n = p.groupBy(*keys, "zone_start", "zone_end").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("y", "edge_density", "crossing_components"), F.struct(F.abs(F.col("y") - mid), "edge_density", "crossing_components", "y")).alias("_r"))
    return n.select(*keys, "zone_start", "zone_end", "n", "_r.*")


def anchor_candidates(anchors: DataFrame, safe: DataFrame, limit: int = 64, keys: Sequence[str] = CH) -> DataFrame:
    """The nearest SAFE positions of every anchor's corridor, ranked.

    ``anchors``: keys, ``anchor_y``, ``left``, ``right``.  The corridor's radius follows the room to both neighbours.
    """
    keys = list(keys)
    a = F.col("anchor_y")
    room = F.least(F.greatest(a - F.col("left"), F.lit(1)), F.greatest(F.col("right") - a, F.lit(1)))
    radius = F.least(F.lit(1800.0), F.greatest(F.lit(240.0), F.lit(0.35) * room)).cast("long")
    c = anchors.withColumns({"_lo": F.greatest(F.col("left") + 1, a - radius), "_hi": F.least(F.col("right") - 1, a + radius) + 1}).filter("_lo < _hi")
    j = point_join(safe.select(*keys, "y", "edge_density", "crossing_components"), c, keys, "y", ("_lo", "_hi"))
    j = j.withColumn("distance", F.abs(F.col("y") - a))
    near = top_k(j, [*keys, "anchor_y"], [F.col("distance"), F.col("y")], limit, "_near")
    return top_k(near.drop("_lo", "_hi", "_near"), [*keys, "anchor_y"], [F.col("distance"), F.col("edge_density"), F.col("crossing_components"), F.col("y")], limit)


def anchor_snap(anchors: DataFrame, boundaries: DataFrame, safe: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Anchors on a source boundary stay; the others move to their best SAFE position; the result must increase strictly.

    A region has at most seven anchors (three ruptures, two islands of two ends).
    """
    from pyspark.sql import Window as W

    keys = list(keys)
    at = anchors.join(boundaries.select(*keys, F.col("y").alias("anchor_y")).distinct().withColumn("on_boundary", F.lit(True)), [*keys, "anchor_y"], "left")
    first = anchor_candidates(anchors, safe, keys=keys).filter("rank = 1").select(*keys, "anchor_y", F.col("y").alias("safe_y"))
    s = at.join(first, [*keys, "anchor_y"], "left").withColumn("snapped_y", F.when(F.col("on_boundary"), F.col("anchor_y")).otherwise(F.col("safe_y")))
    prev = F.lag("snapped_y").over(W.partitionBy(*keys).orderBy("anchor_y"))
    return s.withColumns({
        "snap_source": F.when(F.col("on_boundary"), "source_boundary").when(F.col("safe_y").isNotNull(), "safe_candidate").otherwise("none"),
        "order_ok": F.col("snapped_y").isNotNull() & F.coalesce(F.col("snapped_y") > prev, F.lit(True))})


def residual_walk(decided: DataFrame, regions: DataFrame, radius: int = 200, max_chunk: int = 12000, keys: Sequence[str] = CH) -> tuple[DataFrame, DataFrame]:
    """Walk every region from its start: the next cut is the position ``max_chunk`` further or its best SAFE neighbour.

    Returns the proven pieces and the residuals with the reason that stopped the walk; a position without evidence proves nothing, so it ends the walk
    with the reason ``no_evidence``.  ``regions``: keys, ``s``, ``e``; a key may have several that don't overlap.
    """
    from stripline.functions.rules import scene_guard
    from stripline.operators.blocks import orbit
    from stripline.operators.paths import ZONE, into_zones, zoned
    from stripline.session import cut

    r = zoned(regions.select(*keys, "s", "e"))
    stops = into_zones(decided.filter("decision = 'SAFE'").select(*keys, F.col("y").alias("cur")), r, list(keys), "cur").join(r, [*keys, ZONE])
    near, keys = list(keys), [*keys, ZONE]
    at = r.withColumn("cur", F.col("s")).unionByName(stops.select(*keys, "s", "e", "cur")).distinct().filter(F.col("e") - F.col("cur") > max_chunk)
    nominal = at.withColumn("y", F.col("cur") + max_chunk)
    look = nominal.join(decided.select(*near, "y", "decision", "reason", "edge_density"), [*near, "y"], "left")
    found = local_search(decided, look.filter("decision is not null").select(*near, "y", "decision").distinct(), radius, near).select(*near, "y", "chosen")
    e = look.join(found, [*near, "y"], "left").withColumn(
        "nxt", F.when((F.col("chosen") > F.col("cur")) & (F.col("chosen") < F.col("e")), F.col("chosen")))
    e = cut(e.select(*keys, "s", "e", "cur", "nxt", "decision", F.when(F.col("decision").isNull(), "no_evidence").otherwise(F.col("reason")).alias("reason")))
    seen = cut(orbit(e.select(*keys, F.col("cur").alias("pos"), "nxt"), r.select(*keys, F.col("s").alias("pos")), keys)
               .select(*keys, F.col("pos").alias("cur")).join(e, [*keys, "cur"]))
    steps = seen.filter("nxt is not null").select(*keys, F.col("cur").alias("start"), F.col("nxt").alias("end"), "reason")
    stuck = seen.filter("nxt is null")
    guard = F.when(F.col("decision").isNotNull(), scene_guard(F.col("e") - F.col("cur")))
    residual = stuck.select(*near, F.col("cur").alias("start"), "e", "decision", F.col("reason").alias("trigger_reason"),
                            F.coalesce(guard, F.col("reason")).alias("reason")).withColumnRenamed("e", "end")
    last = r.join(stuck.select(*keys), keys, "left_anti").join(steps.groupBy(*keys).agg(F.max("end").alias("_l")), keys, "left").select(
        *keys, F.coalesce("_l", "s").alias("start"), F.col("e").alias("end"), F.lit("remaining_within_max_height").alias("reason"))
    fits = F.assert_true(F.col("end") - F.col("start") <= max_chunk, F.lit("a piece without evidence would count as proven"))
    last = last.filter("start < end").withColumn("reason", F.when(fits.isNull(), F.col("reason")))
    return steps.unionByName(last).drop(ZONE), residual
