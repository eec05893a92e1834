"""Greedy cuts at safe bands and the partitions, rescues and proposals built on them.

Every position has one successor, so each walk is an orbit over a table of edges (see ``blocks.orbit``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.operators.blocks import best, next_at_or_after, orbit, point_join
from stripline.session import cut

CH = ["ch"]
# Fixed values of the domain.
TARGET, BEFORE, AFTER = 7000, 1800, 2500
MIN_CHUNK, MAX_CHUNK, MIN_BAND = 3000, 12000, 150
REVIEW_MAX = 13000


def eligible_white(bands: DataFrame) -> DataFrame:
    return bands.filter((F.col("kind") == "white_band") & (F.col("height") >= MIN_BAND))


def positions(bands: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Every place a cut walk can stand: the chapter's start and the eligible white bands."""
    keys = list(keys)
    start = totals.select(*keys, F.lit(0).cast("long").alias("cur"), "total")
    inner = eligible_white(bands).select(*keys, F.col("center").alias("cur"), "total").distinct()
    return start.unionByName(inner).distinct()


def candidates(at: DataFrame, bands: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """White bands in the search window of every position, with distance and window flag."""
    keys = list(keys)
    cur, total = F.col("cur"), F.col("total")
    low = cur + max(MIN_CHUNK, TARGET - BEFORE)
    hard = F.least(total - MIN_CHUNK, cur + MAX_CHUNK)
    w = at.filter(total - cur > TARGET + AFTER).withColumns({"_lo": low, "_hi": hard + 1}).filter("_lo < _hi")
    white = bands.filter("kind = 'white_band'").select(*keys, "center", "height", "ratio")
    j = point_join(white, w, keys, "center", ("_lo", "_hi")).filter(F.col("center") > cur + MIN_CHUNK)
    return j.withColumns({
        "distance": F.col("center") - cur - TARGET, "normal": F.col("center") <= F.least(total - MIN_CHUNK, cur + TARGET + AFTER),
    }).drop("_lo", "_hi")


def next_cut_edges(bands: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """The one next cut of every position: nearest the target inside the window, else the next band forward."""
    keys = list(keys)
    c = candidates(positions(bands, totals, keys), bands, keys).filter(F.col("height") >= MIN_BAND)
    n = F.col("normal")
    order = [F.when(n, 0).otherwise(1), F.when(n, F.abs("distance")).otherwise(F.col("center")),
             F.when(n, -F.col("height")).otherwise(F.lit(0)), F.when(n, -F.col("ratio")).otherwise(F.lit(0.0)), F.col("center")]
    picked = best(c, [*keys, "cur", "total"], order)
    reason = F.when(F.col("normal"), "safe_band_near_target").otherwise("next_safe_band_forward")
    return picked.select(*keys, "cur", "total", F.col("center").alias("nxt"), "height", "distance", reason.alias("reason"))


def walk(edges: DataFrame, starts: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Rows of ``edges(keys, cur, nxt)`` met from ``starts(keys, cur)``."""
    keys = list(keys)
    e = edges.select(*keys, F.col("cur").alias("pos"), "nxt")
    return orbit(e, starts.select(*keys, F.col("cur").alias("pos")), keys).select(*keys, F.col("pos").alias("cur"), "nxt")


def origin(totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    return totals.select(*keys, F.lit(0).cast("long").alias("cur"))


def greedy_cut_path(bands: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Chosen cuts from the chapter's start: (cur, nxt).  No cut is forced."""
    return walk(next_cut_edges(bands, totals, keys), origin(totals, keys), keys)


def chunks(path: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Chunks of a walk: its steps and the rest up to the chapter's end."""
    keys = list(keys)
    done = path.filter("nxt is not null").select(*keys, F.col("cur").alias("start"), F.col("nxt").alias("end"))
    last = totals.join(done.groupBy(*keys).agg(F.max("end").alias("_l")), keys, "left").select(
        *keys, F.coalesce("_l", F.lit(0)).alias("start"), F.col("total").alias("end"))
    return done.unionByName(last.filter("start < end")).withColumn("height", F.col("end") - F.col("start"))


def cut_decisions(bands: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Every band of the windows on the walk: selected, not selected or rejected, with the reason."""
    keys = list(keys)
    path = cut(greedy_cut_path(bands, totals, keys))
    stood = path.select(*keys, "cur", "nxt").unionByName(
        chunks(path, totals, keys).filter("true").join(totals.select(*keys, F.col("total").alias("end")), [*keys, "end"], "left_semi")
        .select(*keys, F.col("start").alias("cur"), F.lit(None).cast("long").alias("nxt")))
    c = candidates(stood.join(totals.select(*keys, "total"), keys), bands, keys)
    short, chosen = F.col("height") < MIN_BAND, F.col("center") == F.col("nxt")
    return c.withColumns({
        "decision": F.when(short, "rejected").when(chosen, "selected").otherwise("not_selected"),
        "reason": F.when(short, "white_band_too_short").when(chosen & F.col("normal"), "safe_band_near_target").when(chosen, "next_safe_band_forward")
        .when(F.col("normal"), "another_safe_band_ranked_better").otherwise("forward_candidate_not_needed")})


def level1_partition(bands: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Segments passed or failed by height; after the first failure the walk restarts once at the next band beyond the maximum."""
    keys = list(keys)
    edges = cut(next_cut_edges(bands, totals, keys))
    first = cut(chunks(walk(edges, origin(totals, keys), keys), totals, keys))
    stuck = first.filter(F.col("height") > MAX_CHUNK).join(totals.select(*keys, "total"), keys).withColumn("_at", F.col("start") + MAX_CHUNK + 1)
    ends = eligible_white(bands).filter(F.col("center") <= F.col("total") - MIN_CHUNK).select(*keys, F.col("center").alias("pos"))
    rescue = next_at_or_after(stuck, ends, keys, "_at", "rescue").filter("rescue is not null")
    jump = rescue.select(*keys, "start", F.col("rescue").alias("end"))
    jump = cut(jump)
    again = walk(edges, jump.select(*keys, F.col("end").alias("cur")), keys)
    again = cut(again)
    steps = again.select(*keys, F.col("cur").alias("start"), F.col("nxt").alias("end"))
    tail = jump.select(*keys, F.col("end").alias("_r")).join(steps.groupBy(*keys).agg(F.max("end").alias("_l")), keys, "left").join(
        totals.select(*keys, "total"), keys).select(*keys, F.coalesce("_l", "_r").alias("start"), F.col("total").alias("end"))
    kept = first.select(*keys, "start", "end").join(jump.select(*keys, "start"), [*keys, "start"], "left_anti")
    all_ = kept.unionByName(jump).unionByName(steps).unionByName(tail)
    h = F.col("end") - F.col("start")
    return all_.filter("start < end").withColumns({"height": h, "status": F.when(h <= MAX_CHUNK, "passed").otherwise("failed")})


def review_edges(bands: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Next cut of a review proposal: the greedy one, else the last strict band, else the first up to 13000, else the first beyond."""
    keys = list(keys)
    at = positions(bands, totals, keys)
    greedy = cut(next_cut_edges(bands, totals, keys).select(*keys, "cur", "nxt", F.lit("greedy").alias("strategy")))
    cur, total = F.col("cur"), F.col("total")
    open_ = at.filter(total - cur > MAX_CHUNK).join(greedy, [*keys, "cur"], "left_anti")
    hard = F.least(total - MIN_CHUNK, cur + MAX_CHUNK)
    white = eligible_white(bands).select(*keys, "center")
    near = point_join(white, open_.withColumns({"_lo": cur + MIN_CHUNK, "_hi": F.least(total - MIN_CHUNK, cur + REVIEW_MAX) + 1}).filter("_lo < _hi"),
                      keys, "center", ("_lo", "_hi"))
    near = near.groupBy(*keys, "cur").agg(
        F.max(F.when(F.col("center") <= hard, F.col("center"))).alias("strict"),
        F.min(F.when(F.col("center") > hard, F.col("center"))).alias("extension"))
    far_targets = eligible_white(bands).filter(F.col("center") <= F.col("total") - MIN_CHUNK).select(*keys, F.col("center").alias("pos"))
    far = next_at_or_after(open_.withColumn("_at", F.col("cur") + REVIEW_MAX + 1), far_targets, keys, "_at", "far").drop("_at")
    j = far.join(near, [*keys, "cur"], "left")
    rest = j.select(*keys, "cur", F.coalesce("strict", "extension", "far").alias("nxt"),
                    F.when(F.col("strict").isNotNull(), "strict_safe_zone").when(F.col("extension").isNotNull(), "strict_small_extension")
                    .when(F.col("far").isNotNull(), "strict_extended_safe_zone").otherwise("no_safe_band").alias("strategy"))
    return greedy.unionByName(rest)


def review_proposal(bands: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Cuts of a review proposal with their strategy; a row without ``nxt`` says that the chapter has no proposal."""
    keys = list(keys)
    e = cut(review_edges(bands, totals, keys))
    return walk(e, origin(totals, keys), keys).select(*keys, "cur").join(e, [*keys, "cur"])


def source_limit_cuts(segments: DataFrame, bands: DataFrame, pages: DataFrame, limit: int, keys: Sequence[str] = CH) -> DataFrame:
    """Extra cuts so that no segment uses more than ``limit`` pages: the best white band, else the best uniform one.

    A row without ``nxt`` is a place where no band allows the limit.
    """
    keys = list(keys)
    all_ = bands.filter((F.col("kind") != "white_band") | (F.col("height") >= MIN_BAND)).select(*keys, "center", "kind", "height", "ratio", "std").distinct()
    seg = segments.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"))
    inside = point_join(all_.select(*keys, F.col("center").alias("cur")).distinct(), seg, keys, "cur", ("s", "e")).filter("cur > s")
    at = seg.withColumn("cur", F.col("s")).unionByName(inside)
    p = pages.select(*keys, "page_no", "gs", "ge")
    here = point_join(at, p, keys, "cur", ("gs", "ge")).withColumnRenamed("page_no", "first_no").drop("gs", "ge")
    last = point_join(here.withColumn("_l", F.col("e") - 1), p, keys, "_l", ("gs", "ge")).withColumnRenamed("page_no", "last_no").drop("gs", "ge", "_l")
    over = last.filter(F.col("last_no") - F.col("first_no") + 1 > limit).withColumn("page_no", F.col("first_no") + limit - 1)
    over = over.join(p.select(*keys, "page_no", F.col("ge").alias("allowed_end")), [*keys, "page_no"]).select(*keys, "cur", "e", "allowed_end")
    w = over.withColumns({"_lo": F.col("cur") + MIN_CHUNK, "_hi": F.least("allowed_end", F.col("e") - MIN_CHUNK) + 1})
    c = point_join(all_, w.filter("_lo < _hi"), keys, "center", ("_lo", "_hi"))
    white = F.col("kind") == "white_band"
    order = [F.when(white, 0).otherwise(1), F.abs(F.col("center") - F.col("cur") - TARGET),
             F.when(white, -F.col("height")).otherwise(F.col("std")), F.when(white, -F.col("ratio")).otherwise(F.lit(0.0)), F.col("center")]
    pick = best(c, [*keys, "cur"], [o.cast("double") for o in order]).select(*keys, "cur", F.col("center").alias("nxt"), "kind")
    edges = cut(over.select(*keys, "cur").join(pick, [*keys, "cur"], "left"))
    return walk(edges, seg.select(*keys, F.col("s").alias("cur")), keys).select(*keys, "cur").join(edges, [*keys, "cur"])
