"""Compositions of stage pieces: union, coverage, tiling, splicing and the checks before they take effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripline.operators.blocks import id_blocks, lag_sparse, neighbours, overlap_join, overlap_semi, point_join, running

CH = ["ch"]
STAGE_ORDER = ["auto_merge", "level2", "level3", "level4", "level5", "review", "manual"]


def stage_rank(stage: str = "stage") -> Column:
    return F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col(stage))


def union_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """Pieces of all stages in one list, tagged."""
    out = None
    for name, df in stages.items():
        d = df.withColumn("stage", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def coverage_errors(pieces: DataFrame, ends: DataFrame, keys: Sequence[str] = CH, span: tuple[str, str] = ("g_start", "g_end"),
                    first: str | None = None, total: str = "total") -> DataFrame:
    """Gaps, overlaps, empty pieces and unfinished ends of a tiling of ``[first, total)``: (keys, kind, at, next).

    ``ends`` has one row per key with ``total`` and, where the tiling does not start at 0, ``first``.
    """
    keys, (s, e) = list(keys), span
    p = pieces.select(*keys, F.col(s).alias("_s"), F.col(e).alias("_e"))
    w = lag_sparse(p, keys, ["_s", "_e"], {"_prev": "_e"})
    head = ends.select(*keys, (F.col(first) if first else F.lit(0).cast("long")).alias("_first"), F.col(total).alias("_total"))
    w = w.join(head, keys).withColumn("_cursor", F.coalesce("_prev", "_first"))
    kinds = F.filter(F.array(
        F.when(F.col("_s") > F.col("_cursor"), "gap").when(F.col("_s") < F.col("_cursor"), "overlap"),
        F.when(F.col("_e") <= F.col("_s"), "empty")), lambda k: k.isNotNull())
    step = w.select(*keys, F.explode(kinds).alias("kind"), F.col("_cursor").alias("at"), F.col("_s").alias("next"))
    last = p.groupBy(*keys).agg(F.max_by("_e", F.struct("_s", "_e")).alias("_l"))
    tail = head.join(last, keys, "left").withColumn("_l", F.coalesce("_l", "_first")).filter("_l <> _total").select(
        *keys, F.lit("incomplete").alias("kind"), F.col("_l").alias("at"), F.col("_total").alias("next"))
    return step.unionByName(tail)


def pending_errors(pending: DataFrame, keys: Sequence[str] = CH, span: tuple[str, str] = ("g_start", "g_end"), total: str = "total") -> DataFrame:
    """Residual intervals that leave the chapter or overlap the one before."""
    s, e = F.col(span[0]), F.col(span[1])
    w = lag_sparse(pending, keys, list(span), {"_prev": span[1]})
    kinds = F.filter(F.array(F.when((s < 0) | (e > F.col(total)) | (e <= s), "out_of_range"), F.when(F.col("_prev") > s, "overlap")), lambda k: k.isNotNull())
    return w.select(*keys, *span, F.explode(kinds).alias("kind"))


def retiling_errors(parents: DataFrame, children: DataFrame, keys: Sequence[str] = CH, parent: tuple[str, str] = ("p_start", "p_end"),
                    child: tuple[str, str] = ("g_start", "g_end")) -> DataFrame:
    """Where the children do not tile their parent intervals exactly, and children without a parent."""
    keys = list(keys)
    p = parents.select(*keys, *parent)
    c = children.select(*keys, *child)
    j = point_join(c, p, keys, child[0], parent)
    ident = [*keys, *parent]
    errors = coverage_errors(j, p.select(*ident, F.col(parent[0]).alias("_ps"), F.col(parent[1]).alias("_pe")), ident, child, "_ps", "_pe")
    orphan = c.join(j.select(*keys, *child).distinct(), [*keys, *child], "left_anti").select(
        *keys, F.lit(None).cast("long").alias(parent[0]), F.lit(None).cast("long").alias(parent[1]), F.lit("orphan").alias("kind"),
        F.col(child[0]).alias("at"), F.col(child[1]).alias("next"))
    return errors.unionByName(orphan)


def drop_overlaps_and_repeats(pieces: DataFrame, ranges: DataFrame, keys: Sequence[str] = CH, span: tuple[str, str] = ("g_start", "g_end"),
                              rng: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Automatic pieces outside the manual ranges, an exact interval only once and from its earliest stage."""
    kept = overlap_semi(pieces, ranges, keys, span, rng, anti=True)
    return kept.groupBy(*keys, *span).agg(F.min_by("stage", stage_rank()).alias("stage"))


def needs_review(outputs: DataFrame, pending: DataFrame, centers: DataFrame, keys: Sequence[str] = CH, span: tuple[str, str] = ("s", "e"),
                 rng: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Outputs that meet a pending interval or, in chapters without one, touch a review cut; if none does, all are shown."""
    keys = list(keys)
    ident = [*keys, *span]
    hit = overlap_semi(outputs.select(*ident), pending, keys, span, rng).distinct().withColumn("_hit", F.lit(True))
    has = pending.select(*keys).distinct().withColumn("_has", F.lit(True))
    c = centers.select(*keys, "center").distinct()
    a = outputs.select(*ident).join(c.withColumnRenamed("center", span[0]), [*keys, span[0]], "left_semi")
    b = outputs.select(*ident).join(c.withColumnRenamed("center", span[1]), [*keys, span[1]], "left_semi")
    touch = a.unionByName(b).distinct().withColumn("_touch", F.lit(True))
    o = outputs.join(hit, ident, "left").join(touch, ident, "left").join(has, keys, "left")
    reason = F.when(F.col("_hit"), "auto_merge_pending_interval").when(F.col("_has").isNull() & F.col("_touch"), "review_cut_boundary")
    o = o.withColumn("reason", reason).drop("_hit", "_touch", "_has")
    n = o.groupBy(*keys).agg(F.count("reason").alias("_n"))
    return o.join(n, keys).withColumn("shown", F.col("reason").isNotNull() | (F.col("_n") == 0)).drop("_n")


def interval_difference(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``a`` and ``b`` that have no counterpart on the other side, duplicates counted, with their side."""
    both = a.select(*cols, F.lit(1).alias("_v")).unionByName(b.select(*cols, F.lit(-1).alias("_v")))
    d = both.groupBy(*cols).agg(F.sum("_v").alias("_v")).filter("_v <> 0")
    return d.select(*cols, F.when(F.col("_v") > 0, "left").otherwise("right").alias("side"), F.abs("_v").alias("times"))


def tile_from_cuts(regions: DataFrame, cuts: DataFrame, keys: Sequence[str], region: tuple[str, str] = ("g_start", "g_end"), cut: str = "cut") -> DataFrame:
    """Consecutive blocks of every region between its cuts, with relative and global bounds and a 1-based index."""
    keys = list(keys)
    marks = regions.select(*keys, F.explode(F.array(*region)).alias("_y")).unionByName(cuts.select(*keys, F.col(cut).alias("_y"))).distinct()
    num = running(id_blocks(marks, "_y"), keys, ["_y"], number="index").drop("_b")
    b = neighbours(num, keys, "index", {}, {"_n": "_y"}).filter("_n is not null")
    return b.join(regions.select(*keys, F.col(region[0]).alias("_r")), keys).select(
        *keys, "index", F.col("_y").alias("start"), F.col("_n").alias("end"), (F.col("_y") - F.col("_r")).alias("rel_start"), (F.col("_n") - F.col("_r")).alias("rel_end"))


def cut_errors(regions: DataFrame, cuts: DataFrame, keys: Sequence[str], region: tuple[str, str] = ("g_start", "g_end"), cut: str = "cut", order: str = "ord") -> DataFrame:
    """Cut lists that are empty, repeat a cut, leave the region or do not ascend.  ``order`` numbers the list from 1."""
    keys = list(keys)
    none = regions.join(cuts.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("empty").alias("kind"), F.lit(None).cast("long").alias("cut"))
    c = cuts.join(regions.select(*keys, *region), keys)
    out = c.filter((F.col(cut) <= F.col(region[0])) | (F.col(cut) >= F.col(region[1]))).select(*keys, F.lit("out_of_range").alias("kind"), F.col(cut).alias("cut"))
    dup = cuts.groupBy(*keys, cut).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys, F.lit("duplicate").alias("kind"), F.col(cut).alias("cut"))
    asc = neighbours(cuts, keys, order, {"_p": cut}).filter(F.col(cut) <= F.col("_p")).select(*keys, F.lit("not_ascending").alias("kind"), F.col(cut).alias("cut"))
    return none.unionByName(out).unionByName(dup).unionByName(asc)


def contiguous(selection: DataFrame, outputs: DataFrame, ident: Sequence[str], keys: Sequence[str], index: str = "seg", span: tuple[str, str] = ("g_start", "g_end")) -> DataFrame:
    """Selected outputs per ``ident``: all known, indices without a hole, and the region they span."""
    j = selection.join(outputs.select(*keys, index, *span), [*keys, index], "left")
    g = j.groupBy(*ident).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(span[0]).isNull()).alias("unknown"), F.min(index).alias("_a"), F.max(index).alias("_z"),
        F.min_by(span[0], index).alias("region_start"), F.max_by(span[1], index).alias("region_end"))
    return g.withColumn("ok", (F.col("unknown") == 0) & (F.col("_z") - F.col("_a") + 1 == F.col("n"))).drop("_a", "_z")


def current_cuts(selection: DataFrame, keys: Sequence[str], span: tuple[str, str] = ("g_start", "g_end")) -> DataFrame:
    """Boundaries strictly inside a selected region; a selection without one gets a row with the problem."""
    keys = list(keys)
    r = selection.groupBy(*keys).agg(F.min(span[0]).alias("_s"), F.max(span[1]).alias("_e"))
    b = selection.select(*keys, F.explode(F.array(*span)).alias("cut")).distinct().join(r, keys).filter("cut > _s and cut < _e")
    none = r.join(b.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(None).cast("long").alias("cut"), F.lit("no_internal_cut").alias("problem"))
    return b.select(*keys, "cut", F.lit(None).cast("string").alias("problem")).unionByName(none)


def splice(outputs: DataFrame, replaced: DataFrame, proposal: DataFrame, keys: Sequence[str], index: str = "seg") -> DataFrame:
    """Outputs with the replaced indices taken out and the proposal's pieces put in."""
    kept = outputs.join(replaced.select(*keys, index).distinct(), [*keys, index], "left_anti")
    cols = [*keys, "g_start", "g_end", "stage"]
    return kept.select(*cols).unionByName(proposal.withColumn("stage", F.lit("balance")).select(*cols))


def manual_candidate(pieces: DataFrame, manual: DataFrame, selected: DataFrame, pending: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Errors that stop a final composition: pending outside the selection, manual blocks outside it, and coverage.

    ``selected``: keys, ``r_start``, ``r_end``; pieces, manual and pending have ``g_start`` and ``g_end``.
    """
    keys = list(keys)
    sel = selected.select(*keys, "r_start", "r_end")

    def outside(df, kind):
        return df.select(*keys, "g_start", "g_end").join(sel, keys).filter("g_start < r_start or g_end > r_end").select(
            *keys, F.lit(kind).alias("kind"), F.col("g_start").alias("at"), F.col("g_end").alias("next"))

    auto = drop_overlaps_and_repeats(pieces.join(sel.select(*keys), keys, "left_semi"), sel, keys)
    all_ = auto.select(*keys, "g_start", "g_end").unionByName(manual.select(*keys, "g_start", "g_end"))
    cover = coverage_errors(all_, totals.join(sel.select(*keys), keys, "left_semi"), keys)
    return outside(pending, "pending_outside").unionByName(outside(manual, "manual_outside")).unionByName(cover)


def manual_range(requests: DataFrame, block_pages: DataFrame, ident: Sequence[str]) -> DataFrame:
    """Region of a selection from ``start_file`` to ``end_file`` inside a pending block, clipped to the block.

    ``block_pages``: ident, ``b_start``, ``b_end``, ``file``, ``page_no``, ``gs``, ``ge``.
    """
    p = block_pages
    a = p.select(*ident, F.col("file").alias("start_file"), F.col("page_no").alias("_a"), F.greatest("b_start", "gs").alias("region_start"))
    z = p.select(*ident, F.col("file").alias("end_file"), F.col("page_no").alias("_z"), F.least("b_end", "ge").alias("region_end"))
    j = requests.join(a, [*ident, "start_file"], "left").join(z, [*ident, "end_file"], "left")
    problem = (F.when(F.col("_a").isNull() | F.col("_z").isNull(), "file_outside_block").when(F.col("_z") < F.col("_a"), "end_before_start")
               .when(F.col("region_end") <= F.col("region_start"), "empty_region"))
    ok = problem.isNull()
    return j.withColumns({"problem": problem, "page_count": F.when(ok, F.col("_z") - F.col("_a") + 1), "region_start": F.when(ok, F.col("region_start")),
                          "region_end": F.when(ok, F.col("region_end"))}).drop("_a", "_z")


def review_pieces(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces of reviewed regions from their boundary and output-name arrays.

    Missing end bounds are added; a region whose names do not fit its bounds is left out; an empty block is an error.
    """
    b = F.col("boundaries")
    b = F.when((F.size(b) == 0) | (F.element_at(F.concat(b, F.array(F.lit(-1).cast("long"))), 1) != F.col("g_start")), F.array_prepend(b, F.col("g_start"))).otherwise(b)
    r = regions.withColumn("_b", b)
    r = r.withColumn("_b", F.when(F.element_at("_b", -1) != F.col("g_end"), F.array_append("_b", F.col("g_end"))).otherwise(F.col("_b")))
    r = r.filter(F.size("outputs") == F.size("_b") - 1)
    z = F.arrays_zip(F.slice("_b", F.lit(1), F.size("_b") - 1).alias("s"), F.slice("_b", F.lit(2), F.size("_b")).alias("e"), F.col("outputs").alias("name"))
    x = r.select(*keys, F.posexplode(z).alias("index", "p"))
    return x.select(*keys, "index", F.col("p")["s"].alias("start"), F.col("p")["e"].alias("end"), F.col("p")["name"].alias("name"),
                    F.when(F.col("p")["e"] <= F.col("p")["s"], "empty_block").alias("problem"))


def first_seen(rows: DataFrame, keys: Sequence[str], item: str, order: str) -> DataFrame:
    """Distinct items with the place they are first seen."""
    return rows.groupBy(*keys, item).agg(F.min(order).alias("first_at"))


def absorption(pieces: DataFrame, totals: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Share of the height each stage took, per chapter and over all chapters (key null)."""
    keys = list(keys)
    h = pieces.groupBy(*keys, "stage").agg(F.sum(F.col("g_end") - F.col("g_start")).alias("height"))
    own = h.join(totals.select(*keys, "total"), keys)
    every = own.groupBy("stage").agg(F.sum("height").alias("height")).withColumn("total", totals.agg(F.sum("total")).scalar())
    for k in keys:
        every = every.withColumn(k, F.lit(None).cast(dict(totals.dtypes)[k]))
    return own.unionByName(every.select(*own.columns)).withColumn("share", F.col("height") / F.col("total"))


def joined_pages(intervals: DataFrame, pages: DataFrame, keys: Sequence[str] = CH, span: tuple[str, str] = ("g_start", "g_end")) -> DataFrame:
    return overlap_join(intervals, pages.select(*keys, "file", "page_no", "gs", "ge"), keys, span, ("gs", "ge"))


def approval_problems(proposals: DataFrame, outputs: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What forbids the approval of each proposal: keys and ``problem``, the first that holds, or null.

    ``proposals``: keys, ``scope`` (null, or ``pending_segments``); ``outputs``: keys, ``i`` from 0, ``width``, ``height``; ``bounds``: keys, ``i``, ``y``.
    All outputs have one width, there is one bound more than outputs, and each output is as high as its bounds are apart.
    """
    keys = list(keys)
    b = bounds.select(*keys, "i", "y")
    pair = b.join(b.select(*keys, (F.col("i") - 1).alias("i"), F.col("y").alias("y2")), [*keys, "i"], "left")
    o = outputs.select(*keys, "i", "width", "height").join(pair, [*keys, "i"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.min("width") != F.max("width")).alias("_wide"), F.count_if(F.coalesce(F.col("y2") - F.col("y") != F.col("height"), F.lit(True))).alias("_high"))
    n = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    j = proposals.select(*keys, "scope").join(o, keys, "left").join(n, keys, "left")
    problem = (F.when(F.col("scope").isNotNull() & (F.col("scope") != "pending_segments"), "scope_not_supported").when(F.col("_n").isNull(), "no_images")
               .when(F.coalesce("_m", F.lit(0)) != F.col("_n") + 1, "bounds_do_not_fit_outputs").when(F.col("_wide"), "widths_differ").when(F.col("_high") > 0, "height_differs_from_bounds"))
    return j.select(*keys, problem.alias("problem"))
