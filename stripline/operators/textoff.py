"""Text removal: associations of text and regions, masks, boxes and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.functions.geometry import CONTAINMENT, OCR_CONF, containment, detector_gate
from stripline.operators.blocks import best, overlap_join, overlap_semi, point_join, range_blocks, running, spread
from stripline.operators.graph import components, joined
from stripline.progress import cut_measured
from stripline.session import cut

PAGE = ["page"]
GAP = 18
CELL = 512  # pixels of a grid cell
PER_TASK = 50_000  # boxes compared by one task
PAGE_BOXES = 20_000  # boxes of a page that one task merges alone
BOX = ("x1", "y1", "x2", "y2")


def gate(detections: DataFrame) -> DataFrame:
    g = detector_gate(F.col("conf"), F.col("bright_ratio"), F.col("brightness"), F.col("texture"))
    return detections.withColumn("_g", g).withColumns({"gate_ok": F.col("_g.gate_ok"), "reason": F.col("_g.reason")}).drop("_g")


def text_in_regions(texts: DataFrame, regions: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Text boxes with the regions that hold their centre, and the share of the text inside.  Met in buckets of page rows."""
    r = regions.select(*keys, F.col("id").alias("region_id"), *[F.col(c).alias(f"r{c}") for c in BOX]).withColumn("_stop", F.col("ry2") + 1)
    t = texts.withColumns({"_cx": (F.col("x1") + F.col("x2")) / 2.0, "_cy": (F.col("y1") + F.col("y2")) / 2.0}).withColumn("_row", F.floor("_cy"))
    j = point_join(t, r, keys, "_row", ("ry1", "_stop"), 512)
    inside = F.col("_cx").between(F.col("rx1"), F.col("rx2")) & F.col("_cy").between(F.col("ry1"), F.col("ry2"))
    return j.filter(inside).withColumn("containment", containment(BOX, tuple(f"r{c}" for c in BOX))).drop("_cx", "_cy", "_row", "_stop")


def ocr_to_detection(texts: DataFrame, approved: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Every text with its best approved region, if any, and the decision about it."""
    c = text_in_regions(texts, approved, keys).filter(F.col("containment") >= CONTAINMENT)
    b = best(c.select(*keys, "id", "region_id", "containment"), [*keys, "id"], [-F.col("containment"), F.col("region_id")])
    j = texts.join(b, [*keys, "id"], "left")
    return j.withColumns({
        "decision": F.when((F.col("conf") >= OCR_CONF) & F.col("region_id").isNotNull(), "auto_clean").otherwise("preserve"),
        "why": F.when(F.col("conf") < OCR_CONF, "low_confidence").when(F.col("region_id").isNull(), "no_region").otherwise("associated")})


def outside_protected(candidates: DataFrame, detections: DataFrame, height: int, margin: int = 16, keys: Sequence[str] = PAGE) -> DataFrame:
    """Candidate rows outside every detection's rows, margins included."""
    d = detections.select(*keys, F.greatest(F.lit(0), F.col("y1") - margin).alias("d1"), (F.least(F.lit(height), F.col("y2") + margin) + 1).alias("d2"))
    c = candidates.withColumn("_stop", F.col("y") + 1)
    return overlap_semi(c, d, keys, ("y", "_stop"), ("d1", "d2"), anti=True, width=512).drop("_stop")


def mask_intersection(cleaner: DataFrame, regions: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Pixels of the cleaner's mask inside the region mask, per page; masks are disjoint pixel runs (page, y, x0, x1)."""
    total = cleaner.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("cleaner_pixels"))
    r = regions.select(*keys, "y", F.col("x0").alias("r0"), F.col("x1").alias("r1"))
    j = overlap_join(cleaner, r, [*keys, "y"], ("x0", "x1"), ("r0", "r1"), 4096)
    a = j.groupBy(*keys).agg(F.sum(F.least("x1", "r1") - F.greatest("x0", "r0")).alias("authorized_pixels"))
    out = total.join(a, list(keys), "left").withColumn("authorized_pixels", F.coalesce("authorized_pixels", F.lit(0)))
    return out.withColumn("authorized_percent", F.when(F.col("cleaner_pixels") > 0, F.round(F.col("authorized_pixels") / F.col("cleaner_pixels") * 100, 4)).otherwise(0.0))


def mask_report(pages: DataFrame) -> DataFrame:
    t = pages.agg(F.count(F.lit(1)).alias("pages_total"), F.coalesce(F.sum("cleaner_pixels"), F.lit(0)).alias("cleaner_pixels"),
                  F.coalesce(F.sum("authorized_pixels"), F.lit(0)).alias("authorized_pixels"))
    return t.withColumn("authorized_percent", F.when(F.col("cleaner_pixels") > 0, F.round(F.col("authorized_pixels") / F.col("cleaner_pixels") * 100, 4)).otherwise(0.0))


def clean_summary(gated: DataFrame, texts: DataFrame) -> DataFrame:
    """Detections, approved ones, texts to clean and texts kept."""
    n = F.lit(0)
    d = gated.select(F.lit(1).alias("d"), F.col("gate_ok").cast("int").alias("g"), n.alias("t"), n.alias("c"))
    t = texts.select(n.alias("d"), n.alias("g"), F.lit(1).alias("t"), (F.col("decision") == "auto_clean").cast("int").alias("c"))
    names = {"detections": "d", "approved": "g", "ocr_regions": "t", "auto_clean": "c"}
    out = d.unionByName(t).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in names.items()])
    return out.withColumn("preserved", F.col("ocr_regions") - F.col("auto_clean"))


def candidate_boxes(boxes: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Boxes small enough to be text, numbered from 1 in reading order."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    small = boxes.filter((w <= 360) & (h <= 180) & (w * h <= 45000))
    order = ["y1", "x1", "id"]
    return running(range_blocks(small, keys, order), keys, order, number="number").drop("_b")


def _near(page, box, gap: int):
    """Pairs of boxes of one page that are within ``gap``, a group of them at a time: a sweep along x, each box against the next, then the second next, ...

    ``page`` and ``box[0]`` (x1) are ascending.
    """
    import numpy as np

    x1, y1, x2, y2 = box
    at, shift = np.arange(len(page)), 1
    while True:
        at = at[at < len(page) - shift]
        at = at[(page[at] == page[at + shift]) & (x2[at] + gap >= x1[at + shift])]  # x1 ascends: beyond, no later one can reach
        if not len(at):
            return
        to = at + shift
        hit = (y2[at] + gap >= y1[to]) & (y2[to] + gap >= y1[at])
        yield at[hit], to[hit]
        shift += 1


def _closed(page, box, gap: int):
    """Group of each box after merging until no two boxes of a page are within ``gap``, and the bounds of the groups."""
    import numpy as np

    group, held = np.arange(len(page)), PER_TASK * 20
    while True:
        order = np.lexsort((box[0], page))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        page, box, group = page[order], box[:, order], back[group]
        label, some, size = np.arange(len(page)), [], 0
        for a, b in _near(page, box, gap):
            some.append((a, b))
            size += len(a)
            if size > held:  # pairs of a crowd are joined as they come
                some = [(np.arange(len(page)), joined(len(page), *(np.concatenate(x) for x in zip(*some))))]
                size = 0
        if some:
            label = joined(len(page), *(np.concatenate(x) for x in zip(*some)))
        first, number = np.unique(label, return_inverse=True)
        if len(first) == len(page):
            return group, box
        by = np.argsort(number, kind="stable")
        at = np.searchsorted(number[by], np.arange(len(first)))
        low, high = (f.reduceat(box[r][:, by], at, axis=1) for f, r in ((np.minimum, slice(0, 2)), (np.maximum, slice(2, 4))))
        page, box, group = page[first], np.concatenate([low, high]), number[group]


def _merged_pages(t, gap: int, keys: list[str]):
    """All pages of a task, each merged to the end."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    page = t.column("_page").combine_chunks().dictionary_encode().indices.to_numpy()
    group, box = _closed(page, np.stack([t.column(c).to_numpy() for c in BOX]), gap)
    rank = np.empty(len(page), np.int64)
    rank[pc.sort_indices(t.column("id")).to_numpy()] = np.arange(len(page))
    order = np.lexsort((rank, group))
    at = np.searchsorted(group[order], np.arange(box.shape[1]))
    head = t.take(pa.array(order[at]))
    n = np.add.reduceat(t.column("n").to_numpy()[order], at)
    return pa.table([*[head.column(k) for k in keys], head.column("id"), *[pa.array(b) for b in box], pa.array(n)], names=[*keys, "id", *BOX, "n"])


def _linked(t, gap: int):
    """Boxes of each cell with the one they merge into inside the cell."""
    import numpy as np
    import pyarrow as pa

    cell = t.column("_cell").combine_chunks().dictionary_encode().indices.to_numpy()
    group, _ = _closed(cell, np.stack([t.column(c).to_numpy() for c in BOX]), gap)
    order = np.argsort(group, kind="stable")
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    pick = head != order
    node = t.column("node")
    return pa.table([node.take(pa.array(order[pick])), node.take(pa.array(head[pick]))], names=["a", "b"])


def _collapsed(boxes: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """One box for all whose upper left corners share a square of ``gap`` + 1 pixels: these are within ``gap``, and so no square is crowded any more."""
    corner = boxes.withColumns({"_cx": F.floor(F.col("x1") / (gap + 1)), "_cy": F.floor(F.col("y1") / (gap + 1))})
    low, high = [[f(c).alias(c) for c in cs] for f, cs in ((F.min, ("x1", "y1")), (F.max, ("x2", "y2")))]
    return corner.groupBy(*keys, "_cx", "_cy").agg(F.min("id").alias("id"), *low, *high, F.sum("n").alias("n")).drop("_cx", "_cy")


def merge_boxes(boxes: DataFrame, gap: int = GAP, keys: Sequence[str] = PAGE, cell: int = CELL, page_boxes: int = PAGE_BOXES) -> DataFrame:
    """Boxes merged until no two are within ``gap`` pixels of each other.

    Boxes with neighbouring corners become one first, before any shuffle, so a crowd costs no more than the squares it covers.  A page that then has at
    most ``page_boxes`` is merged to the end in one task; the boxes of larger pages meet in cells of ``cell`` pixels, whose groups are joined across cells,
    and of the merged boxes only those that grew meet their cells again.  Merging is monotone: the result does not depend on the order.  A merged
    box has the smallest id.
    """
    keys = list(keys)
    spark = boxes.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = _collapsed(boxes.select(*keys, F.col("id").cast("string").alias("id"), *[F.col(c).cast("long").alias(c) for c in BOX], F.lit(1).cast("long").alias("n")), gap, keys)
    first, made = cut_measured(first.withColumn("_page", F.to_json(F.struct(*keys))), "merge_boxes")
    many = max(width, -(-made["rows"] // PER_TASK))
    total = first.groupBy("_page").count()
    small, large = first.join(total.filter(F.col("count") <= page_boxes), "_page"), total.filter(F.col("count") > page_boxes)
    kt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema.fields if f.name in (*keys, "id", *BOX, "n"))
    dealt = spread(small.drop("count").withColumn("_t", F.pmod(F.xxhash64("_page"), F.lit(many))), "_t")
    done = dealt.groupBy("_t").applyInArrow(lambda t: _merged_pages(t, gap, keys), kt)
    if made["rows"] <= page_boxes or large.isEmpty():
        return done
    names = [f.name for f in first.schema.fields if f.name != "_page"]
    return done.unionByName(_merged_in_cells(cut(first.join(large, "_page", "left_semi").select(*names)), gap, keys, cell).select(*done.columns))


def _merged_in_cells(cur: DataFrame, gap: int, keys: list[str], cell: int) -> DataFrame:
    half, width = (gap + 1) // 2, int(cur.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cur = cur.withColumn("_grew", F.lit(True))
    span = lambda a, b: F.sequence(F.floor((F.col(a) - half) / cell), F.floor((F.col(b) + half) / cell))
    while True:
        named = cur.withColumn("node", F.to_json(F.struct(*keys, "id")))
        cells = named.withColumn("_gx", F.explode(span("x1", "x2"))).withColumn("_gy", F.explode(span("y1", "y2")))
        cells = cells.select(F.to_json(F.struct(*keys, "_gx", "_gy")).alias("_cell"), "node", *BOX, "_grew")
        touched = cells.filter("_grew").select("_cell").distinct()
        cells = cells.join(touched, "_cell", "left_semi")
        many = max(width, -(-cur.count() // PER_TASK))
        dealt = spread(cells.withColumn("_t", F.pmod(F.xxhash64("_cell"), F.lit(many))), "_t")
        edges = cut(dealt.groupBy("_t").applyInArrow(lambda t: _linked(t, gap), "a string, b string"))
        if edges.isEmpty():
            return cur.drop("_grew")
        j = named.join(components(edges), "node", "left").withColumn("_g", F.coalesce("component", "node"))
        low, high = [[f(c).alias(c) for c in cs] for f, cs in ((F.min, ("x1", "y1")), (F.max, ("x2", "y2")))]
        cur = cut(j.groupBy(*keys, "_g").agg(F.min("id").alias("id"), *low, *high, F.sum("n").alias("n"), (F.count(F.lit(1)) > 1).alias("_grew")).drop("_g"))
