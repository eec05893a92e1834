"""Pages on the global axis: spans, lookups, slices, views and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.functions.names import page_range_name
from stripline.operators.blocks import id_blocks, overlap_join, point_join, running

CH = ["ch"]


def page_spans(pages: DataFrame, keys: Sequence[str] = CH, order: str = "page_no", height: str = "height", width: str = "width") -> DataFrame:
    """Half-open span of every page and whether its width differs from that of the chapter's first page (``width_error``)."""
    first = pages.groupBy(*keys).agg(F.min_by(width, order).alias("chapter_width"))
    laid = running(id_blocks(pages, order), keys, [order], sums={"global_start": height}, number="page_index").drop("_b")
    return laid.join(first, list(keys)).withColumns({
        "global_end": F.col("global_start") + F.col(height), "width_error": F.col(width) != F.col("chapter_width")})


def page_at_y(points: DataFrame, pages: DataFrame, at: str, keys: Sequence[str] = CH) -> DataFrame:
    """Page and local row of a global row; rows past the end fall on the last page, at its height."""
    keys = list(keys)
    inside = point_join(points, pages.select(*keys, "file", "page_no", "gs", "ge"), keys, at, ("gs", "ge"))
    inside = inside.withColumn("local_y", F.col(at) - F.col("gs")).drop("gs", "ge")
    last = pages.groupBy(*keys).agg(
        F.max_by("file", "page_no").alias("file"), F.max("page_no").alias("page_no"), F.max("ge").alias("_end"),
        F.max_by(F.col("ge") - F.col("gs"), "page_no").alias("local_y"))
    beyond = points.join(last, keys).filter(F.col(at) >= F.col("_end")).drop("_end")
    return inside.unionByName(beyond.select(*inside.columns))


def source_spans(intervals: DataFrame, pages: DataFrame, span: tuple[str, str] = ("start", "end"), keys: Sequence[str] = CH) -> DataFrame:
    """Slices of the pages an interval covers, with local offsets."""
    s, e = span
    p = pages.select(*keys, "file", "page_no", "gs", "ge")
    j = overlap_join(intervals, p, keys, span, ("gs", "ge"))
    lo, hi = F.greatest(s, "gs"), F.least(e, "ge")
    return j.withColumns({"global_start": lo, "global_end": hi, "local_start": lo - F.col("gs"), "local_end": hi - F.col("gs")})


def segment_sources(intervals: DataFrame, pages: DataFrame, ident: Sequence[str], span: tuple[str, str] = ("start", "end"),
                    keys: Sequence[str] = CH) -> DataFrame:
    """Number of pages an interval meets, 0 included."""
    met = overlap_join(intervals, pages.select(*keys, "page_no", "gs", "ge"), keys, span, ("gs", "ge"))
    n = met.groupBy(*ident).agg(F.count(F.lit(1)).alias("source_count"))
    return intervals.join(n, list(ident), "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def region_view(regions: DataFrame, items: DataFrame, region: tuple[str, str], item: tuple[str, str], keys: Sequence[str] = CH) -> DataFrame:
    """Items clipped to the regions they meet and rebased to the region's start."""
    j = overlap_join(regions, items, keys, region, item)
    return j.withColumns({
        "view_start": F.greatest(region[0], item[0]) - F.col(region[0]), "view_end": F.least(region[1], item[1]) - F.col(region[0])})


def globalize(items: DataFrame, pages: DataFrame, origin: str, local: str, keys: Sequence[str] = CH) -> DataFrame:
    """Local rows of a region back on the global axis, with the page they fall on."""
    return page_at_y(items.withColumn("global_y", F.col(origin) + F.col(local)), pages, "global_y", keys)


def pending_blocks(pending: DataFrame, pages: DataFrame, ident: Sequence[str], span: tuple[str, str], keys: Sequence[str] = CH) -> DataFrame:
    """Residual intervals with first page, last page and page count; an interval that meets no page is an error."""
    s = source_spans(pending, pages, span, keys).groupBy(*ident).agg(
        F.min_by("file", "page_no").alias("first_file"), F.max_by("file", "page_no").alias("last_file"),
        F.count(F.lit(1)).alias("n_pages"), F.sum(F.col("global_end") - F.col("global_start")).alias("height"))
    return pending.join(s, list(ident), "left").withColumns({
        "n_pages": F.coalesce("n_pages", F.lit(0)),
        "problem": F.when(F.col("first_file").isNull(), "no_page_matches_block")})


def context_window(outputs: DataFrame, pages: DataFrame, limit: int, span: tuple[str, str], keys: Sequence[str] = CH) -> DataFrame:
    """For every output the pages from its first page on, ``limit`` at most, flagged where they belong to it."""
    keys = list(keys)
    met = source_spans(outputs, pages, span, keys).groupBy(*outputs.columns).agg(F.min("page_no").alias("first_no"))
    idx = met.withColumn("page_no", F.explode(F.sequence(F.col("first_no"), F.col("first_no") + limit - 1)))
    return idx.join(pages.select(*keys, "page_no", "file", "gs", "ge"), [*keys, "page_no"]).withColumn(
        "included", (F.col("gs") < F.col(span[1])) & (F.col("ge") > F.col(span[0])))


def name_outputs(outputs: DataFrame, pages: DataFrame, ident: Sequence[str], span: tuple[str, str], keys: Sequence[str] = CH) -> DataFrame:
    """Page-range name of every output."""
    n = source_spans(outputs, pages, span, keys).groupBy(*ident).agg(F.min("page_no").alias("first_no"), F.max("page_no").alias("last_no"))
    return outputs.join(n, list(ident)).withColumn("name", page_range_name(F.col("first_no"), F.col("last_no")))


def resolve_collisions(named: DataFrame, span: tuple[str, str], keys: Sequence[str] = CH) -> DataFrame:
    """Names used more than once in a chapter get their rows as a suffix."""
    n = named.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("uses"))
    suffix = F.concat(F.lit("__y-"), F.col(span[0]).cast("string"), F.lit("-"), F.col(span[1]).cast("string"), F.lit(".png"))
    unique = F.when(F.col("uses") > 1, F.concat(F.regexp_replace("name", r"\.png$", ""), suffix)).otherwise(F.col("name"))
    return named.join(n, [*keys, "name"]).withColumns({"collides": F.col("uses") > 1, "unique_name": unique})


def evenly_spaced(pages: DataFrame, count: int, number: str, keys: Sequence[str] = CH) -> DataFrame:
    """``count`` pages per chapter at evenly spaced places, first and last included."""
    keys = list(keys)
    n = pages.groupBy(*keys).agg(F.max(number).alias("_n"))
    i = n.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(count), F.col("_n")) - 1)))
    c = F.least(F.lit(count), F.col("_n"))
    at = F.when(c == 1, F.lit(0).cast("double")).otherwise(F.bround(F.col("_i") * (F.col("_n") - 1) / (c - 1)))
    picks = i.select(*keys, (at + 1).cast("long").alias(number)).distinct()
    return pages.join(picks, [*keys, number])


def stack_slices(spans: DataFrame, ident: Sequence[str], content: str, order: str = "global_start") -> DataFrame:
    """Content of an output: its slices joined in axis order.  An output is bounded by the maximum chunk height."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content])
    return spans.groupBy(*ident).agg(F.array_join(parts, "").alias("content"), F.count(F.lit(1)).alias("n_slices"))
