"""Checks before something becomes, or stays, official: compositions, balance proposals and corrections.  Valid means no error row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripline.operators.compose import CH, coverage_errors

ERROR = ("kind", "at", "next")


def faults(df: DataFrame, keys: Sequence[str], at: str | Column, checks: dict[str, Column], next_: str | Column | None = None) -> DataFrame:
    """A row for each check that holds: keys, ``kind``, ``at`` and ``next``; a check whose inputs are missing doesn't hold."""
    c = lambda x: F.lit(None) if x is None else F.col(x) if isinstance(x, str) else x
    found = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]), lambda k: k.isNotNull())
    return df.select(*keys, F.explode(found).alias("kind"), c(at).cast("long").alias("at"), c(next_).cast("long").alias("next"))


def unsafe(name: str) -> Column:
    """A file name that is missing, blank or more than a name."""
    n = F.trim(F.coalesce(F.col(name), F.lit("")))
    return (n == "") | n.contains("/") | n.isin(".", "..")


def repeated(df: DataFrame, keys: Sequence[str], name: str, at: str) -> DataFrame:
    """Names that a key has more than once, at the last of them."""
    g = df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"), F.max(at).alias("_at")).filter("_n > 1")
    return g.select(*keys, F.lit("repeated_name").alias("kind"), F.col("_at").cast("long").alias("at"), F.col("_n").alias("next"))


def official_errors(manifests: DataFrame, outputs: DataFrame, artifacts: DataFrame, pages: DataFrame | None = None, keys: Sequence[str] = CH) -> DataFrame:
    """Errors of official compositions, per chapter of ``manifests``.

    manifests: keys, ``readable``, ``merged_images``, ``source_total_height``, ``validation_ok``, ``coverage_start``, ``coverage_end``;
    outputs: keys, ``seg``, ``file``, ``g_start``, ``g_end``, ``width``, ``height`` (null: not declared); artifacts: keys, ``file`` and, for the deep check,
    the ``width`` and ``height`` of the image (null: unreadable); pages: keys, ``page_no``, ``width``, ``height`` (null: unreadable).

    With ``pages`` the check is deep: all pages must be readable and of one width, heights must add up to the manifest's total, declared and real
    sizes must be those of the interval; a missing coverage counts as right.  Without them it is light: only the manifest's flags, its names (plain, none
    twice), the presence of the files and the tiling.
    """
    keys, deep = list(keys), pages is not None
    outs = outputs.join(manifests.select(*keys), keys, "left_semi")
    n = outs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    m = manifests.join(n, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    total, start, end = (F.col(c) for c in ("source_total_height", "coverage_start", "coverage_end"))
    if deep:
        start, end = F.coalesce(start, F.lit(0)), F.coalesce(end, total)
        p = pages.groupBy(*keys).agg(
            F.count_if(F.col("width").isNull() | F.col("height").isNull()).alias("_bad"), F.count_if((F.col("width") <= 0) | (F.col("height") <= 0)).alias("_empty"),
            F.min("width").alias("_w"), F.max("width").alias("_w2"), F.sum("height").alias("_h"))
        m = m.join(p, keys, "left")
    declared = F.when(F.col("merged_images") > 0, F.col("merged_images")).otherwise(F.col("_n")) if deep else F.coalesce("merged_images", F.lit(0))
    checks = {
        "unreadable_manifest": ~F.coalesce("readable", F.lit(False)),
        "count_differs": (declared <= 0) | (declared != F.col("_n")),
        "no_total": F.coalesce(total, F.lit(0)) <= 0,
        "coverage_start": F.coalesce(start, F.lit(-1)) != 0,
        "coverage_end": F.coalesce(end != total, F.lit(True)),
    }
    if deep:
        checks |= {"no_pages": F.col("_bad").isNull(), "page_unreadable": F.col("_bad") > 0, "page_empty": F.col("_empty") > 0, "page_widths_differ": F.col("_w") != F.col("_w2"),
                   "pages_differ_from_total": F.col("_h") != total}
    else:
        checks["not_validated"] = ~F.coalesce("validation_ok", F.lit(False))
    whole = faults(m, keys, "_n", checks, total)

    have = artifacts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("file").alias("_file"), *([F.col("width").alias("_aw"), F.col("height").alias("_ah")] if deep else []), F.lit(True).alias("_there"))
    if deep:
        outs = outs.join(m.select(*keys, "_w"), keys)
    o = outs.join(have, [*[F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], F.col("file") == F.col("_file")], "left")
    each = {"unsafe_name": unsafe("file"), "missing_file": F.col("_there").isNull()}
    rows = F.col("g_end") - F.col("g_start")
    if deep:
        each = {"no_name": F.trim(F.coalesce("file", F.lit(""))) == "", "missing_file": F.col("_there").isNull(), "width_differs": F.coalesce("width", "_w") != F.col("_w"),
                "height_differs": F.coalesce(F.col("height"), rows) != rows,
                "image_differs": F.col("_there") & F.coalesce((F.col("_aw") != F.col("_w")) | (F.col("_ah") != rows), F.lit(True))}
    found = whole.unionByName(faults(o, keys, "g_start", each, "g_end"))
    if not deep:
        found = found.unionByName(repeated(outs, keys, "file", "g_start"))
    cover = coverage_errors(outs, m.select(*keys, F.coalesce(total, F.lit(0)).cast("long").alias("total")), keys)
    return found.unionByName(cover.select(*keys, "kind", F.col("at").cast("long").alias("at"), F.col("next").cast("long").alias("next")))


def effect_errors(proposals: DataFrame, selected: DataFrame, artifacts: DataFrame, outputs: DataFrame, manifests: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Errors that stop balance proposals, one per chapter, from taking effect on the official composition.

    proposals: keys, ``proposal_id``, ``status_id``, ``status``, ``region_start``, ``region_end``; selected: keys, ``file``; artifacts: keys, ``file``, ``g_start``,
    ``g_end``, ``height``, ``there`` (the file exists); outputs: keys, ``seg``, ``file``, ``g_start``, ``g_end``; manifests: keys,
    ``source_total_height``, ``source_width``, ``validation_ok``.
    """
    keys = list(keys)
    region = F.col("region_start"), F.col("region_end")
    known = selected.join(outputs.select(*keys, "file", "seg", "g_start", "g_end"), [*keys, "file"], "left").join(proposals.select(*keys), keys, "left_semi")
    g = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("seg").isNull()).alias("_unknown"), F.min("seg").alias("_a"), F.max("seg").alias("_z"),
        F.min_by("g_start", "seg").alias("_s"), F.max_by("g_end", "seg").alias("_e"))
    a = artifacts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    p = proposals.join(g, keys, "left").join(a, keys, "left").join(manifests, keys, "left")
    sure = (F.col("_unknown") == 0) & (F.col("_n") >= 2)
    whole = faults(p, keys, region[0], {
        "id_differs": F.coalesce("proposal_id", F.lit("")).isin("") | ~F.col("proposal_id").eqNullSafe(F.col("status_id")), "not_generated": ~F.col("status").eqNullSafe(F.lit("PROPOSTA_GERADA")),
        "empty_region": region[1] <= region[0], "selection_too_small": F.coalesce("_n", F.lit(0)) < 2, "unknown_file": F.col("_unknown") > 0,
        "not_contiguous": sure & (F.col("_z") - F.col("_a") + 1 != F.col("_n")), "region_moved": sure & ((F.col("_s") != region[0]) | (F.col("_e") != region[1])),
        "no_artifacts": F.coalesce("_k", F.lit(0)) == 0,
        "bad_manifest": (F.coalesce("source_total_height", F.lit(0)) <= 0) | (F.coalesce("source_width", F.lit(0)) <= 0) | ~F.coalesce("validation_ok", F.lit(False))}, region[1])
    rows = F.col("g_end") - F.col("g_start")
    mine = artifacts.join(proposals.select(*keys, "region_start", "region_end"), keys)
    each = faults(mine, keys, "g_start", {"artifact_missing": unsafe("file") | ~F.coalesce("there", F.lit(False)), "artifact_height": (rows <= 0) | (F.col("height") != rows)}, "g_end")

    def tagged(df, prefix):
        return df.select(*keys, F.concat(F.lit(prefix), "kind").alias("kind"), F.col("at").cast("long").alias("at"), F.col("next").cast("long").alias("next"))

    ends = proposals.join(a, keys, "left_semi").select(*keys, "region_start", F.col("region_end").alias("total"))
    tiles = tagged(coverage_errors(mine.select(*keys, "g_start", "g_end"), ends, keys, first="region_start"), "artifact_")
    out = known.filter("seg is not null").select(*keys, "seg").distinct()
    kept = outputs.join(proposals.select(*keys), keys, "left_semi").join(out, [*keys, "seg"], "left_anti").select(*keys, "file", "g_start", "g_end")
    candidate = kept.unionByName(mine.select(*keys, "file", "g_start", "g_end"))
    total = manifests.join(proposals.select(*keys), keys, "left_semi").select(*keys, F.coalesce("source_total_height", F.lit(0)).cast("long").alias("total"))
    return (whole.unionByName(each).unionByName(tiles).unionByName(tagged(coverage_errors(candidate, total, keys), "candidate_"))
            .unionByName(repeated(candidate, keys, "file", "g_start")))


def correction_errors(proposals: DataFrame, expected: DataFrame, images: DataFrame, ident: Sequence[str]) -> DataFrame:
    """Errors that stop corrections of cleaned pages: ``ident``, ``kind``.

    proposals: ident, ``readable``, ``schema_ok``, ``status``, ``proposal_id``, ``chapter``, ``source_stage``, ``source_file``, ``clean_file``, ``base_sha256``,
    ``source_sha256``, ``preview_file``; expected: ident, the same ids with the prefix ``want_``, ``pending_clean`` (the result that is still
    pending for this page, null: none); images: ``file``, ``sha256``, ``width``, ``height``, of sources, results and previews.
    """
    ident = list(ident)

    def image(prefix: str, name: str, df: DataFrame) -> DataFrame:
        i = images.select(F.col("file").alias(f"_{prefix}"), *[F.col(c).alias(f"_{prefix}_{c}") for c in ("sha256", "width", "height")])
        return df.join(i, F.col(name) == F.col(f"_{prefix}"), "left")

    p = proposals.join(expected, ident, "left")
    for prefix, name in (("c", "want_clean_file"), ("s", "want_source_file"), ("p", "preview_file")):
        p = image(prefix, name, p)
    ids = {f"{k}_differs": ~F.col(k).eqNullSafe(F.col(f"want_{k}")) for k in ("proposal_id", "chapter", "source_stage", "source_file", "clean_file")}
    size = lambda k: F.struct(f"_{k}_width", f"_{k}_height")
    checks = {
        "invalid_schema": ~F.coalesce("readable", F.lit(False)) | ~F.coalesce("schema_ok", F.lit(False)), "not_available": ~F.col("status").eqNullSafe(F.lit("PREVIA")), **ids,
        "not_pending": ~F.col("pending_clean").eqNullSafe(F.col("want_clean_file")),
        "base_changed": F.coalesce(F.col("base_sha256") != F.col("_c_sha256"), F.lit(True)), "source_changed": F.coalesce(F.col("source_sha256") != F.col("_s_sha256"), F.lit(True)),
        "no_preview": unsafe("preview_file") | F.col("_p").isNull(),
        "preview_size": F.col("_p").isNotNull() & F.col("_c").isNotNull() & (size("p") != size("c")),
        "merge_size": (F.col("want_source_stage") == "MERGE") & F.col("_p").isNotNull() & F.col("_s").isNotNull() & (size("p") != size("s"))}
    found = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]), lambda k: k.isNotNull())
    return p.select(*ident, F.explode(found).alias("kind"))
