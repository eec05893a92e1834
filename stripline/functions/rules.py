"""Classification rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
PDF_MIN_UNITS, PDF_MAX_UNITS, DEFAULT_DPI = 3.0, 14400.0, 96.0
DIM_TOLERANCE = 3.0
UNIFORM_STD_MAX, SAFE_EDGE_MAX = 10.0, 0.015
TEXT_CLUSTERS, TEXT_BACKGROUND_STD = 3, 18.0
SCENE_MAX_HEIGHT = 3000


def width_difference(width: Column, dominant: Column) -> Column:
    return F.when(dominant > 0, F.abs(width - dominant) / dominant * 100.0).otherwise(0.0)


def dim_class(width: Column, dominant: Column, tolerance: float = DIM_TOLERANCE) -> Column:
    """Width class against the chapter's dominant width."""
    d = width_difference(width, dominant)
    return (F.when(width.isNull(), None).when(width == dominant, "PADRAO")
            .when(d <= tolerance, "DENTRO_TOLERANCIA").otherwise("EXCECAO_DIMENSAO"))


def pdf_units(pixels: Column, dpi: Column) -> Column:
    """PDF units of a length; a missing, non-finite or non-positive resolution counts as the default one."""
    good = dpi.isNotNull() & ~F.isnan(dpi) & (dpi > 0) & (dpi < float("inf"))
    return pixels * 72.0 / F.when(good, dpi).otherwise(DEFAULT_DPI)


def within_pdf_limits(units: Column) -> Column:
    return units.between(PDF_MIN_UNITS, PDF_MAX_UNITS)


def text_like(clusters: Column, background_std: Column) -> Column:
    return (clusters >= TEXT_CLUSTERS) & (background_std <= TEXT_BACKGROUND_STD)


def cut_rule() -> Column:
    """Decision and reason of one position, first matching rule wins."""
    def verdict(decision, reason):
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))

    clear = (F.col("band_std") <= UNIFORM_STD_MAX) & (F.col("edge_density") <= SAFE_EDGE_MAX)
    return (F.when(F.col("diagonal_crossings") > 0, verdict("UNSAFE", "strong_diagonal_crossing"))
            .when(F.col("crossing_components") > 0, verdict("UNSAFE", "connected_component_crossing"))
            .when(text_like(F.col("text_fx_clusters"), F.col("text_fx_background_std")), verdict("UNSAFE", "text_like_region"))
            .when(clear, verdict("SAFE", "structurally_clear_uniform_band"))
            .otherwise(verdict("INCONCLUSIVE", "structural_evidence_inconclusive")))


def scene_guard(height: Column, limit: int = SCENE_MAX_HEIGHT) -> Column:
    """A region taller than the limit goes to review."""
    return F.when(height > limit, "continuous_scene_too_long")
