"""Rectangle arithmetic and visual gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
GATE_CONF, GATE_BRIGHT_RATIO, GATE_BRIGHTNESS = 0.55, 0.55, 205
SFX_BRIGHTNESS, SFX_TEXTURE = 225, 50
OCR_CONF, CONTAINMENT = 0.60, 0.80
COMPONENT_AREA, COMPONENT_RECT, TYPE_A_STD, TYPE_B_STD, TYPE_B_RANGE, TYPE_B_MEAN = 20000, 0.85, 2.5, 1.5, 25, 245
MARGIN_RATIO, MARGIN_MIN, MARGIN_MAX = 0.15, 16, 64
PAD = 160


def _clamp(v: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(hi, v))


def intersection(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Area shared by two boxes given as (x1, y1, x2, y2) column names."""
    w = F.least(F.col(a[2]), F.col(b[2])) - F.greatest(F.col(a[0]), F.col(b[0]))
    h = F.least(F.col(a[3]), F.col(b[3])) - F.greatest(F.col(a[1]), F.col(b[1]))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def containment(text: tuple[str, ...], region: tuple[str, ...]) -> Column:
    """Share of the text box that lies inside the region."""
    area = (F.col(text[2]) - F.col(text[0])) * (F.col(text[3]) - F.col(text[1]))
    return F.when(area > 0, intersection(text, region) / area).otherwise(0.0)


# The gate's reasons.
GATE_APPROVED = "detector especializado + gate visual aprovados"
GATE_LETTERING = ("preservado pelo gate V3.5: região muito clara e de baixa textura, compatível com texto gráfico/SFX sem balão "
                  "(brilho=%.1f, textura=%.1f)")
GATE_REJECTED = "região especializada detectada, mas gate visual rejeitou (brilho=%.1f, bright_ratio=%.2f)"


def detector_gate(conf: Column, bright_ratio: Column, brightness: Column, texture: Column) -> Column:
    """Struct of ``gate_ok`` and ``reason``: very bright and flat regions are kept as drawn lettering."""
    sfx = (brightness >= SFX_BRIGHTNESS) & (texture < SFX_TEXTURE)
    ok = (conf >= GATE_CONF) & (bright_ratio >= GATE_BRIGHT_RATIO) & (brightness >= GATE_BRIGHTNESS) & ~sfx
    reason = (F.when(ok, GATE_APPROVED).when(sfx, F.format_string(GATE_LETTERING, brightness, texture))
              .otherwise(F.format_string(GATE_REJECTED, brightness, bright_ratio)))
    return F.struct(ok.alias("gate_ok"), reason.alias("reason"))


def component_type(area: Column, rectangularity: Column, std: Column, mean: Column, context_range: Column, sides: Column) -> Column:
    big = (area >= COMPONENT_AREA) & (rectangularity >= COMPONENT_RECT)
    flat = (std <= TYPE_B_STD) & (context_range >= TYPE_B_RANGE) & (mean <= TYPE_B_MEAN) & (sides >= 3)
    return F.when(~big, None).when(std >= TYPE_A_STD, "TYPE_A").when(flat, "TYPE_B")


def fill_strategy(mask_pixels: Column, lum_median: Column, lum_std: Column, spread: Column) -> Column:
    usable = (lum_median >= 220) & (lum_std <= 18) & (spread <= 18)
    return F.when(mask_pixels == 0, "none").when(usable, "direct_fill").otherwise("inpaint")


def residual_text(pixels: Column, w: Column, h: Column, ring_mean: Column, ring_std: Column, ring_bright: Column) -> Column:
    """Whether a dark component looks like left-over text on a bright, even ground."""
    size = pixels.between(14, 5000) & w.between(2, 140) & h.between(3, 140)
    return size & (ring_mean >= 236) & (ring_std <= 10) & (ring_bright >= 0.90)


def selection_problem(left: Column, top: Column, width: Column, height: Column) -> Column:
    bad = F.lit(False)
    for c in (left, top, width, height):
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return (F.when(bad, "not_finite").when((left < 0) | (top < 0) | (width <= 0) | (height <= 0), "invalid_coordinates")
            .when((left + width > 100.000001) | (top + height > 100.000001), "outside_image"))


def bbox_from_percent(left: Column, top: Column, width: Column, height: Column, w: int, h: int) -> dict[str, Column]:
    """Pixel box of a percent selection: floor of the near sides, ceiling of the far ones, clamped."""
    return {"px1": _clamp(F.floor(left / 100.0 * w), 0, w), "py1": _clamp(F.floor(top / 100.0 * h), 0, h),
            "px2": _clamp(F.ceil((left + width) / 100.0 * w), 0, w), "py2": _clamp(F.ceil((top + height) / 100.0 * h), 0, h)}


def min_side(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.least(x2 - x1, y2 - y1)


def mask_margin(side: Column) -> Column:
    return _clamp(F.bround(side * MARGIN_RATIO).cast("long"), MARGIN_MIN, MARGIN_MAX)


def grow(x1: Column, y1: Column, x2: Column, y2: Column, by, w: int, h: int) -> dict[str, Column]:
    """Box grown by a margin and clipped to the image."""
    by = by if isinstance(by, Column) else F.lit(by)
    return {"gx1": F.greatest(F.lit(0), x1 - by), "gy1": F.greatest(F.lit(0), y1 - by), "gx2": F.least(F.lit(w), x2 + by), "gy2": F.least(F.lit(h), y2 + by)}


def protected_margin(side: Column) -> Column:
    return F.greatest(F.lit(4), F.bround(side * 0.025).cast("long"))


def polygon_center(polygon: str) -> dict[str, Column]:
    """Mean of the vertices of an array of (x, y) structs."""
    n = F.size(polygon)
    s = lambda f: F.aggregate(polygon, F.lit(0.0), lambda a, p: a + p[f])
    return {"cx": s("x") / n, "cy": s("y") / n}
