"""File-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_number(name: str | Column) -> Column:
    """Number of ``page-<n>`` at the start of a name, null where there is none."""
    return F.nullif(F.regexp_extract(name, r"(?i)^page-(\d+)", 1), F.lit("")).cast("long")


def zero_pad(n: Column, width: int = 3) -> Column:
    """Decimal text of at least ``width`` digits; ``lpad`` alone would cut longer numbers."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def page_range_name(first: Column, last: Column) -> Column:
    """``page-AAA.png`` or ``page-AAA-BBB.png``."""
    tail = F.when(first == last, F.lit("")).otherwise(F.concat(F.lit("-"), zero_pad(last)))
    return F.concat(F.lit("page-"), zero_pad(first), tail, F.lit(".png"))


def natural_key(name: str | Column) -> Column:
    """Sort key where digit runs of any length compare as numbers: each is written without leading zeros, after its length."""
    def run(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^0+(?=\d)", "")
        return F.when(part.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), run), "")


def is_active_page(name: str | Column) -> Column:
    """Page files that take part: an image extension and no backup stem."""
    return F.lower(name).rlike(r"\.(png|jpg|jpeg|webp)$") & ~F.lower(name).rlike(r"_old\.[a-z]+$")


def is_exported(name: str | Column) -> Column:
    """Names the export copies: no system files, manifests or masks."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return (base != ".DS_Store") & ~F.lower(base).endswith(".json") & ~F.lower(base).endswith("_mask.png")


def is_safe_png(name: str | Column) -> Column:
    """A bare ``.png`` file name that cannot leave its folder."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce((F.trim(c) != "") & ~c.isin(".", "..") & ~c.rlike(r"[/\\]") & F.lower(c).endswith(".png"), F.lit(False))
