"""Runs of separator rows and statistics of row bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripline.operators.blocks import block_window, halo, sessions, spread

CH = ["ch"]
UNIFORM_STD, UNIFORM_DELTA = 4.0, 3.0


def bands(profile: DataFrame, flag: Column, aggs=None, keys: Sequence[str] = CH, pos: str = "y", width: int | None = None) -> DataFrame:
    """Maximal runs of consecutive rows that satisfy ``flag``: ``start``, ``end``, ``height`` and ``aggs``."""
    s = sessions(profile.filter(flag), keys, pos, 1, aggs, width)
    return s.withColumns({"end": F.col("last") + 1, "height": F.col("n")}).drop("last", "n")


def white_bands(profile: DataFrame, threshold: float = 0.985, row_width: int = 256, **kw) -> DataFrame:
    """Runs of light rows; their mean ratio comes from the exact number of light pixels, ``white_px`` per row."""
    b = bands(profile, F.col("white_ratio") >= threshold, {"_r": ("sum", "white_px")}, **kw)
    return b.withColumn("white_ratio_mean", F.col("_r") / (F.col("height") * row_width)).drop("_r")


def uniform_bands(profile: DataFrame, std: float = UNIFORM_STD, delta: float = UNIFORM_DELTA, rgb: Sequence[str] = (), **kw) -> DataFrame:
    """Runs of flat rows with mean and highest spread, mean change and, where channels are given, the mean colour."""
    aggs = {"_s": ("sum", "std"), "std_max": ("max", "std"), "_d": ("sum", "delta"), **{f"_m_{c}": ("sum", c) for c in rgb}}
    h = F.col("height")
    b = bands(profile, (F.col("std") <= std) & (F.col("delta") <= delta), aggs, **kw)
    b = b.withColumns({"std_mean": F.col("_s") / h, "delta_mean": F.col("_d") / h})
    if rgb:
        mean = [F.bround(F.col(f"_m_{c}") / h).cast("long") for c in rgb]
        b = b.withColumn("color", F.format_string("#%02x%02x%02x", *mean))
    return b.drop("_s", "_d", *[f"_m_{c}" for c in rgb])


def moving_band(profile: DataFrame, half: int = 8, keys: Sequence[str] = CH, count: Column | None = None, width: int | None = None) -> DataFrame:
    """Spread and edge density of the rows from ``y - half`` to ``y + half``, from per-row moments."""
    n = count if count is not None else F.lit(1)
    w = block_window(keys, "y").rangeBetween(-half, half)
    h = halo(profile, keys, "y", half, half, width)
    h = h.withColumns({"_n": F.sum(n).over(w), "_1": F.sum("s1").over(w), "_2": F.sum("s2").over(w), "_e": F.sum("edges").over(w)})
    mean = F.col("_1") / F.col("_n")
    var = F.greatest(F.col("_2") / F.col("_n") - mean * mean, F.lit(0.0))
    return h.filter("_home").withColumns({"band_std": F.sqrt(var), "edge_density": F.col("_e") / F.col("_n")}).drop("_n", "_1", "_2", "_e", "_b", "_home")


def strip_scan(profile: DataFrame, std_max: float = 7.0, edge_max: float = 10.0, height: int = 18, step: int = 9,
               keys: Sequence[str] = CH, width: int | None = None) -> DataFrame:
    """Strips of ``height`` rows every ``step`` rows whose spread and mean change, across and down, stay low."""
    h = halo(profile, keys, "y", 1, height, width)
    w = block_window(keys, "y")
    f = w.rangeBetween(0, height - 1)
    g = w.rangeBetween(1, height - 1)
    h = h.withColumn("_dy", F.abs(F.col("s1") - F.lag("s1").over(w)))
    h = h.withColumns({"_n": F.count(F.lit(1)).over(f), "_1": F.sum("s1").over(f), "_2": F.sum("s2").over(f),
                       "_x": F.sum("edges").over(f), "_y": F.sum("_dy").over(g)})
    mean = F.col("_1") / F.col("_n")
    std = F.sqrt(F.greatest(F.col("_2") / F.col("_n") - mean * mean, F.lit(0.0)))
    edge = F.greatest(F.col("_x") / F.col("_n"), F.col("_y") / (F.col("_n") - 1))
    out = h.filter(F.col("_home") & (F.col("y") % step == 0) & (F.col("_n") == height))
    out = out.withColumns({"center": F.col("y") + height // 2, "uniform_std": std, "edge_mean": edge})
    return out.filter((F.col("uniform_std") <= std_max) & (F.col("edge_mean") <= edge_max)).select(*keys, "y", "center", "uniform_std", "edge_mean")


def trimmed_std(profile: DataFrame, half: int = 16, min_core: int = 32, value: str = "s1", keys: Sequence[str] = CH, width: int | None = None) -> DataFrame:
    """Spread of the values between the 10th and 90th percentile of a band; of all values where too few remain."""
    keys = list(keys)
    h = halo(profile.select(*keys, "y", F.col(value).cast("long").alias("_v")), keys, "y", half, half, width)
    kt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in profile.schema.fields if f.name in keys)

    def run(group):
        import numpy as np
        import pyarrow as pa

        t = group.sort_by("y")
        y, v = np.array(t.column("y")), np.array(t.column("_v"))
        home = np.flatnonzero(np.array(t.column("_home").to_pylist(), bool))
        first, last = np.searchsorted(y, y[home] - half), np.searchsorted(y, y[home] + half, side="right")
        size, std = np.zeros(len(home), np.int64), np.zeros(len(home))
        for n in np.unique(last - first):  # windows of one length together; the ends of a strip have shorter ones
            at = np.flatnonzero(last - first == n)
            for part in np.array_split(at, max(1, len(at) * n // 4_000_000)):
                w = np.sort(v[first[part][:, None] + np.arange(n)], axis=1)

                def pct(p):
                    x = (n - 1) * p
                    i = int(np.floor(x))
                    lo, hi = w[:, i], w[:, min(i + 1, n - 1)]
                    return lo + (hi - lo) * (x - i)

                core = (w >= pct(0.1)[:, None]) & (w <= pct(0.9)[:, None])
                core[core.sum(axis=1) < max(min_core, n // 4)] = True
                m = core.sum(axis=1)
                s1, s2 = (w * core).sum(axis=1) / m, (w * w * core).sum(axis=1) / m
                size[part], std[part] = m, np.sqrt(np.maximum(s2 - s1 * s1, 0.0))
        head = [pa.repeat(t.column(k)[0], len(home)) if len(home) else t.column(k).slice(0, 0).combine_chunks() for k in keys]
        return pa.table([*head, pa.array(y[home]), pa.array(size), pa.array(std)], names=[*keys, "y", "core_size", "trimmed_std"])

    return spread(h, *keys, "_b").groupBy(*keys, "_b").applyInArrow(run, f"{kt}, y long, core_size long, trimmed_std double")


def median_ring(pixels: DataFrame, keys: Sequence[str], rgb: Sequence[str] = ("r", "g", "b"), bright: float = 210.0,
                min_bright: int = 50, share: float = 0.35) -> DataFrame:
    """Median colour and luminance of a group's pixels, of its bright ones where there are enough.

    Medians are read from counts of equal values, which are added up before and after the shuffle: a group has at most as many as there are values of a
    colour (or of the sum of three) and a brightness, whatever its number of pixels.
    """
    keys = list(keys)
    total = F.col(rgb[0]) + F.col(rgb[1]) + F.col(rgb[2])
    p = pixels.select(*keys, *rgb, total.alias("_sum"), (total / 3.0).alias("_l")).withColumn("_bright", F.col("_l") >= bright)
    is_b = F.col("_bright")
    g = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(is_b).alias("_nb"),
                             F.stddev_pop("_l").alias("_a_std"), F.stddev_pop(F.when(is_b, F.col("_l"))).alias("_b_std"))
    of = [F.struct(F.lit(k).alias("_c"), F.col(c).cast("double").alias("_v")) for k, c in [*((c, c) for c in rgb), ("lum", "_sum")]]
    counts = p.select(*keys, "_bright", F.explode(F.array(*of)).alias("x")).select(*keys, "_bright", "x.*").filter("_v is not null")
    counts = counts.groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_ka"), F.count_if(is_b).alias("_kb"))
    w = W.partitionBy(*keys, "_c")
    for k in ("a", "b"):
        counts = counts.withColumns({f"_t{k}": F.sum(f"_k{k}").over(w), f"_u{k}": F.sum(f"_k{k}").over(w.orderBy("_v"))})

    def median(name: str, k: str):
        n, upto, own = F.col(f"_t{k}"), F.col(f"_u{k}"), F.col(f"_k{k}")
        holds = lambda place: F.max(F.when((F.col("_c") == name) & (upto - own < place) & (place <= upto), F.col("_v")))
        return (holds(F.floor((n + 1) / 2)) + holds(F.floor((n + 2) / 2))) / 2.0

    scale = {**{c: 1.0 for c in rgb}, "lum": 3.0}
    med = counts.groupBy(*keys).agg(*[(median(c, k) / v).alias(f"_{k}_{c}") for c, v in scale.items() for k in ("a", "b")])
    g = g.join(med, [g[k].eqNullSafe(med[k]) for k in keys]).drop(*[med[k] for k in keys])
    use = (F.col("_nb") >= min_bright) & (F.col("_nb") >= F.col("_n") * share)
    pick = lambda k: F.when(use, F.col(f"_b_{k}")).otherwise(F.col(f"_a_{k}"))
    out = g.select(*keys, use.alias("from_bright"), *[pick(c).alias(f"med_{c}") for c in rgb], pick("lum").alias("lum_median"), pick("std").alias("lum_std"))
    m = [F.col(f"med_{c}") for c in rgb]
    spread = F.greatest(*m) - F.least(*m)
    return out.withColumn("usable", (F.col("lum_median") >= 220) & (F.col("lum_std") <= 18) & (spread <= 18))
