"""Visual balance: features, ruptures, islands, anchors and the proposal built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.operators.blocks import best, halo, neighbours, spread, top_k

CH = ["ch"]
FEATURES = [f"f{i}" for i in range(1, 7)]


def standardize(units: DataFrame, keys: Sequence[str] = CH, features: Sequence[str] = FEATURES) -> DataFrame:
    """Features minus their mean over their population spread; a spread of 0 counts as 1.  Adds ``n``, the units per key."""
    keys = list(keys)
    s = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    j = units.join(s, keys)
    z = {f"z{i}": (F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}")) for i, f in enumerate(features, 1)}
    return j.withColumns(z).drop(*[f"_{k}_{f}" for k in "ms" for f in features])


def ruptures(z: DataFrame, keys: Sequence[str] = CH, number: str = "page_no", dims: int = 6) -> DataFrame:
    """Distance of every unit to the one before, and the strongest three per key that come close to the highest."""
    keys = list(keys)
    lag = neighbours(z, keys, number, {f"_p{i}": f"z{i}" for i in range(1, dims + 1)}).filter("_p1 is not null")
    sq = [(F.col(f"z{i}") - F.col(f"_p{i}")) * (F.col(f"z{i}") - F.col(f"_p{i}")) for i in range(1, dims + 1)]
    total = sq[0]
    for s in sq[1:]:
        total = total + s
    s = lag.select(*keys, number, "gs", F.sqrt(total).alias("strength"))
    top = s.groupBy(*keys).agg(F.max("strength").alias("_max"))
    strong = s.join(top, keys).filter(F.col("strength") >= F.greatest(F.lit(2.0), F.col("_max") * 0.90)).drop("_max")
    return top_k(strong, keys, [-F.col("strength"), F.col("gs"), F.col(number)], 3)  # a page without rows begins where the next one does


def islands(z: DataFrame, strong: DataFrame, keys: Sequence[str] = CH, number: str = "page_no", dims: int = 6, width: int | None = None) -> DataFrame:
    """Windows of three or four units that are compact, lose compactness on both sides and differ from both contexts.

    Works in blocks of the unit number with a halo of the widest context, so a group never holds a whole region.
    """
    keys = list(keys)
    s = strong.select(*keys, number, F.lit(True).alias("strong"))
    u = z.join(s, [*keys, number], "left").withColumn("strong", F.coalesce("strong", F.lit(False)))
    u = u.select(*keys, number, "gs", "n", "strong", F.array(*[f"z{i}" for i in range(1, dims + 1)]).alias("z"))
    h = halo(u, keys, number, 4, 8, width)
    kt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in z.schema.fields if f.name in keys)

    def run(group):
        import numpy as np
        import pyarrow as pa

        t = group.sort_by(number)
        no = np.array(t.column(number))
        m = np.array(t.column("z").to_pylist(), dtype=float)
        gs, strong_, home = np.array(t.column("gs")), np.array(t.column("strong").to_pylist(), bool), np.array(t.column("_home").to_pylist(), bool)
        n, k = t.column("n")[0].as_py(), len(no)
        low = no[0]
        total = np.vstack([np.zeros(m.shape[1]), np.cumsum(m, axis=0)])
        got = []

        def spread(first, length):
            w = m[first[:, None] + np.arange(length)]
            return np.linalg.norm(w - w.mean(axis=1, keepdims=True), axis=2).mean(axis=1)

        def centre(a, b):
            return (total[b] - total[a]) / (b - a)[:, None]

        for length in (3, 4):
            a = np.flatnonzero(home & (no >= 2) & (no + length <= n))  # units are numbered from 1
            a = a[(a + length < k) & (a >= 1)]
            a = a[~strong_[a] & ~strong_[a + length]]
            if not len(a):
                continue
            inner = np.maximum(spread(a, length), 1e-9)
            left = spread(a - 1, length + 1) / inner - 1.0
            right = spread(a, length + 1) / inner - 1.0
            c = centre(a, a + length)
            lc = centre(np.maximum(0, np.maximum(a - 3, 1 - low)), a)
            rc = centre(a + length, np.minimum(k, a + length + 3))
            contrast = np.minimum(np.linalg.norm(c - lc, axis=1), np.linalg.norm(c - rc, axis=1))
            ok = (inner <= 0.75) & (left >= 0.25) & (right >= 0.25) & (contrast >= 0.65)
            for i in np.flatnonzero(ok):
                score = left[i] + right[i] + contrast[i] - inner[i]
                got.append((int(no[a[i]]), int(no[a[i]]) + length, int(gs[a[i]]), int(gs[a[i] + length]), *[round(float(v), 6) for v in (inner[i], left[i], right[i], contrast[i], score)]))
        names = ["first_no", "end_no", "start_y", "end_y", "internal", "gain_left", "gain_right", "contrast", "score"]
        kinds = [pa.int64()] * 4 + [pa.float64()] * 5
        head = [pa.repeat(t.column(x)[0], len(got)) if got else t.column(x).slice(0, 0).combine_chunks() for x in keys]
        return pa.table([*head, *[pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]], names=[*keys, *names])

    return spread(h, *keys, "_b").groupBy(*keys, "_b").applyInArrow(run, f"{kt}, first_no long, end_no long, start_y long, end_y long, internal double, gain_left double, gain_right double, contrast double, score double")


def pick_islands(found: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """The best island of a key and the best one that does not overlap it."""
    keys = list(keys)
    order = [-F.col("score"), F.col("internal"), F.col("start_y"), F.col("end_y")]
    first = best(found, keys, order)
    span = first.select(*keys, F.col("first_no").alias("_a"), F.col("end_no").alias("_z"))
    rest = found.join(span, keys).filter("end_no <= _a or first_no >= _z").drop("_a", "_z")
    return first.withColumn("rank", F.lit(1).cast("long")).unionByName(best(rest, keys, order).withColumn("rank", F.lit(2).cast("long")))


def select_anchors(units: DataFrame, strong: DataFrame, chosen: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Anchors of a region by priority, at least two median heights apart and away from the ends.

    A key has at most seven of them: three ruptures and both ends of two islands.
    """
    keys = list(keys)
    r = strong.select(*keys, F.col("gs").alias("y"), F.lit("strong_regime_rupture").alias("reason"), (F.lit(100.0) + F.col("strength")).alias("priority"))
    ends = F.explode(F.array(F.struct(F.col("start_y").alias("y"), F.lit("visual_island_start").alias("reason")), F.struct(F.col("end_y").alias("y"), F.lit("visual_island_end").alias("reason"))))
    i = chosen.withColumn("x", ends).select(*keys, "x.y", "x.reason", (F.lit(80.0) + F.col("score")).alias("priority"))
    one = best(r.unionByName(i), [*keys, "y"], [-F.col("priority"), F.col("reason")])
    size = units.groupBy(*keys).agg(F.median("h").alias("_med"), F.min("gs").alias("_s"), F.max("ge").alias("_e"))
    size = size.withColumn("_gap", F.greatest(F.lit(1), F.bround(F.col("_med") * 2.0).cast("long")))
    c = one.join(size, keys).filter("y - _s >= _gap and _e - y >= _gap")
    item = F.struct((-F.col("priority")).alias("np"), "y", "reason")
    g = c.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("_gap").alias("min_gap"))
    empty = F.slice("items", 1, 0)
    kept = F.aggregate("items", empty, lambda acc, x: F.when(F.exists(acc, lambda o: F.abs(o["y"] - x["y"]) < F.col("min_gap")), acc).otherwise(F.concat(acc, F.array(x))))
    return g.select(*keys, "min_gap", F.explode(kept).alias("k")).select(*keys, F.col("k.y").alias("y"), F.col("k.reason").alias("reason"), (-F.col("k.np")).alias("priority"), "min_gap")


def proposal(regions: DataFrame, snapped: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """A region has a proposal only if it has anchors and every one of them found a place in strict order."""
    keys = list(keys)
    s = snapped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anchors"), F.count_if(F.col("snapped_y").isNull()).alias("lost"), F.count_if(~F.col("order_ok")).alias("disordered"),
        F.array_join(F.transform(F.array_sort(F.collect_list("snapped_y")), lambda v: v.cast("string")), "-").alias("cuts"))
    j = regions.join(s, keys, "left")
    reason = (F.when(F.col("n") < 4, "too_few_slices").when(F.col("anchors").isNull(), "no_visual_anchor").when(F.col("lost") > 0, "no_safe_snap")
              .when(F.col("disordered") > 0, "anchors_not_increasing"))
    return j.withColumns({"reason": reason, "status": F.when(reason.isNull(), "PROPOSTA_GERADA").otherwise("SEM_PROPOSTA_SAFE"), "cuts": F.when(reason.isNull(), F.col("cuts"))})
