"""Jobs over decoded images (``width``, ``height``, ``data`` as top-down BGR bytes): one image per record, Arrow in and out.

Spark partitions the images; numpy works on one image at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.operators.blocks import overlap_join
from stripline.operators.graph import components, joined
from stripline.session import cut


BATCH_BYTES = 4 << 20  # of results that go back to Spark together


def joined_batches(batches: list) -> list:
    """Many small batches as one."""
    import pyarrow as pa

    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


def image_job(images: DataFrame, keys: Sequence[str], ddl: str, fn: Callable, extra: Sequence[str] = ()) -> DataFrame:
    """Rows of ``fn(pixels, record) -> dict of columns`` for every image, with the image's keys.

    ``pixels`` is a height x width x 3 array in BGR order.
    """
    keys = list(keys)
    fields = [f for f in images.schema.fields if f.name in keys]
    kt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        done, held = [], 0
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                w, h = cols["width"][i].as_py(), cols["height"][i].as_py()
                if not w or not h or w < 0:
                    continue
                px = three_channels(np.frombuffer(cols["data"][i].as_buffer(), dtype=np.uint8), h, w)
                res = fn(px, {c: cols[c][i].as_py() for c in extra})
                n = len(res[names[0]])
                if n:
                    head = [pa.repeat(cols[k][i], n) for k in keys]
                    done.append(pa.RecordBatch.from_arrays([*head, *[pa.array(res[c]) for c in names]], names=[*keys, *names]))
                    held += done[-1].nbytes
                if held > BATCH_BYTES:
                    yield from joined_batches(done)
                    done, held = [], 0
        yield from joined_batches(done)

    need = images.select(*keys, "width", "height", "data", *[c for c in extra if c not in keys])
    return need.mapInArrow(run, f"{kt}, {ddl}")


def three_channels(data, h: int, w: int):
    """Pixels in BGR order: gray is repeated, the alpha of a fourth channel dropped."""
    import numpy as np

    px = data.reshape(h, w, -1)
    if px.shape[2] not in (1, 3, 4):
        raise ValueError(f"{px.shape[2]} channels in an image of {w} x {h}")
    return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px[..., :3]


def luminance(px):
    """Integer luma of the usual 601 weights."""
    import numpy as np

    p = px.astype(np.int64)
    return (p[..., 2] * 19595 + p[..., 1] * 38470 + p[..., 0] * 7471 + 32768) >> 16


def row_profile(images: DataFrame, keys: Sequence[str], light: int = 245, edge: int = 24) -> DataFrame:
    """One record per pixel row: light pixels, channel means, highest channel spread, change to the row above and moments.

    The change is 0 on the first row of every page.
    """
    def fn(px, _):
        import numpy as np

        lum = luminance(px)
        f = px.astype(np.float64)
        means = f.mean(axis=1)
        delta = np.zeros(len(px))
        if len(px) > 1:
            delta[1:] = np.abs(means[1:] - means[:-1]).max(axis=1)
        step = np.abs(np.diff(lum, axis=1)) >= edge
        return {"y": np.arange(len(px)), "n": np.full(len(px), px.shape[1]), "white_px": (lum >= light).sum(axis=1), "b": means[:, 0], "g": means[:, 1], "r": means[:, 2],
                "std": f.std(axis=1).max(axis=1), "delta": delta, "s1": lum.sum(axis=1), "s2": (lum * lum).sum(axis=1), "edges": step.sum(axis=1)}

    return image_job(images, keys, "y long, n long, white_px long, b double, g double, r double, std double, delta double, s1 long, s2 long, edges long", fn)


def slice_features(images: DataFrame, keys: Sequence[str], content: int = 242, bright: int = 245, dark: int = 60) -> DataFrame:
    """Six features of every page slice: mean, spread, content share, bright share, dark share, spread of the row density."""
    def fn(px, _):
        lum = luminance(px)
        c = lum < content
        return {"mean": [float(lum.mean())], "std": [float(lum.std())], "content": [float(c.mean())], "bright": [float((lum >= bright).mean())],
                "dark": [float((lum <= dark).mean())], "row_std": [float(c.mean(axis=1).std())]}

    return image_job(images, keys, "mean double, std double, content double, bright double, dark double, row_std double", fn)


def row_sums(px):
    """Per row and channel: sum and sum of squares; per row: sum of absolute steps to the right, and down to the next row (0 on the last)."""
    import numpy as np

    p = px.astype(np.int64)
    down = np.zeros(len(p), np.int64)
    down[:-1] = np.abs(p[1:] - p[:-1]).sum(axis=(1, 2))
    return p.sum(axis=1), (p * p).sum(axis=1), np.abs(p[:, 1:] - p[:, :-1]).sum(axis=(1, 2)), down


def flatness(px, first, height: int):
    """Largest channel deviation and larger mean step of the strips of ``height`` rows that begin at the rows ``first``, from running row sums."""
    import numpy as np

    def over(x, rows):
        total = np.concatenate([np.zeros((1, *x.shape[1:]), np.int64), np.cumsum(x, axis=0)])
        return total[first + rows] - total[first]

    one, two, right, down = row_sums(px)
    n, w = height * px.shape[1], px.shape[1]
    mean = over(one, height) / n
    spread = np.sqrt(np.maximum(over(two, height) / n - mean * mean, 0)).max(axis=1)
    across = over(right, height) / max(1, height * (w - 1) * 3)
    along = over(down, height - 1) / max(1, (height - 1) * w * 3)
    return spread, np.maximum(across, along)


def strip_scan(images: DataFrame, keys: Sequence[str], std_max: float = 7.0, edge_max: float = 10.0, height: int = 18, sample: int = 256) -> DataFrame:
    """Flat strips of ``height`` rows every half height; the centre columns and the full width must both pass."""
    def fn(px, _):
        import numpy as np

        first = np.arange(0, max(0, len(px) - height + 1), max(4, height // 2))
        margin = max(0, px.shape[1] - sample) // 2
        middle, whole = flatness(px[:, margin:margin + sample], first, height), flatness(px, first, height)
        keep = np.all([m <= most for part in (middle, whole) for m, most in zip(part, (std_max, edge_max))], axis=0)
        cols = dict(zip(("uniform_std", "edge_mean", "full_std", "full_edge"), (*middle, *whole)))
        return {"y": first[keep], "center": first[keep] + height // 2, **{k: v[keep] for k, v in cols.items()}}

    return image_job(images, keys, "y long, center long, uniform_std double, edge_mean double, full_std double, full_edge double", fn)


STRIP_PIXELS = 1 << 20  # pixels of a strip that one task labels


def dark_components(images: DataFrame, keys: Sequence[str], threshold: int = 175, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """4-connected components of dark pixels: box and pixel count.

    An image of more than ``strip_pixels`` is cut into strips of whole rows, which spread over tasks and are labelled apart, by their runs of dark pixels.
    Components that touch the seam of two strips are joined where their runs overlap; all others are done.
    """
    keys = list(keys)
    kt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.schema.fields if f.name in keys)
    more = "strip long, strips long, label long, x long, y long, x2 long, y2 long, pixels long, top array<struct<a: bigint, z: bigint>>, bottom array<struct<a: bigint, z: bigint>>"

    def strips(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                w, h = cols["width"][i].as_py(), cols["height"][i].as_py()
                if not w or not h or w < 0:
                    continue
                data = np.frombuffer(cols["data"][i].as_buffer(), dtype=np.uint8)
                step = max(1, strip_pixels // w)
                of, row = -(-h // step), len(data) // h
                for s in range(of):
                    y, z = s * step, min(h, (s + 1) * step)
                    values = [cols[k].slice(i, 1) for k in keys] + [pa.array([v], pa.int64()) for v in (s, of, y, w, z - y)]
                    yield pa.RecordBatch.from_arrays([*values, pa.array([data[y * row:z * row].tobytes()])], names=[*keys, "strip", "strips", "y", "width", "height", "data"])

    def label(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                w, h, top = (cols[k][i].as_py() for k in ("width", "height", "y"))
                px = three_channels(np.frombuffer(cols["data"][i].as_buffer(), dtype=np.uint8), h, w)
                ys, x0, x1 = _dark_runs(px, threshold)
                if not len(ys):
                    continue
                ids, inv = np.unique(_linked_runs(ys, x0, x1, w), return_inverse=True)
                order = np.argsort(inv, kind="stable")
                at = np.searchsorted(inv[order], np.arange(len(ids)))
                a, z, y = x0[order], x1[order], ys[order]
                stats = [ids, np.minimum.reduceat(a, at), top + np.minimum.reduceat(y, at), np.maximum.reduceat(z, at), top + np.maximum.reduceat(y, at) + 1, np.add.reduceat(z - a, at)]
                seam = []
                for row, there in ((0, top > 0), (h - 1, cols["strip"][i].as_py() + 1 < cols["strips"][i].as_py())):
                    found = [[] for _ in ids]
                    for k in np.flatnonzero(ys == row).tolist() if there else ():
                        found[inv[k]].append({"a": int(x0[k]), "z": int(x1[k])})
                    seam.append(pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))))
                head = [pa.repeat(cols[k][i], len(ids)) for k in (*keys, "strip", "strips")]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(v) for v in stats], *seam], names=[*keys, *[c.split()[0] for c in more.split(", ") if ":" not in c], "top", "bottom"])

    one = F.col("width").cast("long") * F.col("height") <= strip_pixels
    whole = images.filter(one & (F.col("width") > 0) & (F.col("height") > 0)).select(
        *keys, *[F.lit(v).cast("long").alias(c) for c, v in (("strip", 0), ("strips", 1), ("y", 0))], "width", "height", "data")
    size = [F.col("x"), F.col("y"), (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "pixels"]
    done = whole.mapInArrow(label, f"{kt}, {more}").select(*keys, *size)
    large = images.filter(~one)
    if large.isEmpty():
        return done
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cutup = large.select(*keys, "width", "height", "data").mapInArrow(strips, f"{kt}, strip long, strips long, y long, width long, height long, data binary")
    parts = cut(cutup.repartition(n, *keys, "strip").mapInArrow(label, f"{kt}, {more}"))
    touches = (F.size("top") > 0) | (F.size("bottom") > 0)
    done = done.unionByName(parts.filter(~touches).select(*keys, *size))
    open_ = parts.filter(touches).withColumn("node", F.to_json(F.struct(*keys, "strip", "label")))
    run = lambda c, shift: open_.select(*keys, (F.col("strip") + shift).alias("_s"), F.col("node").alias(c), F.explode("bottom" if shift else "top").alias("r")).select(
        *keys, "_s", c, F.col("r.a").alias(f"{c}0"), F.col("r.z").alias(f"{c}1"))
    edges = overlap_join(run("a", 1), run("b", 0), [*keys, "_s"], ("a0", "a1"), ("b0", "b1"), 1 << 14).select("a", "b").distinct()
    seamed = open_.join(components(edges), "node", "left").withColumn("_g", F.coalesce("component", "node"))
    low, high = [[f(c).alias(c) for c in cs] for f, cs in ((F.min, ("x", "y")), (F.max, ("x2", "y2")))]
    return done.unionByName(seamed.groupBy(*keys, "_g").agg(*low, *high, F.sum("pixels").alias("pixels")).select(*keys, *size))


def _dark_runs(px, threshold: int):
    """Row, start and end of all runs of dark pixels, in reading order."""
    import numpy as np

    dark = np.round(px.mean(axis=2)) <= threshold
    edge = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, x0 = np.nonzero(edge == 1)
    return ys, x0, np.nonzero(edge == -1)[1]


def _linked_runs(ys, x0, x1, width: int):
    """Component of each run; the runs of the row above that one overlaps are neighbours, so two searches find them."""
    import numpy as np

    above = (ys - 1) * (width + 1)
    first = np.searchsorted(ys * (width + 1) + x1, above + x0, "right")
    n = np.maximum(0, np.searchsorted(ys * (width + 1) + x0, above + x1, "left") - first)
    a = np.repeat(np.arange(len(ys)), n)
    b = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(a))
    return joined(len(ys), a, b)


def component_context(images: DataFrame, keys: Sequence[str], band: int = 12) -> DataFrame:
    """Mean and spread inside a box (columns x, y, w, h of the record) and the range of the means along its sides."""
    def fn(px, rec):
        import numpy as np

        g = luminance(px)
        x, y, w, h = rec["x"], rec["y"], rec["w"], rec["h"]
        inside = g[y:y + h, x:x + w]
        none = {k: [] for k in ("inside_mean", "inside_std", "context_range", "sides")}
        if not inside.size:
            return none
        around = [g[max(0, y - band):y, x:x + w], g[y + h:y + h + band, x:x + w], g[y:y + h, max(0, x - band):x], g[y:y + h, x + w:x + w + band]]
        means = [float(a.mean()) for a in around if a.size]
        return {"inside_mean": [float(inside.mean())], "inside_std": [float(np.std(inside))], "context_range": [max(means) - min(means) if len(means) >= 2 else 0.0], "sides": [len(means)]}

    return image_job(images, keys, "inside_mean double, inside_std double, context_range double, sides long", fn, ["x", "y", "w", "h"])


def pixel_diff(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed pixels between ``data`` and ``other`` per row, and how many lie outside the mask (one byte per pixel)."""
    def fn(px, rec):
        import numpy as np

        other = np.frombuffer(rec["other"], dtype=np.uint8).reshape(px.shape)
        mask = np.frombuffer(rec["mask"], dtype=np.uint8).reshape(px.shape[:2]) > 0
        changed = (px != other).any(axis=2)
        return {"y": np.arange(len(px)), "changed": changed.sum(axis=1), "outside_mask": (changed & ~mask).sum(axis=1)}

    return image_job(pairs, keys, "y long, changed long, outside_mask long", fn, ["other", "mask"])


def masked_composite(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Image with the replacement's pixels inside the mask and its own outside."""
    def fn(px, rec):
        import numpy as np

        other = np.frombuffer(rec["other"], dtype=np.uint8).reshape(px.shape)
        mask = np.frombuffer(rec["mask"], dtype=np.uint8).reshape(px.shape[:2]) > 0
        return {"w": [px.shape[1]], "h": [px.shape[0]], "out": [np.where(mask[..., None], other, px).astype(np.uint8).tobytes()]}

    return image_job(pairs, keys, "w long, h long, out binary", fn, ["other", "mask"])


def crop_rows(images: DataFrame, start: str, stop: str) -> DataFrame:
    """Row slice of every image as bytes, by a substring of the pixel data: no Python involved.  That of an image without rows is empty."""
    from pyspark.sql import functions as F

    row = F.expr("octet_length(data) div greatest(height, 1)")
    return images.withColumn("slice", F.substring("data", (F.col(start) * row + 1).cast("int"), ((F.col(stop) - F.col(start)) * row).cast("int")))


def stack_rows(slices: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Slices of an output joined in axis order; an output is bounded by the maximum chunk height."""
    from pyspark.sql import functions as F

    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "slice"))), lambda x: x["slice"])
    return slices.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(parts, F.hex), "")).alias("data"), F.count(F.lit(1)).alias("n_slices"))
