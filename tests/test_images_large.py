"""Components of images that spread over several tasks, and boxes of crowded pages."""

import random
import time

import numpy as np

from stripline.operators import images as I
from stripline.operators import textoff as X


def flood(dark):
    h, w = dark.shape
    seen, out = np.zeros_like(dark), []
    for y, x in zip(*np.nonzero(dark)):
        if seen[y, x]:
            continue
        stack, got = [(y, x)], []
        seen[y, x] = True
        while stack:
            cy, cx = stack.pop()
            got.append((cy, cx))
            for ny, nx in ((cy - 1, cx), (cy + 1, cx), (cy, cx - 1), (cy, cx + 1)):
                if 0 <= ny < h and 0 <= nx < w and dark[ny, nx] and not seen[ny, nx]:
                    seen[ny, nx] = True
                    stack.append((ny, nx))
        ys, xs = zip(*got)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(got)))
    return sorted(out)


def image(k, dark):
    return (k, dark.shape[1], dark.shape[0], np.repeat(np.where(dark, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2).tobytes())


def found(spark, rows, **size):
    df = spark.createDataFrame([(k, w, h, bytearray(d)) for k, w, h, d in rows], "k long, width int, height int, data binary")
    out = {}
    for r in I.dark_components(df, ["k"], **size).collect():
        out.setdefault(r.k, []).append((r.x, r.y, r.w, r.h, r.pixels))
    return {k: sorted(v) for k, v in out.items()}


def test_strips_give_the_components_of_the_whole(spark):
    rng = np.random.default_rng(1)
    spiral = np.zeros((61, 40), bool)
    spiral[::2] = True
    spiral[1::4, -1] = True
    spiral[3::4, 0] = True
    pictures = {k: rng.random((h, w)) < p for k, (h, w, p) in enumerate([(50, 30, 0.5), (7, 90, 0.6), (33, 1, 0.5), (1, 20, 0.5), (40, 17, 0.62), (20, 20, 0.0)])}
    pictures[9] = spiral
    rows = [image(k, d) for k, d in pictures.items()] + [(20, 0, 5, b""), (21, 4, 0, b"")]
    want = {k: flood(d) for k, d in pictures.items() if d.any()}
    assert found(spark, rows) == want
    for pixels in (1, 40, 200):
        assert found(spark, rows, strip_pixels=pixels) == want


def test_a_long_image_splits_over_tasks(spark):
    rng = np.random.default_rng(2)
    dark = rng.random((200_000, 16)) < 0.3
    dark[:, 3] = True  # one component from top to bottom
    rows = [image(1, dark)]
    got = found(spark, rows, strip_pixels=1 << 18)
    assert got == found(spark, rows) and max(h for _, _, _, h, _ in got[1]) == 200_000
    assert sum(n for *_, n in got[1]) == dark.sum()


def grouped(spark, rows, **size):
    df = spark.createDataFrame(rows, "page long, id string, x1 long, y1 long, x2 long, y2 long")
    return sorted((r.page, r.id, r.x1, r.y1, r.x2, r.y2, r.n) for r in X.merge_boxes(df, **size).collect())


def test_pages_merged_by_cells_and_alone_agree(spark):
    rnd = random.Random(3)
    rows = []
    for page in range(3):
        for k in range(300):
            x, y = rnd.randrange(0, 6000), rnd.randrange(0, 6000)
            rows.append((page, f"{page}-{k:03d}", x, y, x + rnd.choice([2, 40, 900]), y + rnd.choice([2, 40])))
    want = grouped(spark, rows)
    assert grouped(spark, rows, page_boxes=10) == want and grouped(spark, rows, page_boxes=10, cell=100) == want
    assert 3 < len(want) < 900 and sum(r[-1] for r in want) == 900


def test_a_crowded_cell_collapses_before_boxes_meet(spark):
    from pyspark.sql import functions as F

    n = 200_000
    k = F.col("id")
    boxes = spark.range(n).select(F.lit(1).alias("page"), k.cast("string").alias("id"), (k * 7919 % 480).alias("x1"), (k * 104729 % 480).alias("y1")) \
        .withColumns({"x2": F.col("x1") + 3, "y2": F.col("y1") + 3})
    assert X._collapsed(boxes.withColumn("n", F.lit(1)), 18, ["page"]).count() <= 27 * 27
    t = time.time()
    r = X.merge_boxes(boxes).collect()
    assert [(x.id, x.n) for x in r] == [("0", n)] and time.time() - t < 60


def test_pairs_of_a_crowd_are_joined_as_they_come(monkeypatch):
    rng = np.random.default_rng(4)
    box = rng.integers(0, 60, (2, 400))
    box = np.concatenate([box, box + 3])
    page = np.repeat([0, 1], 200)
    group, merged = X._closed(page, box, 2)
    monkeypatch.setattr(X, "PER_TASK", 1)
    again, same = X._closed(page, box, 2)
    assert (merged == same).all() and (group == again).all()
