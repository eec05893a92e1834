import random

from stripline.operators import textoff as X
from stripline.operators.graph import components


def fixpoint(boxes, gap=18):
    boxes = [tuple(b) for b in boxes]
    while True:
        hit = None
        for i, (x1, y1, x2, y2) in enumerate(boxes):
            for j in range(i):
                a1, b1, a2, b2 = boxes[j]
                if not (x2 + gap < a1 or a2 + gap < x1 or y2 + gap < b1 or b2 + gap < y1):
                    hit = (j, i, (min(x1, a1), min(y1, b1), max(x2, a2), max(y2, b2)))
        if hit is None:
            return sorted(boxes)
        j, i, new = hit
        boxes = [b for k, b in enumerate(boxes) if k not in (i, j)] + [new]


def check(spark, pages):
    rows = [(p, f"{k:04d}", *b) for p, bs in pages.items() for k, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "page long, id string, x1 long, y1 long, x2 long, y2 long")
    got = X.merge_boxes(df).collect()
    for p, bs in pages.items():
        assert sorted((r.x1, r.y1, r.x2, r.y2) for r in got if r.page == p) == fixpoint(bs), p
        assert sum(r.n for r in got if r.page == p) == len(bs)


def test_merge_boxes_matches_pairwise_fixpoint(spark):
    rnd = random.Random(5)
    pages = {}
    for p in range(6):
        bs = []
        for _ in range(25):
            x, y = rnd.randrange(0, 1500), rnd.randrange(0, 1500)
            bs.append((x, y, x + rnd.randrange(2, 60), y + rnd.randrange(2, 60)))
        pages[p] = bs
    check(spark, pages)


def merged(spark, rows, gap, **size):
    df = spark.createDataFrame([(1, f"{k:04d}", *b) for k, b in enumerate(rows)], "page long, id string, x1 long, y1 long, x2 long, y2 long")
    return sorted((r.x1, r.y1, r.x2, r.y2) for r in X.merge_boxes(df, gap, **size).collect())


def test_merge_boxes_of_any_gap_and_density(spark):
    grid = [(x * 6, y * 6, x * 6 + 2, y * 6 + 2) for x in range(20) for y in range(20)]
    assert merged(spark, grid, 4) == [(0, 0, 116, 116)]
    assert merged(spark, grid, 3) == sorted(grid)
    assert merged(spark, [(0, 0, 5, 5), (5, 5, 9, 9), (11, 0, 12, 2)], 0) == [(0, 0, 9, 9), (11, 0, 12, 2)]


def test_merge_boxes_along_a_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(X, "components", lambda e: rounds.append(1) or components(e))
    assert merged(spark, [(k * 20, 0, k * 20 + 10, 10) for k in range(1000)], 18) == [(0, 0, 19990, 10)]
    assert len(rounds) <= 15


def test_merge_boxes_in_a_crowded_cell(spark):
    rnd = random.Random(6)
    dense = [(x, y, x + 2, y + 2) for x, y in ((rnd.randrange(0, 120), rnd.randrange(0, 120)) for _ in range(300))]
    check(spark, {1: dense[:60] + [(2000, 2000, 2010, 2010)], 2: dense})


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 2000 + k) for k in range(200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(301)} | {k: 1000 for k in [1000, *range(2000, 2200)]} | {5000: 5000, 5001: 5000}
    assert got == want
