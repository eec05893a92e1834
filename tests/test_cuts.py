from stripline.operators import bands as B
from stripline.operators import cuts as C


def table(spark, rows, total):
    b = spark.createDataFrame([("a", "white_band", (s + e) // 2, e - s, r, total) for s, e, r in rows], "ch string, kind string, center long, height long, ratio double, total long")
    return b, spark.createDataFrame([("a", total)], "ch string, total long")


def test_short_band_is_rejected_and_the_next_chosen(spark):
    d = C.cut_decisions(*table(spark, [(6900, 6972, 1.0), (8000, 8200, 1.0)], 16000)).collect()
    assert {(r.center, r.decision, r.reason) for r in d} == {(6936, "rejected", "white_band_too_short"), (8100, "selected", "safe_band_near_target")}


def test_no_cut_is_forced(spark):
    b, t = table(spark, [(100, 400, 1.0)], 40000)
    assert C.greedy_cut_path(b, t).count() == 0
    seg = C.level1_partition(b, t).collect()
    assert [(r.start, r.end, r.status) for r in seg] == [(0, 40000, "failed")]


def test_rescue_happens_once(spark):
    b, t = table(spark, [(13900, 14100, 1.0), (28900, 29100, 1.0)], 60000)
    seg = sorted((r.start, r.end, r.status) for r in C.level1_partition(b, t).collect())
    assert seg == [(0, 14000, "failed"), (14000, 60000, "failed")]


def test_walks_agree_over_block_sizes(spark):
    rows = [(p, p + 160 + p % 90, 0.99) for p in range(900, 90000, 1300)]
    b, t = table(spark, rows, 91000)
    want = sorted(map(tuple, C.greedy_cut_path(b, t).collect()))
    spark.conf.set("spark.stripline.block", "5000")
    try:
        assert sorted(map(tuple, C.greedy_cut_path(b, t).collect())) == want and len(want) > 5
    finally:
        spark.conf.unset("spark.stripline.block")


def test_bands_over_pages(spark):
    white = [1.0 if 20 <= y < 30 or 55 <= y < 60 else 0.0 for y in range(60)]
    df = spark.createDataFrame([("a", y, w, int(w * 256)) for y, w in enumerate(white)], "ch string, y long, white_ratio double, white_px long")
    got = sorted((r.start, r.end, r.height, r.white_ratio_mean) for r in B.white_bands(df, 0.985, width=25).collect())
    assert got == [(20, 30, 10, 1.0), (55, 60, 5, 1.0)]
