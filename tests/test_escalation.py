"""Each level gets what the one before left; the pieces tile the chapter."""

from pyspark.sql import functions as F

from stripline.operators import escalation as X
from tests.test_paths import BAND, evidence, pages


def test_levels_follow_one_another(spark):
    totals = spark.createDataFrame([("a", 90000)], "ch string, total long")
    bands = spark.createDataFrame([("a", "white_band", 7000, 300, 1.0, None), ("a", "uniform_color_band", 24500, 900, None, 1.0), ("a", "white_band", 27000, 300, 1.0, None)], BAND).withColumn("total", F.lit(90000).cast("long"))
    d = evidence(spark, (39000, "SAFE"), (50500, "SAFE"), (51000, "UNSAFE"), (60000, "SAFE"), (70000, "SAFE"))
    d = d.withColumns({"band_std": F.lit(1.0)})
    got = X.escalate(bands, pages(spark, "a", 0, 90000), totals, d, keys=["ch"]).collect()
    spans = sorted((r.start, r.end) for r in got)
    assert spans[0][0] == 0 and spans[-1][1] == 90000 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    by = {(r.start, r.end): (r.level, r.part) for r in got}
    assert by[0, 7000] == (1, "chunk") and {r.level for r in got} >= {1, 3}
    assert all(r.part == "residual" or r.end - r.start <= 12000 for r in got)
    e = X.tiling_errors(spark.createDataFrame([("a", 0, 10), ("a", 8, 30)], "ch string, start long, end long"), totals).first()
    assert (e.covered, e.n_gaps, e.n_overlaps, e.last_row) == (32, 0, 1, 30)
