"""The main flow: from the level 1 cut to what level 5 leaves."""

from pyspark.sql import functions as F

from stripline.operators import escalation as X
from stripline.operators import evidence as E
from stripline.plans import standins as S
from stripline.plans.registry import out, query
from stripline.session import cut


def decided(spark, sf):
    """Evidence at every 500th row of a chapter, derived from the page it lies on."""
    p = S.strip(spark, sf).filter("ge > gs")
    at = p.withColumn("y", F.explode(F.sequence(F.ceil(F.col("gs") / 500) * 500, F.ceil(F.col("ge") / 500) * 500, F.lit(500).cast("long")))).filter("y >= gs and y < ge")
    k = (F.col("y") / 500).cast("long")
    rows = at.select("ch", "y", ((k + F.col("page_no")) % 23 * 1.0).alias("band_std"), (k % 31 / 1000.0).alias("edge_density"),
                     F.when(F.col("page_no") % 5 == 0, 1).otherwise(0).cast("long").alias("crossing_components"), F.lit(0).cast("long").alias("diagonal_crossings"),
                     (k % 6).alias("text_fx_clusters"), (k % 30 * 1.0).alias("text_fx_background_std"))
    return E.decide(rows)


def pieces(spark, sf):
    totals = S.chapter(spark, sf).select("ch", "total")
    return X.escalate(cut(S.band(spark, sf)), cut(S.strip(spark, sf)), totals, cut(decided(spark, sf)), 1500, 500), totals


@query("escalation")
def escalation(spark, sf):
    return out(pieces(spark, sf)[0], "ch", "start", "end", "level", "part")


@query("escalation_tiling", "select ch, total, total covered, 0::bigint n_gaps, 0::bigint n_overlaps, total last_row from t_chapter")
def escalation_tiling(spark, sf):
    """Each chapter is covered exactly once by the pieces of all levels."""
    return out(X.tiling_errors(*pieces(spark, sf)), "ch", "total", "covered", "n_gaps", "n_overlaps", "last_row")
