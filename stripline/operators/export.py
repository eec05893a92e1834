"""Export plans, file sets and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripline.functions.names import is_exported


def export_plan(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Every eligible source file against the destination: new, identical (size and hash) or conflict.

    ``source``: rel, size, hash; ``destination``: rel, d_size, d_hash.
    """
    j = source.filter(is_exported("rel")).join(destination, "rel", "left")
    same = (F.col("size") == F.col("d_size")) & (F.col("hash") == F.col("d_hash"))
    return j.withColumn("status", F.when(F.col("d_hash").isNull(), "new").when(same, "identical").otherwise("conflict"))


def export_summary(plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col("status")
    a = plan.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(s == "new").alias("new_files"),
        F.count_if(s == "identical").alias("identical_files"), F.count_if(s == "conflict").alias("conflicts"))
    n, i, c = F.col("new_files"), F.col("identical_files"), F.col("conflicts")
    return a.withColumns({"can_export": (n > 0) & (c == 0), "already_exported": (n == 0) & (c == 0) & (i > 0)})


def export_copy(plan: DataFrame, contents: DataFrame, path: str) -> int:
    """Append the new files (rel, size, hash, content) to the destination table; any conflict stops it.  Returns the count."""
    if not plan.filter("status = 'conflict'").isEmpty():
        raise ValueError("the plan has conflicts")
    new = plan.filter("status = 'new'").select("rel", "size", "hash").join(contents, "rel")
    try:
        have = plan.sparkSession.read.parquet(path).select("rel")
        new = new.join(have, "rel", "left_anti")
    except Exception as e:  # a destination that does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    from stripline.session import cut
    new = cut(new)
    new.write.mode("append").parquet(path)
    return new.count()


def set_difference(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows on one side only, with the side."""
    from stripline.operators.compose import interval_difference
    return interval_difference(a, b, cols)


def stale_sources(stored: DataFrame, current: DataFrame, key: str = "rel") -> DataFrame:
    """Stored fingerprints whose file is missing or changed."""
    j = stored.join(current.select(key, F.col("hash").alias("_now")), key, "left")
    return j.withColumn("problem", F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("hash"), "changed")).filter("problem is not null").drop("_now")


def completeness(sources: DataFrame, outputs: DataFrame, key: str, kinds: Sequence[str] = ("clean", "mask")) -> DataFrame:
    """Sources that do not have exactly one output of every kind."""
    n = outputs.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    j = sources.join(n, key, "left").withColumns({f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)) for k in kinds})
    bad = F.lit(False)
    for k in kinds:
        bad = bad | (F.col(f"n_{k}") != 1)
    return j.filter(bad)
