"""Several writers at once: one winner for each version, no update lost; and the progress of searches."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stripline.operators import paths as P
from stripline.progress import cut_observed, on_progress
from stripline.sources import sinks as K

N = 8


def together(fn):
    with ThreadPoolExecutor(N) as pool:
        jobs = [pool.submit(fn, k) for k in range(N)]
    return [j.exception() or j.result() for j in jobs]


def fine(df):
    return df.filter("bad")


def piece(spark, k, bad=False):
    return spark.createDataFrame([(k, bad)], "k long, bad boolean")


def test_one_of_eight_promotions_wins_and_the_others_see_the_conflict(spark, tmp_path):
    root = str(tmp_path / "a")
    got = together(lambda k: K.promote_versioned(piece(spark, k), fine, root, replace=True))
    made = [x for x in got if isinstance(x, str)]
    n, current = K.latest_version(spark, root)
    assert all(isinstance(x, K.PromotionConflict) for x in got if not isinstance(x, str)) and len(made) == n >= 1 and current in made
    assert sorted(x for x in os.listdir(f"{root}/_versions") if x.isdigit()) == [f"{i:012d}" for i in range(1, n + 1)]
    assert not [x for x in os.listdir(f"{root}/_versions") if not x.isdigit() and not x.startswith(".")]


def test_promotions_that_try_again_get_a_number_each(spark, tmp_path):
    root = str(tmp_path / "b")
    got = together(lambda k: K.promote_versioned(piece(spark, k), fine, root, replace=True, retries=20))
    assert sorted(got) == sorted({spark.read.text(f"{root}/_versions/{i:012d}").first()[0] for i in range(1, N + 1)}) and K.latest_version(spark, root)[0] == N


def test_a_valid_official_version_stays(spark, tmp_path):
    root = str(tmp_path / "c")
    got = together(lambda k: K.promote_versioned(piece(spark, k), fine, root))
    assert sum(isinstance(x, str) for x in got) == 1 and sum(isinstance(x, ValueError) for x in got) == N - 1
    with pytest.raises(ValueError, match="has errors"):
        K.promote_versioned(piece(spark, 9, bad=True), fine, root, replace=True)
    assert K.latest_version(spark, root)[0] == 1


def test_no_update_is_lost(spark, tmp_path):
    root = str(tmp_path / "d")

    def add(k):
        return K.update_versioned(spark, root, lambda now: piece(spark, k) if now is None else now.unionByName(piece(spark, k)))

    together(add)
    assert sorted(r.k for r in spark.read.parquet(K.current_version(spark, root)).collect()) == list(range(N)) and K.latest_version(spark, root)[0] == N
    assert not K.claim_version(spark, root, N, "elsewhere") and K.current_version(spark, root) != "elsewhere"


def test_progress_counts_what_a_search_judges(spark):
    rnd = random.Random(4)
    regions = spark.createDataFrame([("a", 0, 60_000), ("b", 100, 30_100)], "ch string, s long, e long")
    marks = sorted({(ch, rnd.randrange(1, 60_000)) for ch in "ab" for _ in range(400)})
    safe = spark.createDataFrame(marks, "ch string, y long")
    heard = []
    with on_progress(lambda step, m: heard.append((step, m))):
        got = P.exhaustive_composition(regions, safe).collect()
    judged = P.into_zones(safe, P.zoned(regions), ["ch"], "y").count()
    first = next(m for step, m in heard if step == "exhaustive_composition")
    assert first["positions"] == first["rows"] == judged
    assert any(step == "best_paths" and m["nodes"] > 0 for step, m in heard)
    n = len(heard)
    assert sorted(map(tuple, got)) == sorted(map(tuple, P.exhaustive_composition(regions, safe).collect())) and len(heard) == n


def test_several_listeners_and_none(spark):
    a, b = [], []
    df = spark.range(7)
    with on_progress(lambda *x: a.append(x)), on_progress(lambda *x: b.append(x)):
        assert cut_observed(df, "step", top=F.max("id")).count() == 7
    cut_observed(df, "step")
    assert a == b == [("step", {"rows": 7, "top": 6})]


def test_tree_diff_reads_one_leaf_for_one_changed_row(spark):
    from stripline.operators.lineage import hash_tree, tree_diff
    from stripline.session import cut

    n = 200_000
    a = cut(spark.range(n).select("id", F.concat(F.lit("file-"), F.col("id").cast("string")).alias("name"), (F.col("id") * 3).alias("size")))
    b = cut(a.withColumn("size", F.when(F.col("id") == 123_457, 0).otherwise(F.col("size"))))
    trees = tuple(hash_tree(x, [], "id", ["name", "size"], fan=256) for x in (a, b))
    heard = {}
    with on_progress(lambda step, m: heard.update({step: m["rows"]})):
        got = tree_diff(a, b, [], "id", ["name", "size"], trees, fan=256).collect()
    assert sorted((r.id, r.size, r.side) for r in got) == [(123_457, 0, "right"), (123_457, 370_371, "left")]
    assert heard == {"tree_diff_left": 256, "tree_diff_right": 256}
    assert tree_diff(a, a, [], "id", ["name", "size"], (trees[0], trees[0]), fan=256).count() == 0


def test_tree_diff_by_key_with_nulls_and_missing_rows(spark):
    from stripline.operators.lineage import tree_diff

    rnd = random.Random(6)
    left = [(k, i, rnd.choice([None, "x", "y"])) for k in ("a", "b") for i in range(0, 400, rnd.choice([1, 3]))]
    right = [(k, i, "z" if i % 97 == 5 else v) for k, i, v in left if i % 89 != 3] + [("c", 7, None)]
    schema = "k string, i long, v string"
    for most in (200, 0):
        got = tree_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "i", ["v"], fan=8, most_ranges=most).collect()
        want = {(*r, "left") for r in set(left) - set(right)} | {(*r, "right") for r in set(right) - set(left)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)
