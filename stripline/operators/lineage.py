"""Manifest chains, chapter states and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripline.progress import cut_observed
from stripline.session import cut

CH = ["ch"]
LEVELS = (2, 3, 4, 5)


def by_level(chapters: DataFrame, manifests: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """One row per chapter with the manifests of levels 2 to 5 as structs ``l2`` .. ``l5``: no self-joins along the chain."""
    keys = list(keys)
    body = F.struct("sha", "upstream_sha", "total_height", "residual_n")
    w = manifests.groupBy(*keys).agg(*[F.max(F.when(F.col("lvl") == n, body)).alias(f"l{n}") for n in LEVELS])
    w = chapters.join(w, keys, "left")
    for n in LEVELS[1:]:
        me, up = F.col(f"l{n}"), F.col(f"l{n - 1}")
        w = w.withColumn(f"p{n}", F.when(me.isNull(), "missing").when(up.isNull(), "missing_upstream")
                         .when(me["total_height"] != up["total_height"], "total_mismatch").when(me["upstream_sha"] != up["sha"], "stale").otherwise("ok"))
    return w.withColumn("p2", F.when(F.col("l2").isNull(), "missing").when(F.col("l2.total_height") != F.col("total"), "total_mismatch").otherwise("ok"))


def lineage(wide: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Every existing level: its own link and whether the whole chain above it holds."""
    chain, items = F.lit(True), []
    for n in LEVELS:
        chain = chain & (F.col(f"p{n}") == "ok")
        items.append(F.struct(F.lit(n).cast("long").alias("lvl"), F.col(f"p{n}").alias("link"), chain.alias("chain_ok")))
    return wide.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*").filter("link <> 'missing'")


def authority() -> Column:
    """Which level's residual counts, how large it is, or the error that blocks the chapter.  First matching rule wins."""
    def v(source, pending=None, error=None):
        return F.struct(F.lit(source).alias("source"), (pending if pending is not None else F.lit(None)).cast("long").alias("pending"),
                        F.lit(error).cast("string").alias("error"))

    def n(k):
        return F.col(f"l{k}.residual_n")

    c = F.when(F.col("p2") != "ok", v("historical"))
    c = c.when(F.col("l3").isNull() & (n(2) > 0), v("level3_pending", None, "level3_not_validated")).when(F.col("l3").isNull(), v("level2"))
    for k in (3, 4, 5):
        c = c.when(F.col(f"p{k}") == "total_mismatch", v(f"level{k}", None, f"level{k}_total_mismatch")).when(F.col(f"p{k}") == "stale", v(f"level{k}", None, f"level{k}_stale"))
        c = c.when(n(k) == 0, v(f"level{k}"))
        if k == 4:
            c = c.when(F.col("legacy"), v("legacy_level4", n(4)))
        if k < 5:
            c = c.when(F.col(f"l{k + 1}").isNull(), v(f"level{k}", n(k)))
    return c.otherwise(v("level5", n(5)))


def state_rows(wide: DataFrame) -> DataFrame:
    """Flags and merge state of every chapter.  Needs ``merge_ok`` and ``legacy`` beside the level columns."""
    def has(k):
        return F.coalesce(F.col(f"l{k}.residual_n") > 0, F.lit(False))

    def valid(k):
        ok = F.col("p2") == "ok"
        for j in range(3, k + 1):
            ok = ok & (F.col(f"p{j}") == "ok")
        return ok

    failed = ~F.col("merge_ok")
    l2 = F.col("p2") == "ok"
    w = wide.withColumns({
        "failed": failed, "level2_validated": l2, "validated_without_pending": l2 & ~has(2),
        "level3_pending": failed & l2 & has(2) & ~valid(3), "level4_pending": failed & valid(3) & has(3) & ~valid(4),
        "level5_pending": failed & valid(4) & has(4) & ~F.col("legacy") & ~valid(5)})
    review = failed & ~F.col("validated_without_pending") & (F.col("l2").isNull() | (l2 & ((valid(5) & has(5)) | (F.col("legacy") & valid(4) & has(4)))))
    w = w.withColumn("needs_review", review)
    state = (F.when(F.col("merge_ok"), "concluido").when(F.col("level3_pending"), "pendente_level3").when(F.col("level4_pending"), "pendente_level4")
             .when(F.col("level5_pending"), "pendente_level5").when(F.col("needs_review"), "pendente_review")
             .when(F.col("l2").isNotNull() | F.col("validated_without_pending"), "parcial").otherwise("novo"))
    return w.withColumn("merge_state", state)


def stage_detail(states: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Per level: residual count, whether it is the authoritative pending one and whether the chapter is finished there."""
    items = [F.struct(F.lit(k).cast("long").alias("lvl"), F.col(f"l{k}.residual_n").alias("residual"),
                      ((F.col("a.source") == f"level{k}") & F.col("a.pending").isNotNull()).alias("authoritative"),
                      (F.col("merge_ok") & (F.col(f"l{k}.residual_n") == 0)).alias("finalised")) for k in LEVELS]
    return states.withColumn("a", authority()).select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*").filter("residual is not null")


def work_summary(states: DataFrame) -> DataFrame:
    s = F.col("merge_state")
    return states.agg(
        F.count(F.lit(1)).alias("chapters"), F.count_if("merge_ok").alias("merges"), F.count_if(s == "pendente_review").alias("pending"),
        F.count_if(s == "novo").alias("new"), F.count_if(s == "parcial").alias("partial"), F.count_if("level3_pending").alias("level3_pending"),
        F.count_if("level4_pending").alias("level4_pending"), F.count_if("level5_pending").alias("level5_pending"),
        F.count_if("failed").alias("merge_failed"), F.count_if("needs_review").alias("review_pending"))


def manual_state(states: DataFrame) -> DataFrame:
    """Whether a chapter can go to manual work: outside, blocked, pending or resolved, and from which level."""
    five, chain5 = F.col("l5").isNotNull(), F.lit(True)
    for k in LEVELS:
        chain5 = chain5 & (F.col(f"p{k}") == "ok")
    n5, n4 = F.col("l5.residual_n"), F.col("l4.residual_n")
    inside = F.col("needs_review") | (F.col("merge_state") == "pendente_review")
    old = F.col("legacy") & F.col("l4").isNotNull() & (F.col("p4") == "ok")
    status = (F.when(~inside, "outside_review").when(five & ~chain5, "blocked").when(five & (n5 > 0), "pending").when(five, "resolved")
              .when(old & (n4 > 0), "pending").when(old, "resolved").otherwise("blocked"))
    source = F.when(~inside, None).when(five, "level5").when(old, "legacy_level4").otherwise("review")
    return states.withColumns({"status": status, "source": source})


def manual_summary(manual: DataFrame) -> DataFrame:
    s = F.col("status")
    return manual.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "pending").alias("pending"), F.count_if(s == "resolved").alias("resolved"), F.count_if(s == "blocked").alias("blocked"))


def manifest_snapshot(chapters: DataFrame, manifests: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Every chapter and level: whether the manifest exists, with hash and height."""
    grid = chapters.select(*keys, F.explode(F.array(*[F.lit(n).cast("long") for n in LEVELS])).alias("lvl"))
    j = grid.join(manifests.select(*keys, "lvl", "sha", "total_height"), [*keys, "lvl"], "left")
    return j.withColumn("present", F.col("sha").isNotNull())


def fingerprint(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], fan: int = 1024, levels: int = 3, name: str = "fingerprint") -> DataFrame:
    """SHA-256 of a key's rows in order, as a hash tree: rows, then groups of ``fan`` positions, and so on.

    A change of any field, of the order or of the set of rows changes it.  No group ever holds more than ``fan`` hashes
    until the top; ``fan ** levels`` positions meet there in one value per key.
    """
    keys = list(keys)
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields])
    h = rows.select(*keys, F.col(order).alias("_p"), F.sha2(text, 256).alias("_h"))
    for _ in range(levels):
        h = h.groupBy(*keys, F.floor(F.col("_p") / fan).alias("_q")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), ""), 256).alias("_h")).withColumnRenamed("_q", "_p")
    return h.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), ""), 256).alias(name))


def _parents(h: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """Hashes of groups of ``fan`` positions, from the hashes ``hash`` at ``pos``."""
    items = F.array_sort(F.collect_list(F.struct("pos", "hash")))
    return h.groupBy(*keys, F.floor(F.col("pos") / fan).alias("_q")).agg(
        F.sha2(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["pos"], x["hash"])), ","), 256).alias("hash")).withColumnRenamed("_q", "pos")


def hash_tree(rows: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], fan: int = 1024, levels: int = 3) -> DataFrame:
    """Hash tree of a key's rows by a unique integer position: keys, ``level`` (1: leaves of ``fan`` positions), ``pos`` in the level, ``hash``.  Written level by level."""
    keys = list(keys)
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    h, out = rows.select(*keys, F.col(order).cast("long").alias("pos"), F.sha2(text, 256).alias("hash")), None
    for level in range(1, levels + 1):
        h = cut(_parents(h, keys, fan))
        one = h.select(*keys, F.lit(level).alias("level"), "pos", "hash")
        out = one if out is None else out.unionByName(one)
    return out


def _stretches(numbers: Sequence[int]) -> list[tuple[int, int]]:
    """First and last of each run of successive numbers."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        out = [*out[:-1], (out[-1][0], n)] if out and n <= out[-1][1] + 1 else [*out, (n, n)]
    return out


def tree_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], trees: tuple[DataFrame, DataFrame] | None = None,
              fan: int = 1024, levels: int = 3, most_ranges: int = 200) -> DataFrame:
    """Rows that one side has and the other has not, or has otherwise: keys, ``order``, ``fields``, ``side``.

    The hash trees of the two sides (``trees``, kept from when the sides were written, else built here) are compared from the top, and only nodes whose hashes
    differ are opened; rows are read for differing leaves alone.  Up to ``most_ranges`` leaves become a filter on the position, which the scan can skip
    files and row groups by; more are joined.
    """
    keys = list(keys)
    a, b = trees or tuple(hash_tree(x, keys, order, fields, fan, levels) for x in (left, right))

    def differ(x: DataFrame, y: DataFrame) -> DataFrame:
        j = x.alias("x").join(y.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "pos")], "full")
        return j.filter(~F.col("x.hash").eqNullSafe(F.col("y.hash"))).select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in (*keys, "pos")])

    def below(nodes: DataFrame, of: DataFrame, at: str) -> DataFrame:
        o = of.withColumn("_up", F.floor(F.col(at) / fan))
        return o.join(nodes.withColumnRenamed("pos", "_up"), [*keys, "_up"], "left_semi").drop("_up")

    level = lambda t, n: t.filter(F.col("level") == n).drop("level")
    open_ = cut(differ(level(a, levels), level(b, levels)))
    for n in range(levels - 1, 0, -1):
        open_ = cut(differ(below(open_, level(a, n), "pos"), below(open_, level(b, n), "pos")))
    few = open_.select("pos").distinct().limit(most_ranges + 1).collect()
    sides = []
    for name, rows in (("left", left), ("right", right)):
        r = rows.select(*keys, order, *fields)
        if few and len(few) <= most_ranges:
            r = r.filter(reduce(or_, [F.col(order).between(i * fan, (j + 1) * fan - 1) for i, j in _stretches(sorted(x.pos for x in few))]))
        sides.append(cut_observed(below(open_, r, order), f"tree_diff_{name}"))
    return sides[0].exceptAll(sides[1]).withColumn("side", F.lit("left")).unionByName(sides[1].exceptAll(sides[0]).withColumn("side", F.lit("right")))
