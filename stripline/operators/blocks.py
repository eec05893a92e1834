"""Ordered operators that stay parallel when one key holds most of the rows.

A window over ``partitionBy(chapter)`` puts a whole chapter in one task.  The operators here split every key's order
into blocks, work inside ``(key, block)`` groups of bounded size and exchange only one summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stripline.progress import cut_measured
from stripline.session import cut

# Defaults of the session settings ``spark.stripline.block``, ``.bucket`` and ``.slice``.
SIZES = {
    "block": 1 << 18,   # positions per block: the largest group any task sees
    "bucket": 1 << 14,  # axis bucket of the interval joins
    "slice": 1 << 20,   # rows of the axis a path search holds at once
}
FAN = 1 << 8  # blocks per block of the next level up


def size_of(df: DataFrame, kind: str, given: int | None = None) -> int:
    """``given``, else the session's setting, else the default."""
    return given or int(df.sparkSession.conf.get(f"spark.stripline.{kind}", str(SIZES[kind])))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Exchange by key ahead of grouped Python work, at full width: its cost is in the rows' work, not in their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


RUN_ROWS = 1 << 16  # of whole groups that are handed to Python together


def heads(table, keys: Sequence[str]):
    """Indices of the rows of an Arrow table that open a group of ``keys``; the rows of a group are neighbours."""
    import numpy as np
    import pyarrow.compute as pc

    n = table.num_rows
    new = np.arange(n) == 0
    for k in keys:
        c = table.column(k).combine_chunks()
        a, b = c.slice(0, max(0, n - 1)), c.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def by_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable, ddl: str) -> DataFrame:
    """Grouped Python work for very many small groups: ``work(table, first)`` gets whole groups of ``keys`` at once, sorted by ``order``.

    ``first`` holds the rows at which the groups begin.  A partition is sorted and read as a stream, of which ``RUN_ROWS`` rows and the rest of their last
    group are in memory: small groups share the cost of a call, and a large one is a call of its own.
    """
    keys, rows = list(keys), RUN_ROWS

    def run(batches):
        import pyarrow as pa

        held, size, most = [], 0, rows
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < most:
                continue
            t = pa.Table.from_batches(held)
            first = heads(t, keys)
            if first[-1]:
                yield from work(t.slice(0, first[-1]), first[:-1]).to_batches()
                t = t.slice(first[-1])
            held, size = t.to_batches(), t.num_rows
            most = max(rows, 2 * size)
        if size:
            t = pa.Table.from_batches(held)
            yield from work(t, heads(t, keys)).to_batches()

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def id_blocks(df: DataFrame, pos: str, width: int | None = None) -> DataFrame:
    """Block column ``_b`` from a unique integer order column: at most ``width`` rows per (key, block)."""
    width = size_of(df, "block", width)
    return df.withColumn("_b", F.floor(F.col(pos) / width))


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Block column ``_b`` for any order columns: contiguous ranges of (keys, order) of about equal row counts, at most about a block's rows each.

    The range bounds are sampled, so the result is written once; every later reader sees the same blocks.
    """
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // size_of(df, "block")))
    cols = [*keys, *order]
    return cut(df.repartitionByRange(n, *cols).withColumn("_b", F.spark_partition_id().cast("long")))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str | Column] | None = None,
    number: str | None = None,
    totals: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Exclusive running sums, 1-based row numbers and key totals over a blocked frame (column ``_b``).

    Rows move once, to their (key, block) group; the carry holds one row per block.
    """
    sums, totals = dict(sums or {}), dict(totals or {})
    keys = list(keys)
    per = df.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(_c(c)).alias(f"_s_{k}") for k, c in sums.items()],
        *[F.sum(_c(c)).alias(f"_t_{k}") for k, c in totals.items()],
    )
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    carry = per.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cn"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(whole).alias(k) for k in totals],
    )
    here = W.partitionBy(*keys, "_b").orderBy(*order)
    prior = here.rowsBetween(W.unboundedPreceding, -1)
    out = df.join(carry, [*keys, "_b"])
    new = {k: F.coalesce(F.sum(_c(c)).over(prior), F.lit(0)) + F.col(f"_c_{k}") for k, c in sums.items()}
    if number:
        new[number] = F.row_number().over(here).cast("long") + F.col("_cn")
    return out.withColumns(new).drop("_cn", *[f"_c_{k}" for k in sums])


def halo(df: DataFrame, keys: Sequence[str], pos: str, before: int = 0, after: int = 0, width: int | None = None) -> DataFrame:
    """Rows with their block ``_b`` plus copies for the neighbour blocks that look ``before``/``after`` positions over the edge.

    ``_home`` marks the original.  Follow with a window over :func:`block_window` and filter on ``_home``.
    """
    width = size_of(df, "block", width)
    p = F.col(pos)
    first = F.floor((p - after) / width)
    last = F.floor((p + before) / width)
    out = df.withColumn("_b", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return out.withColumn("_home", F.col("_b") == F.floor(p / width))


def block_window(keys: Sequence[str], *order: str | Column):
    return W.partitionBy(*keys, "_b").orderBy(*order)


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, lags: Mapping[str, str] | None = None,
               leads: Mapping[str, str] | None = None, reach: int = 1, width: int | None = None) -> DataFrame:
    """``lag``/``lead`` by one along a dense integer position, without a window over the whole key."""
    h = halo(df, keys, pos, reach, reach, width)
    w = block_window(keys, pos)
    new = {o: F.lag(c).over(w) for o, c in (lags or {}).items()}
    new |= {o: F.lead(c).over(w) for o, c in (leads or {}).items()}
    return h.withColumns(new).filter("_home").drop("_b", "_home")


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    gap: int = 1,
    aggs: Mapping[str, tuple[str, str | Column]] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Maximal groups of positions whose neighbours are at most ``gap`` apart: ``start``, ``last``, ``n`` and ``aggs``.

    ``aggs`` maps a name to (``sum``/``min``/``max``, column).  Groups are found inside blocks; only those touching a
    block edge, at most two per block, are merged along the key.
    """
    width = size_of(df, "block", width)
    aggs = dict(aggs or {})
    keys = list(keys)
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    w = W.partitionBy(*keys, "_b").orderBy(pos)
    local = (
        id_blocks(df, pos, width)
        .withColumn("_new", F.coalesce(F.col(pos) - F.lag(pos).over(w) > gap, F.lit(True)).cast("int"))
        .withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    part = local.groupBy(*keys, "_b", "_g").agg(
        F.min(pos).alias("start"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("n"),
        *[fn[k](_c(c)).alias(name) for name, (k, c) in aggs.items()],
    )
    edge = (F.col("start") - F.col("_b") * width < gap) | ((F.col("_b") + 1) * width - F.col("last") <= gap)
    names = ["start", "last", "n", *aggs]
    inner = part.filter(~edge).select(*keys, *names)
    k = W.partitionBy(*keys).orderBy("start")
    border = (
        part.filter(edge)
        .withColumn("_new", F.coalesce(F.col("start") - F.lag("last").over(k) > gap, F.lit(True)).cast("int"))
        .withColumn("_g", F.sum("_new").over(k.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_g")
        .agg(
            F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"),
            *[fn[k](name).alias(name) for name, (k, _) in aggs.items()],
        )
        .select(*keys, *names)
    )
    return inner.unionByName(border)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str],
                 width: int | None = None) -> DataFrame:
    """Inner join on equal keys and intersecting half-open intervals.

    Intervals meet in the axis buckets they touch, so a long strip is spread over many tasks; a pair counts in the one
    bucket where its intersection starts.
    """
    width = size_of(left, "bucket", width)

    def buckets(df, s, e):
        return df.withColumn("_k", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width))))

    a, b = buckets(left, *l), buckets(right, *r)
    both = a.join(b, [*keys, "_k"])
    lo = F.greatest(F.col(l[0]), F.col(r[0]))
    return both.filter((lo < F.least(F.col(l[1]), F.col(r[1]))) & (F.floor(lo / width) == F.col("_k"))).drop("_k")


def point_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, span: tuple[str, str],
               width: int | None = None) -> DataFrame:
    """Inner join of points with the half-open intervals that contain them."""
    width = size_of(points, "bucket", width)
    p = points.withColumn("_k", F.floor(F.col(at) / width))
    s = spans.withColumn("_k", F.explode(F.sequence(F.floor(F.col(span[0]) / width),
                                                    F.floor((F.greatest(F.col(span[1]), F.col(span[0]) + 1) - 1) / width))))
    return p.join(s, [*keys, "_k"]).filter((F.col(at) >= F.col(span[0])) & (F.col(at) < F.col(span[1]))).drop("_k")


def orbit(edges: DataFrame, starts: DataFrame, keys: Sequence[str], width: int | None = None, extent: int | None = None) -> DataFrame:
    """Rows of ``edges(keys, pos, nxt)`` met when walking from ``starts(keys, pos)`` along ``nxt``.

    Every position has one successor.  Inside a block the walk is followed directly.  Across blocks each entry position
    is replaced by its exit, which is the same problem with far fewer rows and wider blocks; the positions found there
    are then expanded inside their blocks again.
    """
    width = size_of(edges, "block", width)
    keys = list(keys)
    kt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields if f.name in keys)
    edges, found = cut_measured(edges.select(*keys, F.col("pos").cast("long"), F.col("nxt").cast("long")), "orbit", top=F.max("pos"))
    starts = starts.select(*keys, F.col("pos").cast("long")).distinct()
    if extent is None:
        extent = found["top"] or 0
    one_block = extent < width
    if one_block:
        entries = starts
    else:
        b, nb = F.floor(F.col("pos") / width), F.floor(F.col("nxt") / width)
        crossing = edges.filter(F.col("nxt").isNotNull() & (b != nb)).select(*keys, F.col("nxt").alias("pos"))
        entries = crossing.unionByName(starts).distinct()

    def walker(mark: bool):
        def walk(pos, nxt_of, entry):
            nxt = {p: n for p, n, e in zip(pos, nxt_of, entry) if not e}
            starting = [p for p, e in zip(pos, entry) if e and p in nxt]
            if mark:
                seen: dict[int, int | None] = {}
                for p in starting:
                    while p in nxt and p not in seen:
                        seen[p] = nxt[p]
                        p = nxt[p]
                return seen
            far: dict[int, int | None] = {}
            for head in starting:
                trail, p = [], head
                while p in nxt and p not in far:
                    trail.append(p)
                    p = nxt[p]
                end = far.get(p, p)
                for t in trail:
                    far[t] = end
            return {h: far[h] for h in starting}

        def run(t, first):
            import pyarrow as pa

            pos, nxt, entry = (t.column(k).to_pylist() for k in ("pos", "nxt", "_entry"))
            of, at, to = [], [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), t.num_rows]):
                got = walk(pos[a:b], nxt[a:b], entry[a:b])
                of += [a] * len(got)
                at += got.keys()
                to += got.values()
            cols = [t.column(k).take(pa.array(of, pa.int64())) for k in keys]
            return pa.table([*cols, pa.array(at, pa.int64()), pa.array(to, pa.int64())], names=[*keys, "pos", "nxt"])
        return run

    def grouped(at: DataFrame, mark: bool) -> DataFrame:
        both = edges.withColumn("_entry", F.lit(False)).unionByName(
            at.select(*keys, "pos").withColumn("nxt", F.lit(None).cast("long")).withColumn("_entry", F.lit(True)))
        both = both.withColumn("_b", F.floor(F.col("pos") / width))
        return by_runs(both, [*keys, "_b"], [], walker(mark), f"{kt}, pos long, nxt long")

    if not one_block:
        skips = grouped(entries, mark=False)
        entries = orbit(skips, starts, keys, width * FAN, extent)
    return grouped(entries, mark=True)


def top_k(df: DataFrame, keys: Sequence[str], order: Iterable[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each task's share to ``k`` before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key, as a map-side combined aggregate."""
    cols = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def next_at_or_after(points: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, name: str, width: int | None = None) -> DataFrame:
    """Points with the lowest target position (``targets.pos``) that is not below ``at``.

    Looked up inside the point's block first; otherwise the first later block with a target, from one row per block.
    """
    width = size_of(points, "block", width)
    keys = list(keys)
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    t = targets.select(*keys, "pos").distinct().withColumn("_b", F.floor(F.col("pos") / width))
    ats = p.select(*keys, "_b", F.col(at).alias("_at")).distinct()
    both = ats.withColumn("_t", F.lit(None).cast("long")).unionByName(t.select(*keys, "_b", F.col("pos").alias("_at"), F.col("pos").alias("_t")))
    after = W.partitionBy(*keys).orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    later = both.groupBy(*keys, "_b").agg(F.min("_t").alias("_m")).withColumn("_later", F.min("_m").over(after)).drop("_m")
    here = W.partitionBy(*keys, "_b").orderBy("_at").rangeBetween(0, W.unboundedFollowing)
    near = both.withColumn("_n", F.min("_t").over(here)).filter("_t is null").drop("_t")
    found = near.join(later, [*keys, "_b"]).select(*keys, F.col("_at").alias(at), F.coalesce("_n", "_later").alias(name)).distinct()
    return points.join(found, [*keys, at], "left")


def lag_sparse(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: Mapping[str, str], width: int | None = None) -> DataFrame:
    """``lag`` by one along sparse positions (``order[0]`` is an integer): inside blocks, and from the last row of the nearest earlier block."""
    keys = list(keys)
    d = id_blocks(df, order[0], width)
    last = d.groupBy(*keys, "_b").agg(F.max_by(F.struct(*[F.col(c).alias(o) for o, c in lags.items()]), F.struct(*order)).alias("_r"))
    prev = last.withColumn("_p", F.lag("_r").over(W.partitionBy(*keys).orderBy("_b"))).drop("_r")
    w = W.partitionBy(*keys, "_b").orderBy(*order)
    j = d.join(prev, [*keys, "_b"]).withColumn("_f", F.row_number().over(w))
    new = {o: F.when(F.col("_f") == 1, F.col(f"_p.{o}")).otherwise(F.lag(c).over(w)) for o, c in lags.items()}
    return j.withColumns(new).drop("_b", "_p", "_f")


def overlap_semi(left: DataFrame, right: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str], anti: bool = False,
                 width: int | None = None) -> DataFrame:
    """Left rows that meet (or, with ``anti``, do not meet) any interval of the right; both half-open.

    No pair is built.  A left interval meets one if, of those that start before its end, the furthest end is beyond its start.  That running maximum is
    taken inside blocks of the axis, in which each start and each end is one row whatever the number of intervals; a row per block carries it on.
    """
    width = size_of(left, "bucket", width)
    keys = list(keys)
    ends = left.select(*keys, F.col(l[1]).alias("_at")).distinct()
    starts = right.filter(F.col(r[0]) < F.col(r[1])).groupBy(*keys, F.col(r[0]).alias("_at")).agg(F.max(r[1]).alias("_to"))
    kind = starts.schema["_to"].dataType
    both = ends.withColumns({"_to": F.lit(None).cast(kind), "_q": F.lit(1)}).unionByName(starts.withColumn("_q", F.lit(2))).withColumn("_b", F.floor(F.col("_at") / width))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = both.groupBy(*keys, "_b").agg(F.max("_to").alias("_to")).withColumn("_to", F.max("_to").over(before)).filter("_to is not null")
    carry = carry.select(*keys, F.lit(None).cast(both.schema["_at"].dataType).alias("_at"), "_to", F.lit(0).alias("_q"), "_b")
    here = W.partitionBy(*keys, "_b").orderBy(F.asc_nulls_first("_at"), "_q").rowsBetween(W.unboundedPreceding, W.currentRow)
    far = both.unionByName(carry).withColumn("_far", F.max("_to").over(here)).filter("_q = 1").select(*keys, F.col("_at").alias(l[1]), "_far")
    out = left.join(far, [*keys, l[1]], "left")
    meets = F.coalesce((F.col("_far") > F.col(l[0])) & (F.col(l[0]) < F.col(l[1])), F.lit(False))
    return out.filter(~meets if anti else meets).select(*left.columns)
