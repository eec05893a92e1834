"""Best safe paths through the candidates of a region, and the searches built on them.

The score of a path is not additive, so the recurrence keeps one best path per node.  It runs in bounded slices of the
axis: a task holds one slice of a region plus the nodes of the last ``hi`` rows before it, however long the region; short regions share a call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from stripline.operators.blocks import best, by_runs, orbit, overlap_join, point_join, sessions, size_of, top_k
from stripline.operators.cuts import MAX_CHUNK, MIN_BAND, MIN_CHUNK, TARGET
from stripline.progress import cut_measured, cut_observed
from stripline.session import cut

CH = ["ch"]
STATE = ["prev", "edge", "shortfall", "deviation", "cmax", "cmin", "chunks", "quality", "lex"]
STATE_DDL = "prev long, edge long, shortfall long, deviation long, cmax long, cmin long, chunks long, quality double, lex long"


ZONE = "_zone"  # start of a region: with the keys it names the region, of which a chapter may have many


def zoned(regions: DataFrame) -> DataFrame:
    return regions.withColumn(ZONE, F.col("s"))


def into_zones(points: DataFrame, regions: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Points of the keys' regions, each with its region; regions of a key don't overlap."""
    z = regions.select(*keys, ZONE, F.col("s").alias("_zs"), F.col("e").alias("_ze"))
    return point_join(points, z, keys, at, ("_zs", "_ze")).drop("_zs", "_ze")


class Solver:
    """Best paths of one slice of every region of a table.

    An edge is at least ``lo`` rows long, so the nodes of a band of ``lo`` rows depend on earlier bands only: the bands of one number are solved together for
    all regions, as one list of nodes and predecessors.  ``nodes`` holds arrays y (ascending by region), role (0 start, 1 inner, 2 end), q, cs, ce, the state,
    ``given`` (nodes of the slice before, which bring their state) and ``first`` (those whose ``prev`` is missing); ``heads`` are the first nodes of the regions.
    Smaller is better: (edge, shortfall, deviation, imbalance, chunks, quality, path); with ``first_wins`` only the middle three count and a tie goes to the
    lowest predecessor.
    """

    CELLS = 1 << 20  # of a list of nodes and predecessors
    NARROW = 1 << 9  # cells of a band on average, below which nodes are solved one by one

    def __init__(self, nodes: dict, heads, *, target: int, lo: int, hi: int, prefer: int, small_edges: bool, first_wins: bool):
        import numpy as np

        self.np, self.target, self.lo, self.hi, self.prefer, self.small_edges, self.first_wins = np, target, lo, hi, prefer, small_edges, first_wins
        for k, v in nodes.items():
            setattr(self, k, v)
        n = len(self.y)
        sizes = np.diff(np.append(heads, n))
        self.region = np.repeat(np.arange(len(heads)), sizes)
        low, top = self.y[heads], self.y[heads + sizes - 1]
        off = np.cumsum(top - low + hi + 1) - (top - low + hi + 1)
        self.band_no = (self.y - np.repeat(low, sizes)) // max(1, lo)
        shift = np.repeat(off - low, sizes)
        self.x = self.y + shift  # one axis for all regions, of which no two are within reach
        self.prev = np.where(self.first, -1, self.prev)
        at = np.searchsorted(self.x, self.prev + shift)
        found = self.given & ~self.first & (at < n)
        found[found] = self.x[at[found]] == (self.prev + shift)[found]
        self.link = np.where(found, at, -1)
        self.reach = self.given | (self.role == 0)
        self.depth = np.zeros(n, np.int64)
        for i in np.flatnonzero(self.link >= 0):
            self.depth[i] = self.depth[self.link[i]] + 1

    def trail(self, i: int) -> list:
        """Order of the path to a node: the rank of its root, then its nodes."""
        back = []
        while self.link[i] >= 0:
            back.append(int(self.y[i]))
            i = self.link[i]
        return [int(self.lex[i]), int(self.y[i]), *back[::-1]]

    def less(self, a, b):
        """Whether the trails of nodes ``a`` come before those of ``b``: both are followed up to where they part."""
        np = self.np
        out = np.zeros(len(a), bool)
        other = self.depth[a] != self.depth[b]
        for k in np.flatnonzero(other):
            out[k] = self.trail(a[k]) < self.trail(b[k])
        at = np.flatnonzero(~other)
        a, b = a[at], b[at]
        while len(at):
            up, over = self.link[a], self.link[b]
            root = up < 0
            before = np.where(root & (self.lex[a] != self.lex[b]), self.lex[a] < self.lex[b], self.y[a] < self.y[b])
            done = root | (up == over)
            out[at[done]] = before[done]
            at, a, b = at[~done], up[~done], over[~done]
        return out

    def solve(self) -> None:
        np = self.np
        todo = np.flatnonzero(~self.reach)
        apart = self.role[todo] == 2 if self.small_edges else np.zeros(len(todo), bool)  # an end may follow nodes of its own band
        inner, ends = todo[~apart], todo[apart]
        of = self.region[ends]
        low, high, wide = self.window(todo)
        if wide.sum() < self.NARROW * (len(np.unique(self.band_no[inner])) + 1):
            for nodes in (inner, ends):
                self.singly(nodes)
            return
        for nodes, level in ((inner, self.band_no[inner]), (ends, np.arange(len(ends)) - np.searchsorted(of, of))):
            order = np.argsort(level, kind="stable")
            for part in np.split(nodes[order], np.flatnonzero(np.diff(level[order])) + 1):
                self.band(part)

    def window(self, nodes):
        """First predecessor of each node within reach, the end of those at least ``lo`` before it, and how many are looked at."""
        np, x = self.np, self.x
        low, high = np.searchsorted(x, x[nodes] - self.hi), np.minimum(np.searchsorted(x, x[nodes] - self.lo, side="right"), nodes)
        return low, high, np.maximum(0, (nodes if self.small_edges else high) - low)

    def singly(self, nodes) -> None:
        """Solve nodes one after the other, as plain numbers: with few nodes to a band, as in few long regions, calls on arrays cost far more than their cells."""
        np, target, lo, prefer, first_wins = self.np, self.target, self.lo, self.prefer, self.first_wins
        names = ["reach", "link", "prev", "depth", *FIELDS.values()]
        state = {k: getattr(self, k).tolist() for k in names}
        reach, link, prev, depth, edge, short, deviation, cmax, cmin, cnt, qual = state.values()
        x, y, role, cs, ce, lex = (getattr(self, k).tolist() for k in ("x", "y", "role", "cs", "ce", "lex"))
        quality = np.where(self.role == 1, self.q, 0.0).tolist()

        def trail(i: int) -> list:
            back = []
            while link[i] >= 0:
                back.append(y[i])
                i = link[i]
            return [lex[i], y[i], *back[::-1]]

        def less(a: int, b: int) -> bool:
            if depth[a] != depth[b]:
                return trail(a) < trail(b)
            while link[a] != link[b]:
                a, b = link[a], link[b]
            return (lex[a], y[a]) < (lex[b], y[b]) if link[a] < 0 else y[a] < y[b]

        low, high, wide = self.window(nodes)
        for i, a, h, b in zip(nodes.tolist(), low.tolist(), high.tolist(), (low + wide).tolist()):
            found, pick, end = None, -1, role[i] == 2
            for p in range(a, b):
                if not reach[p] or p >= h and not end and role[p] != 0:
                    continue
                step = x[i] - x[p]
                d = deviation[p] + abs(step - target)
                e = 0 if first_wins else edge[p] + (step < lo)
                f = short[p] + max(0, prefer - (cs[i] - ce[p])) if prefer and not first_wins else 0
                if found and (e, f, d) > found[:3]:
                    continue
                most, least = max(cmax[p], step), min(cmin[p], step) if cnt[p] else step
                score = (e, f, d, most - least, cnt[p] + 1, 0.0 if first_wins else qual[p] - quality[i])
                if found is None or score < found or score == found and not first_wins and less(p, pick):
                    found, pick, top, bottom = score, p, most, least
            if found:
                p, step = pick, x[i] - x[pick]
                link[i], prev[i], reach[i], depth[i], cmax[i], cmin[i] = p, y[p], True, depth[p] + 1, top, bottom
                edge[i], deviation[i], cnt[i], qual[i] = edge[p] + (step < lo), found[2], found[4], qual[p] - quality[i]
                short[i] = short[p] + (max(0, prefer - (cs[i] - ce[p])) if prefer else 0)
        for k, v in state.items():
            getattr(self, k)[:] = v

    def band(self, nodes) -> None:
        np = self.np
        low, high, wide = self.window(nodes)
        full = np.cumsum(wide)
        k = 0
        while k < len(nodes):
            stop = max(k + 1, int(np.searchsorted(full, full[k] - wide[k] + self.CELLS, side="right")))
            self.table(nodes[k:stop], low[k:stop], high[k:stop], wide[k:stop])
            k = stop

    def table(self, i, low, high, wide) -> None:
        np = self.np
        r = np.repeat(np.arange(len(i)), wide)
        p = np.arange(len(r)) + np.repeat(low - (np.cumsum(wide) - wide), wide)
        ok = self.reach[p]
        if self.small_edges:
            ok = ok & ((p < high[r]) | (self.role[p] == 0) | (self.role[i] == 2)[r])
        if not ok.all():
            r, p = r[ok], p[ok]
        if not len(r):
            return
        at = np.flatnonzero(np.diff(r, prepend=-1))
        i, r = i[r[at]], np.repeat(np.arange(len(at)), np.diff(np.append(at, len(r))))
        step = self.x[i][r] - self.x[p]
        some = lambda p: self.cnt[p] > 0
        cmin = lambda r, p, step: np.where(some(p), np.minimum(self.cmin[p], step), step)
        edge = lambda r, p, step: self.edge[p] + (step < self.lo)
        short = lambda r, p, step: self.short[p] + (np.maximum(0, self.prefer - (self.cs[i][r] - self.ce[p])) if self.prefer else 0)
        deviation = lambda r, p, step: self.deviation[p] + np.abs(step - self.target)
        imbalance = lambda r, p, step: np.maximum(self.cmax[p], step) - cmin(r, p, step)
        chunks = lambda r, p, step: self.cnt[p] + 1
        quality = lambda r, p, step: self.qual[p] - np.where(self.role[i] == 1, self.q[i], 0.0)[r]
        keys = [deviation, imbalance, chunks] if self.first_wins else [edge, short, deviation, imbalance, chunks, quality]
        if not self.first_wins:
            keys = keys[0 if self.small_edges else 1 if self.prefer else 2:]  # without small edges none is short, without a preference nothing falls short
            if self.small_edges and not self.prefer:
                keys.remove(short)
        for key in keys:
            if len(r) == len(i):
                break
            v = key(r, p, step)
            at = np.flatnonzero(np.diff(r, prepend=-1))
            left = v == np.repeat(np.minimum.reduceat(v, at), np.diff(np.append(at, len(r))))
            r, p, step = r[left], p[left], step[left]
        at = np.flatnonzero(np.diff(r, prepend=-1))
        pick = at.copy()
        if not self.first_wins:
            sizes = np.diff(np.append(at, len(r)))
            for k in range(1, int(sizes.max())):
                on = np.flatnonzero(sizes > k)
                better = self.less(p[at[on] + k], p[pick[on]])
                pick[on[better]] = at[on[better]] + k
        chosen = r[pick], p[pick], step[pick]
        values = [key(*chosen) for key in (edge, short, deviation, chunks, quality, cmin)]
        _, p, step = chosen
        self.link[i], self.prev[i], self.reach[i], self.depth[i] = p, self.y[p], True, self.depth[p] + 1
        self.edge[i], self.short[i], self.deviation[i], self.cnt[i], self.qual[i], self.cmin[i] = values
        self.cmax[i] = np.maximum(self.cmax[p], step)


NODES = 1 << 17  # of the blocks that make a slice


def slices_of(nodes: DataFrame, keys: Sequence[str], width: int, most: int) -> DataFrame:
    """Number ``_r`` of the slice that a key's block ``_k`` of ``width`` rows belongs to, and where the next one begins (``_to``); one row for each block.

    A block opens a new slice once those before it have filled the last one with ``most`` nodes.
    """
    along = W.partitionBy(*keys).orderBy("_k")
    per = nodes.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("_n"), F.min("s").alias("_s"))
    filled = F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_f", F.floor(filled / most)).withColumn("_r", F.dense_rank().over(W.partitionBy(*keys).orderBy("_f")).cast("long") - 1)
    first = per.groupBy(*keys, "_r").agg((F.min("_s") + F.min("_k") * width).alias("_at"))
    after = first.select(*keys, "_r", F.lead("_at").over(W.partitionBy(*keys).orderBy("_r")).alias("_to"))
    return per.select(*keys, "_k", "_r").join(after, [*keys, "_r"])


FIELDS = {"edge": "edge", "shortfall": "short", "deviation": "deviation", "cmax": "cmax", "cmin": "cmin", "chunks": "cnt", "quality": "qual"}


def kernel(t, heads, **rules):
    """Rows of a table of slices (sorted by region and y, ``heads`` their first rows) that were solved, and of those within ``hi`` before ``_to`` that the
    next slice needs, ``carried`` if they were given; and the columns of these rows.  Only nodes that the next slice needs have a rank ``lex``."""
    import numpy as np
    import pyarrow as pa

    col = lambda k, of=0: t.column(k).fill_null(of).to_numpy()
    nodes = {k: col(k) for k in ("y", "role", "q", "cs", "ce", "prev", "lex")} | {v: col(k).copy() for k, v in FIELDS.items()}
    nodes |= {"given": ~np.asarray(t.column("chunks").is_null()), "first": np.asarray(t.column("prev").is_null())}
    s = Solver(nodes, heads, **rules)
    s.solve()
    never = np.iinfo(np.int64).max
    near = np.asarray(t.column("_to").is_valid())
    to = np.minimum.reduceat(np.where(near, col("_to"), never), heads)[s.region]  # the nodes of a slice share it, given ones have none
    front = sorted(np.flatnonzero(s.reach & (to < never) & (s.y >= to - s.hi)).tolist(), key=s.trail)
    rank = np.full(len(s.y), -1)
    rank[front] = np.arange(len(front))
    rows = np.concatenate([np.flatnonzero(s.reach & ~s.given), np.array([i for i in front if s.given[i]], np.int64)])
    null = lambda v: pa.array(v[rows], mask=v[rows] < 0)
    return rows, {"y": s.y[rows], "role": s.role[rows], "q": s.q[rows], "cs": s.cs[rows], "ce": s.ce[rows], "prev": null(s.prev),
                  **{k: getattr(s, v)[rows] for k, v in FIELDS.items()}, "lex": null(rank), "carried": s.given[rows]}


def best_paths(nodes: DataFrame, keys: Sequence[str] = CH, *, target: int = TARGET, lo: int = MIN_CHUNK, hi: int = MAX_CHUNK, prefer: int = 0,
               small_edges: bool = False, first_wins: bool = False, width: int | None = None) -> DataFrame:
    """State of every reachable node.  ``nodes``: keys, ``s`` (region start), ``y``, ``role``, ``q``, ``cs``, ``ce``.

    The regions are solved slice by slice, one round each.  A slice is cut at blocks of the axis, of which it takes as many as hold ``NODES`` nodes together, so
    rounds follow the nodes of the longest region and not its length: one for most data.  With ``width``, or the setting ``slice``, it is that many rows.
    """
    keys = list(keys)
    fixed = width or nodes.sparkSession.conf.get("spark.stripline.slice", None)
    width = size_of(nodes, "slice", width)
    base = nodes.select(*keys, "s", "y", F.col("role").cast("long"), F.col("q").cast("double"), F.col("cs").cast("long"), F.col("ce").cast("long"))
    base, found = cut_measured(base.withColumn("_k", F.floor((F.col("y") - F.col("s")) / width)), "best_paths", last=F.max("_k"))
    rounds = 0
    if found["last"]:
        base, found = cut_measured(base.join(slices_of(base, keys, width, 1 if fixed else NODES), [*keys, "_k"]), "best_paths", last=F.max("_r"))
        rounds = found["last"] or 0
    else:
        base = base.withColumns({"_r": F.lit(0), "_to": F.lit(None).cast("long")})
    kt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keys)
    ddl = f"{kt}, s long, y long, role long, q double, cs long, ce long, {STATE_DDL}, carried boolean"

    def run(t, first):
        import pyarrow as pa

        rows, res = kernel(t, first, target=target, lo=lo, hi=hi, prefer=prefer, small_edges=small_edges, first_wins=first_wins)
        head = [t.column(k).take(pa.array(rows)) for k in [*keys, "s"]]
        return pa.table([*head, *[v if isinstance(v, pa.Array) else pa.array(v) for v in res.values()]], names=[*keys, "s", *res])

    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in STATE_DDL.split(", ")}
    parts, front = [], None
    for r in range(rounds + 1):
        cur = base.filter(F.col("_r") == r).drop("_r", "_k").withColumns(empty)
        if front is not None:
            cur = cur.unionByName(front.withColumn("_to", F.lit(None).cast("long")))
        solved = by_runs(cur, keys, ["y"], run, ddl)
        done = cut_observed(solved, "best_paths", nodes=F.count_if(~F.col("carried")), ends=F.count_if((F.col("role") == 2) & ~F.col("carried")), round=F.max(F.lit(r)))
        parts.append(done.filter("not carried").drop("carried"))
        front = done.filter("lex is not null").drop("carried")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def path_to(states: DataFrame, ends: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Chunks of the best paths that end at ``ends(keys, y)``."""
    keys = list(keys)
    e = states.select(*keys, F.col("y").alias("pos"), F.col("prev").alias("nxt"))
    got = orbit(e, ends.select(*keys, F.col("y").alias("pos")), keys).filter("nxt is not null")
    return got.select(*keys, F.col("nxt").alias("start"), F.col("pos").alias("end"), (F.col("pos") - F.col("nxt")).alias("height"))


def dedupe_close(bands: DataFrame, near: int = 8, keys: Sequence[str] = CH) -> DataFrame:
    """Bands within ``near`` rows of the last kept one count once: the taller stays, the white one on a tie.

    Bands further apart than ``near`` never meet, so every group of close bands is folded on its own.  Bands of a kind do
    not overlap and are at least 150 rows high, which bounds the group.
    """
    keys = list(keys)
    g = sessions(bands, keys, "center", near).select(*keys, "start", (F.col("last") + 1).alias("stop"))
    cols = [c for c in bands.columns if c not in keys]
    j = point_join(bands, g, keys, "center", ("start", "stop"))
    item = F.struct("center", (-F.col("height")).alias("_nh"), "kind", F.struct(*cols).alias("row"))
    groups = j.groupBy(*keys, "start").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(groups.dtypes)["items"]

    def fold(acc, x):
        last = F.element_at(acc, -1)
        better = F.struct(-x["_nh"], x["kind"] == "white_band") > F.struct(-last["_nh"], last["kind"] == "white_band")
        swapped = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
        close = (F.size(acc) > 0) & (x["center"] - last["center"] <= near)
        return F.when(~close, F.concat(acc, F.array(x))).when(better, swapped).otherwise(acc)

    first = F.slice("items", 1, 1)
    kept = F.when(F.size("items") == 1, F.col("items")).otherwise(F.aggregate(F.slice("items", 2, 1 << 30), first.cast(kind), fold))
    return groups.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.row.*")


def with_source_counts(nodes: DataFrame, pages: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Pages that start before and end at or before every node: their difference counts the pages of a chunk."""
    keys = list(keys)
    p = pages.filter("ge > gs").select(*keys, "page_no", "gs", (F.col("ge") + 1).alias("_stop"), "ge")
    j = point_join(nodes, p, keys, "y", ("gs", "_stop"))
    inner = F.col("y") < F.col("ge")
    j = j.withColumns({"_s": F.when(F.col("y") > F.col("gs"), F.col("page_no")).otherwise(F.col("page_no") - 1),
                       "_e": F.when(inner, F.col("page_no") - 1).otherwise(F.col("page_no"))})
    cols = [c for c in nodes.columns]
    return j.groupBy(*cols).agg(F.max("_s").alias("cs"), F.max("_e").alias("ce"))


def balanced_nodes(regions: DataFrame, bands: DataFrame, pages: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Nodes of the balanced search: region ends and the deduplicated eligible bands strictly inside."""
    keys = list(keys)
    r = regions.filter(F.col("e") - F.col("s") > MAX_CHUNK).select(*keys, "s", "e")
    inside = point_join(bands.filter(F.col("height") >= MIN_BAND), r, keys, "center", ("s", "e")).filter("center > s")
    d = dedupe_close(inside, keys=keys)
    q = F.col("height") + F.when(F.col("kind") == "white_band", F.coalesce("ratio", F.lit(0.0))).otherwise(-F.coalesce("std", F.lit(0.0)))
    inner = d.select(*keys, "s", F.col("center").alias("y"), F.lit(1).alias("role"), q.alias("q"))
    ends = r.select(*keys, "s", F.explode(F.array(F.struct(F.col("s").alias("y"), F.lit(0).alias("role")), F.struct(F.col("e").alias("y"), F.lit(2).alias("role")))).alias("n"))
    return with_source_counts(inner.unionByName(ends.select(*keys, "s", "n.y", "n.role", F.lit(0.0).alias("q"))), pages, keys)


def balanced_path(regions: DataFrame, bands: DataFrame, pages: DataFrame, prefer: int = 4, keys: Sequence[str] = CH, width: int | None = None) -> DataFrame:
    """Chunks of the best safe composition of every region.

    A strict path to the end, else one with a small chunk at an edge, else the best strict prefix with a residual, else
    the whole region as residual.  Columns: keys, ``start``, ``end``, ``height``, ``status``, ``strategy``, ``part``.
    """
    regions = zoned(regions)
    bands = into_zones(bands, regions, list(keys), "center")
    touched = regions.select(*keys, ZONE, F.col("s").alias("_zs"), (F.col("e") + 1).alias("_ze"))
    pages = overlap_join(pages.filter("ge > gs").withColumn("_stop", F.col("ge") + 1), touched, list(keys), ("gs", "_stop"), ("_zs", "_ze")).drop("_stop", "_zs", "_ze")
    keys = [*keys, ZONE]
    nodes = cut_observed(balanced_nodes(regions, bands, pages, keys), "balanced_path", positions=F.count_if(F.col("role") == 1))
    end = nodes.filter("role = 2").select(*keys, "y")
    small = regions.filter(F.col("e") - F.col("s") <= MAX_CHUNK).select(
        *keys, F.col("s").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("s")).alias("height"),
        F.lit("resolved").alias("status"), F.lit("already_within_max_height").alias("strategy"), F.lit("chunk").alias("part"))
    strict = best_paths(nodes, keys, prefer=prefer, width=width)
    hit = strict.filter("role = 2").select(*keys, "y")
    loose_nodes = nodes.join(hit.select(*keys), keys, "left_anti")
    loose = best_paths(loose_nodes, keys, prefer=prefer, small_edges=True, width=width)
    hit2 = loose.filter("role = 2").select(*keys, "y")
    open_ = end.join(hit.unionByName(hit2).select(*keys), keys, "left_anti").withColumnRenamed("y", "e")
    reachable = strict.filter("role = 1").join(open_, keys).filter(F.col("e") - F.col("y") >= MIN_CHUNK)
    prefix = best(reachable.select(*keys, "e", "y", "shortfall", "deviation", (F.col("cmax") - F.col("cmin")).alias("imb")), keys,
                  [F.col("shortfall"), F.col("deviation"), F.col("imb"), -F.col("y")])
    prefix = cut(prefix)

    def tag(df, status, strategy, part="chunk"):
        return df.withColumns({"status": F.lit(status), "strategy": F.lit(strategy), "part": F.lit(part)})

    rest = prefix.select(*keys, F.col("y").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("y")).alias("height"))
    none = open_.join(prefix.select(*keys), keys, "left_anti").join(regions.select(*keys, "s"), keys).select(
        *keys, F.col("s").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("s")).alias("height"))
    whole = hit.withColumns({"status": F.lit("resolved"), "strategy": F.lit("bounded_safe_balanced_path")})
    part = prefix.select(*keys, "y").withColumns({"status": F.lit("partial"), "strategy": F.lit("bounded_safe_balanced_prefix")})
    label = cut(whole.unionByName(part))  # one walk for both: a region has either a full path or a prefix
    walked = path_to(strict, label.select(*keys, "y"), keys).join(label.drop("y"), keys).withColumn("part", F.lit("chunk"))
    return (small.unionByName(walked)
            .unionByName(tag(path_to(loose, hit2, keys), "resolved", "bounded_safe_balanced_path_with_edge_chunk"))
            .unionByName(tag(rest, "partial", "bounded_safe_balanced_prefix", "residual"))
            .unionByName(tag(none, "unresolved", "no_reachable_safe_path", "residual"))).drop(ZONE)


def safe_nodes(regions: DataFrame, safe: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Nodes of the complete-path search: region ends and the SAFE positions strictly inside."""
    keys = list(keys)
    r = regions.select(*keys, "s", "e")
    inner = point_join(safe.select(*keys, "y").distinct(), r, keys, "y", ("s", "e")).filter("y > s").select(*keys, "s", "y", F.lit(1).alias("role"))
    ends = r.select(*keys, "s", F.explode(F.array(F.struct(F.col("s").alias("y"), F.lit(0).alias("role")), F.struct(F.col("e").alias("y"), F.lit(2).alias("role")))).alias("n"))
    z = {"q": F.lit(0.0), "cs": F.lit(0), "ce": F.lit(0)}
    return inner.unionByName(ends.select(*keys, "s", "n.y", "n.role")).withColumns(z)


def complete_path(regions: DataFrame, safe: DataFrame, keys: Sequence[str] = CH, width: int | None = None) -> DataFrame:
    """Chunks of the best complete path of every region that has one.  Regions within the maximum are one chunk."""
    regions = zoned(regions)
    return _complete_path(regions, into_zones(safe, regions, list(keys), "y"), [*keys, ZONE], width).drop(ZONE)


def _complete_path(regions: DataFrame, safe: DataFrame, keys: Sequence[str], width: int | None) -> DataFrame:
    keys = list(keys)
    small = regions.filter(F.col("e") - F.col("s") <= MAX_CHUNK).select(*keys, F.col("s").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("s")).alias("height"))
    big = regions.filter(F.col("e") - F.col("s") > MAX_CHUNK)
    st = best_paths(safe_nodes(big, safe, keys), keys, width=width)
    return small.unionByName(path_to(st, st.filter("role = 2").select(*keys, "y"), keys))


def exhaustive_composition(regions: DataFrame, safe: DataFrame, step: int = 1, keys: Sequence[str] = CH, width: int | None = None) -> DataFrame:
    """Complete path from the even positions, else from all; else the furthest SAFE prefix and its residual.

    Columns: keys, ``start``, ``end``, ``height``, ``passes``, ``part``.
    """
    regions = zoned(regions)
    safe = cut_observed(into_zones(safe.select(*keys, "y"), regions, list(keys), "y"), "exhaustive_composition", positions=F.count(F.lit(1)))
    keys = [*keys, ZONE]
    even = cut(_complete_path(regions, safe.filter((F.floor(F.col("y") / step) % 2) == 0), keys, width))

    def tag(df, passes, part):
        return df.withColumns({"passes": F.lit(passes), "part": F.lit(part)})

    left, n = cut_measured(regions.join(even.select(*keys).distinct(), keys, "left_anti"), "exhaustive_left")
    if not n["rows"]:
        return tag(even, 1, "chunk").drop(ZONE)
    full = cut(_complete_path(left, safe, keys, width))
    hard, n = cut_measured(left.join(full.select(*keys).distinct(), keys, "left_anti"), "exhaustive_hard")
    if not n["rows"]:
        return tag(even, 1, "chunk").unionByName(tag(full, 2, "chunk")).drop(ZONE)
    st = best_paths(safe_nodes(hard, safe, keys).filter("role <> 2"), keys, first_wins=True, width=width)
    far = cut(st.filter("role = 1").groupBy(*keys).agg(F.max("y").alias("y")))
    rest = hard.join(far, keys, "left").select(*keys, F.coalesce("y", "s").alias("start"), F.col("e").alias("end"))
    rest = rest.withColumn("height", F.col("end") - F.col("start"))
    return (tag(even, 1, "chunk").unionByName(tag(full, 2, "chunk"))
            .unionByName(tag(path_to(st, far, keys), 2, "prefix")).unionByName(tag(rest, 2, "residual"))).drop(ZONE)


def beam_balance(regions: DataFrame, zones: DataFrame, count: int, beam: int = 400, keys: Sequence[str] = CH, width: int = 1 << 16) -> DataFrame:
    """Cuts of the most balanced composition into ``count`` chunks over zone representatives, by a beam search.

    Each of the ``count - 1`` rounds extends at most ``beam`` paths per region.  Representatives are spread over axis
    slices; a slice returns its own best ``beam`` extensions, so no task sees a whole region.  Slices of small regions share a call.
    """
    regions = zoned(regions)
    zones = into_zones(zones, regions, list(keys), "y")
    keys = [*keys, ZONE]
    r = regions.select(*keys, "s", "e").withColumns({"target": (F.col("e") - F.col("s")) / F.lit(float(count))})
    z = point_join(zones.select(*keys, "y", "edge_density", "crossing_components"), r, keys, "y", ("s", "e")).filter("y > s")
    z = cut(z.withColumn("_k", F.floor(F.col("y") / width)))
    slices = z.select(*keys, "_k").distinct()
    enough = z.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= count - 1)
    paths = r.join(enough.select(*keys), keys, "left_semi").select(*keys, F.lit(0.0).alias("score"), F.array(F.col("s").cast("long")).alias("path"))
    kt = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.schema.fields if f.name in keys)
    cells = Solver.CELLS
    blank = {c: F.lit(None).cast(t) for c, t in (("score", "double"), ("path", "array<bigint>"))}

    def extend(ordinal: int):
        def run(t, first):
            import numpy as np
            import pyarrow as pa

            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)))
            is_zone = np.asarray(t.column("y").is_valid())
            zone, path = np.flatnonzero(is_zone), np.flatnonzero(~is_zone)
            col = lambda k, at: t.column(k).take(pa.array(at)).to_numpy()
            y, s, target = (col(k, zone) for k in ("y", "s", "target"))
            structural = col("edge_density", zone) * 1e-3 + col("crossing_components", zone) * 1e-6
            place = np.abs(y - (s + target * ordinal)) / np.maximum(1.0, target)
            score = col("score", path)
            cuts = np.asarray(t.column("path").take(pa.array(path)).combine_chunks().flatten()).reshape(len(path), ordinal)
            low, high = (np.searchsorted(group[zone], group[path], side=k) for k in ("left", "right"))
            full = np.cumsum(high - low)
            got = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # path, zone and score of the extensions: at most ``beam`` of a group

            def kept(p, z, v):
                of = group[path[p]]
                order = np.lexsort((y[z], *cuts[p].T[::-1], v, of))
                of = of[order]
                order = order[np.arange(len(of)) - np.searchsorted(of, of) < beam]
                return p[order], z[order], v[order]

            k = 0
            while k < len(path):
                stop = max(k + 1, int(np.searchsorted(full, full[k] - (high - low)[k] + cells, side="right")))
                wide = (high - low)[k:stop]
                p = np.repeat(np.arange(k, stop), wide)
                z = np.arange(len(p)) + np.repeat(low[k:stop] - (np.cumsum(wide) - wide), wide)
                h = y[z] - cuts[p, -1]
                ok = (h > 0) & (h >= target[z] * 0.50)
                p, z, h = p[ok], z[ok], h[ok]
                d = (h - target[z]) / np.maximum(1.0, target[z])
                v = score[p] + d * d + place[z] * place[z] * 0.10 + structural[z]
                near = np.ones(len(v), bool)
                at = np.flatnonzero(np.diff(group[path[p]], prepend=-1))
                for a, b in zip(at, np.append(at, len(p))[1:]):
                    if b - a > 8 * beam:  # a long part is thinned before it is sorted; ties stay
                        near[a:b] = ~(v[a:b] > np.partition(v[a:b], beam - 1)[beam - 1])
                got = kept(*(np.concatenate(both) for both in zip(got, (p[near], z[near], v[near]))))
                k = stop
            p, z, v = got
            paths = np.concatenate([cuts[p], y[z][:, None]], axis=1)
            paths = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * (ordinal + 1)), pa.array(paths.ravel(), pa.int64()))
            return pa.table([*[t.column(c).take(pa.array(path[p])) for c in keys], pa.array(v), paths], names=[*keys, "score", "path"])
        return run

    wanted = [*keys, "_k", "y", "edge_density", "crossing_components", "s", "target"]
    for ordinal in range(1, count):
        both = z.select(*wanted).withColumns(blank).unionByName(paths.join(slices, keys), allowMissingColumns=True)
        ext = by_runs(both, [*keys, "_k"], ["y"], extend(ordinal), f"{kt}, score double, path array<bigint>")
        paths = cut_observed(top_k(ext, keys, [F.col("score"), F.col("path")], beam, "_rank").drop("_rank"), "beam_balance", cut=F.max(F.lit(ordinal)))
    full = paths.join(r, keys).withColumn("bounds", F.array_append(F.col("path"), F.col("e")))
    full = full.withColumn("heights", F.transform(F.slice("bounds", 2, count), lambda b, i: b - F.element_at(F.col("bounds"), i + 1)))
    full = full.filter(F.array_min("heights") >= F.col("target") * 0.50)
    mean = F.aggregate("heights", F.lit(0).cast("long"), lambda a, h: a + h) / float(count)
    full = full.withColumn("_m", mean)
    var = F.aggregate("heights", F.lit(0.0), lambda a, h: a + (h - F.col("_m")) * (h - F.col("_m"))) / float(count)
    final = F.col("score") + var / F.greatest(F.lit(1.0), F.col("_m") * F.col("_m"))
    return best(full.select(*keys, "bounds", final.alias("score")), keys, [F.col("score"), F.col("bounds")]).drop(ZONE)
