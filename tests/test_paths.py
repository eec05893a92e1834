"""Path searches against an independent recurrence and the known cases."""

import random

import pytest
from pyspark.sql import functions as F

from stripline.operators import evidence as E
from stripline.operators import paths as P
from stripline.progress import on_progress

BAND = "ch string, kind string, center long, height long, ratio double, std double"


def region(spark, ch, s, e):
    return spark.createDataFrame([(ch, s, e)], "ch string, s long, e long")


def pages(spark, ch, s, e, step=2000):
    rows = [(ch, f"p{i}", i + 1, a, min(a + step, e)) for i, a in enumerate(range(0, e, step))]
    return spark.createDataFrame(rows, "ch string, file string, page_no long, gs long, ge long")


CASES = {  # region, white (centre, height), uniform (centre, height), expected bounds, status, preferred sources
    "two_cuts": ((0, 16731), [(4396, 200), (12500, 200)], [], [0, 4396, 12500, 16731], "resolved", 0),
    "too_short": ((0, 16731), [(5000, 149)], [], [0, 16731], "unresolved", 0),
    "prefix": ((0, 25000), [(5000, 200)], [], [0, 5000, 25000], "partial", 0),
    "nothing": ((0, 16731), [], [], [0, 16731], "unresolved", 0),
    "start_edge": ((42252, 55042), [(43827, 427)], [], [42252, 43827, 55042], "resolved", 0),
    "end_edge": ((0, 12790), [(11215, 427)], [], [0, 11215, 12790], "resolved", 0),
    "uniform": ((42252, 55042), [(43827, 427)], [(48647, 900)], [42252, 48647, 55042], "resolved", 0),
    "sources": ((0, 14000), [], [(4000, 300), (6400, 300)], [0, 6400, 14000], "resolved", 4),
}


def test_known_balanced_cases(spark):
    for prefer in (0, 4):
        cases = {k: v for k, v in CASES.items() if v[5] == prefer}
        regs = spark.createDataFrame([(k, *v[0]) for k, v in cases.items()], "ch string, s long, e long")
        rows = [(k, "white_band", c, h, 1.0, None) for k, v in cases.items() for c, h in v[1]]
        rows += [(k, "uniform_color_band", c, h, None, 1.0) for k, v in cases.items() for c, h in v[2]]
        pg = None
        for k, v in cases.items():
            one = pages(spark, k, *v[0])
            pg = one if pg is None else pg.unionByName(one)
        got = P.balanced_path(regs, spark.createDataFrame(rows, BAND), pg, prefer=prefer).collect()
        for k, v in cases.items():
            mine = sorted((r.start, r.end) for r in got if r.ch == k)
            assert [mine[0][0], *[e for _, e in mine]] == v[3], k
            assert {r.status for r in got if r.ch == k} == {v[4]}, k


def recurrence(start, end, safe, lo, hi, target, tie_path=True, use_end=True):
    """One best path per node, straight from the definition."""
    nodes = sorted({y for y in safe if start < y < end}) + ([end] if use_end else [])
    best = {start: [start]}

    def score(b):
        c = [q - p for p, q in zip(b, b[1:])]
        return (sum(abs(h - target) for h in c), max(c) - min(c), len(c))

    for y in nodes:
        options = [best[x] + [y] for x in sorted(best) if lo <= y - x <= hi]
        if options:
            best[y] = min(options, key=lambda b: (score(b), b)) if tie_path else min(options, key=score)
    return best


@pytest.mark.parametrize("width", [1 << 20, 16000])
def test_complete_path_matches_the_recurrence(spark, width):
    rnd = random.Random(7)
    regs, safe, want = [], [], {}
    for i in range(12):
        s, e = rnd.randrange(0, 5000), rnd.randrange(30000, 90000)
        ys = sorted(rnd.sample(range(s + 1, e, 500 if i % 2 else 7), 25 + i))
        regs.append((f"c{i}", s, e))
        safe += [(f"c{i}", y) for y in ys]
        best = recurrence(s, e, ys, 3000, 12000, 7000)
        want[f"c{i}"] = best.get(e)
    r = spark.createDataFrame(regs, "ch string, s long, e long")
    got = P.complete_path(r, spark.createDataFrame(safe, "ch string, y long"), width=width).collect()
    for ch, s, _ in regs:
        ends = sorted(x.end for x in got if x.ch == ch)
        assert ([s, *ends] if ends else None) == want[ch], ch


def test_exhaustive_prefix(spark):
    r = region(spark, "a", 0, 40000)
    safe = spark.createDataFrame([("a", y) for y in (4001, 5001, 9001, 9003, 15001)], "ch string, y long")
    got = P.exhaustive_composition(r, safe).collect()
    want = recurrence(0, 40000, [4001, 5001, 9001, 9003, 15001], 3000, 12000, 7000, tie_path=False, use_end=False)[15001]
    chunk = sorted((x.start, x.end) for x in got if x.part == "prefix")
    assert chunk == list(zip(want, want[1:]))
    assert [(x.start, x.end) for x in got if x.part == "residual"] == [(15001, 40000)]


def test_dedupe_keeps_the_taller_then_the_white(spark):
    rows = [("a", "white_band", 100, 200), ("a", "uniform_color_band", 106, 200), ("a", "uniform_color_band", 112, 300), ("a", "white_band", 500, 150)]
    b = spark.createDataFrame(rows, "ch string, kind string, center long, height long")
    got = sorted((r.center, r.kind) for r in P.dedupe_close(b).collect())
    # 106 loses to the white band at 100; 112 is then 12 rows from the last kept band
    assert got == [(100, "white_band"), (112, "uniform_color_band"), (500, "white_band")]


def test_beam_matches_a_full_beam(spark):
    rnd = random.Random(3)
    ys = sorted(rnd.sample(range(500, 29500), 30))
    ed = {y: rnd.random() / 100 for y in ys}
    zones = spark.createDataFrame([("a", y, ed[y], 0) for y in ys], "ch string, y long, edge_density double, crossing_components long")
    got = P.beam_balance(region(spark, "a", 0, 30000), zones, 4, width=7000).first()
    t, beam = 7500.0, [(0.0, [0])]
    for o in (1, 2, 3):
        beam = sorted((sc + ((y - p[-1] - t) / t) ** 2 + (abs(y - t * o) / t) ** 2 * 0.1 + ed[y] * 1e-3, [*p, y])
                      for sc, p in beam for y in ys if y - p[-1] >= t / 2)[:400]
    fin = []
    for sc, p in beam:
        h = [b - a for a, b in zip(p + [30000], (p + [30000])[1:])]
        if min(h) >= t / 2:
            fin.append((sc + sum((x - t) ** 2 for x in h) / 4 / (t * t), p + [30000]))
    assert got.bounds == min(fin)[1]


def test_reach_is_walked_over_many_blocks(spark):
    from stripline.operators.blocks import orbit

    rnd = random.Random(1)
    nxt = {p: p + rnd.randrange(1, 9) for p in range(5000)}
    e = spark.createDataFrame([("a", p, q if q < 5000 else None) for p, q in nxt.items()], "ch string, pos long, nxt long")
    s = spark.createDataFrame([("a", 0)], "ch string, pos long")
    want, p = [], 0
    while p is not None and p < 5000:
        want.append(p)
        p = nxt[p]
    got = sorted(r.pos for r in orbit(e, s, ["ch"], width=3).collect())
    assert got == want
    assert sorted(r.pos for r in orbit(e, s, ["ch"]).select(F.col("pos")).collect()) == want


def several(spark, *bounds):
    return spark.createDataFrame([("a", s, e) for s, e in bounds], "ch string, s long, e long")


def safe_rows(spark, *at):
    return spark.createDataFrame([("a", y) for y in at], "ch string, y long")


def test_regions_of_one_chapter_do_not_mix(spark):
    two = several(spark, (0, 20000), (60000, 80000))
    rows = lambda df, *c: sorted(tuple(r[k] for k in c) for r in df.collect())
    got = rows(P.exhaustive_composition(two, safe_rows(spark, 10000)), "start", "end", "part")
    assert got == [(0, 10000, "chunk"), (10000, 20000, "chunk"), (60000, 80000, "residual")]
    bands = spark.createDataFrame([("a", "white_band", 10000, 200, 1.0, None)], BAND)
    got = rows(P.balanced_path(two, bands, pages(spark, "a", 0, 80000), prefer=0), "start", "end", "status")
    assert got == [(0, 10000, "resolved"), (10000, 20000, "resolved"), (60000, 80000, "unresolved")]
    apart = several(spark, (0, 20000), (25000, 38000))
    assert rows(P.complete_path(apart, safe_rows(spark, 10000, 27000)), "start", "end") == [(0, 10000), (10000, 20000)]
    zones = safe_rows(spark, 4000, 5000, 31000, 33000).withColumns({"edge_density": F.lit(0.0), "crossing_components": F.lit(0)})
    assert rows(P.beam_balance(several(spark, (0, 10000), (28000, 38000)), zones, 2), "bounds") == [([0, 5000, 10000],), ([28000, 33000, 38000],)]


def evidence(spark, *at):
    return spark.createDataFrame([("a", y, d, "r", 0.0, 0) for y, d in at], "ch string, y long, decision string, reason string, edge_density double, crossing_components long")


def test_residual_walk_by_region_and_without_evidence(spark):
    from stripline.operators.evidence import residual_walk

    d = evidence(spark, (12000, "SAFE"), (72000, "UNSAFE"))
    ok, rest = residual_walk(d, several(spark, (0, 20000), (60000, 80000)))
    assert sorted((r.start, r.end) for r in ok.collect()) == [(0, 12000), (12000, 20000)]
    assert [(r.start, r.end) for r in rest.collect()] == [(60000, 80000)]
    ok, rest = residual_walk(evidence(spark, (5000, "SAFE")), several(spark, (0, 30000)))
    assert ok.count() == 0 and [(r.start, r.end, r.reason) for r in rest.collect()] == [(0, 30000, "no_evidence")]


def plain_paths(nodes, target, lo, hi, prefer, small_edges, first_wins):
    """Best path of every node, one node after the other, from full lists of its predecessors' paths."""
    best = {}
    for y, role, q, cs, ce in sorted(nodes):
        if role == 0:
            best[y] = ((0, 0, 0, None, None, 0, 0.0), (y,), None)
            continue
        found = []
        for p, prole, _, _, pce in nodes:
            d = y - p
            if p not in best or not 0 < d <= hi:
                continue
            if d < lo and not (small_edges and (role == 2 or prole == 0)):
                continue
            edge, short, dev, top, low, n, qual = best[p][0]
            top, low = max(top or 0, d), min(low, d) if low is not None else d
            score = (edge + (d < lo), short + (max(0, prefer - (cs - pce)) if prefer else 0), dev + abs(d - target), top, low, n + 1, qual - (q if role == 1 else 0.0))
            key = (score[0], score[1], score[2], top - low, n + 1, score[6], best[p][1]) if not first_wins else (score[2], top - low, n + 1, p)
            found.append((key, score, best[p][1] + (y,), p))
        if found:
            best[y] = min(found, key=lambda f: f[0])[1:]
    return {y: (b[2], *b[0][:3], b[0][5]) for y, b in best.items()}


@pytest.mark.parametrize("rules", [dict(prefer=0), dict(prefer=4), dict(prefer=0, small_edges=True), dict(prefer=3, small_edges=True), dict(prefer=0, first_wins=True)])
def test_bands_solve_the_recurrence(spark, rules):
    rnd = random.Random(17)
    rules = {"target": 7, "lo": 3, "hi": 12, "prefer": 0, "small_edges": False, "first_wins": False} | rules
    cases = {}
    for k in range(25):
        end = rnd.choice([5, 12, 40, 150])
        inner = sorted(rnd.sample(range(1, end), min(end - 1, rnd.choice([0, 3, 30, 120]))))
        row = lambda y, role: (y, role, rnd.choice([0.0, 0.0, 1.5, 2.0]), y // 2, y // 2 + rnd.randrange(2))
        cases[f"c{k:02d}"] = [row(0, 0), *[row(y, 1) for y in inner], row(end, 2)]
    df = spark.createDataFrame([(k, 0, *n) for k, ns in cases.items() for n in ns], "ch string, s long, y long, role int, q double, cs long, ce long")
    want = {(k, y): v for k, ns in cases.items() for y, v in plain_paths(ns, **rules).items()}
    for width in (1 << 20, 16, 29):
        got = {(r.ch, r.y): (r.prev, r.edge, r.shortfall, r.deviation, r.chunks) for r in P.best_paths(df, **rules, width=width).collect()}
        assert got == want
    assert P.Solver.CELLS > 1


def solver_of(cases, rules):
    """A solver of regions of (y, role, q, cs, ce), without Spark."""
    import numpy as np

    rows = [n for ns in cases for n in ns]
    sizes = [len(ns) for ns in cases]
    nodes = {k: np.array([r[j] for r in rows]) for j, k in enumerate(("y", "role", "q", "cs", "ce"))}
    nodes |= {k: np.zeros(len(rows), np.int64) for k in ("prev", "lex", *P.FIELDS.values())}
    nodes |= {"qual": np.zeros(len(rows)), "given": np.zeros(len(rows), bool), "first": np.ones(len(rows), bool)}
    return P.Solver(nodes, np.cumsum(sizes) - sizes, **rules), nodes


@pytest.mark.parametrize("rules", [dict(prefer=0), dict(prefer=4), dict(prefer=0, small_edges=True), dict(prefer=3, small_edges=True), dict(prefer=0, first_wins=True)])
def test_narrow_and_wide_bands_give_the_same_paths(rules):
    import numpy as np

    rnd = random.Random(23)
    rules = {"target": 7, "lo": 3, "hi": 12, "prefer": 0, "small_edges": False, "first_wins": False} | rules
    cases = []
    for k in range(30):
        end = rnd.choice([5, 12, 40, 150, 150, 150])
        inner = sorted(rnd.sample(range(1, end), min(end - 1, rnd.choice([0, 3, 30, 120]))))
        row = lambda y, role: (y, role, rnd.choice([0.0, 0.0, 1.5, 2.0]), y // 2, y // 2 + rnd.randrange(2))
        cases.append([row(0, 0), *[row(y, 1) for y in inner], row(end, 2)])
    want = [{y: v for y, v in plain_paths(ns, **rules).items()} for ns in cases]
    for narrow in (0, 1 << 30):
        s, nodes = solver_of(cases, rules)
        s.NARROW = narrow
        s.solve()
        got = [{} for _ in cases]
        for i in np.flatnonzero(s.reach):
            got[s.region[i]][int(s.y[i])] = (int(s.prev[i]) if s.link[i] >= 0 else None, int(s.edge[i]), int(s.short[i]), int(s.deviation[i]), int(s.cnt[i]))
        assert got == want
        # once more, with the nodes before the middle given, as a slice gets them
        given = s.reach & (s.y < 60) & (s.y >= 48)
        keep = given | (s.y >= 60)
        keep &= np.isin(s.region, s.region[given])
        front = sorted(np.flatnonzero(given), key=s.trail)
        rank = np.full(len(s.y), -1)
        rank[front] = np.arange(len(front))
        later = {k: getattr(s, k)[keep].copy() for k in ("y", "role", "q", "cs", "ce", "prev")} | {"lex": rank[keep], "given": given[keep], "first": (s.link < 0)[keep]}
        later |= {k: np.where(given, getattr(s, k), 0)[keep].astype(nodes[k].dtype) for k in P.FIELDS.values()}
        two = P.Solver(later, np.flatnonzero(np.diff(s.region[keep], prepend=-1)), **rules)
        two.NARROW = narrow
        two.solve()
        assert (two.reach == s.reach[keep]).all() and two.reach.sum() > given.sum() > 10
        for k in ("prev", "deviation", "cnt", "edge", "short"):
            assert (getattr(two, k)[two.reach & ~two.given] == getattr(s, k)[keep][two.reach & ~two.given]).all(), k


def test_a_long_region_is_not_solved_by_arrays_of_a_few_cells(monkeypatch):
    calls, asked = [], P.Solver.table
    monkeypatch.setattr(P.Solver, "table", lambda self, i, *a: calls.append(1) or asked(self, i, *a))
    rules = {"target": 7000, "lo": 3000, "hi": 12000, "prefer": 0, "small_edges": False, "first_wins": False}
    region = lambda n: [(k * 500, 0 if k == 0 else 2 if k == n else 1, 0.0, 0, 0) for k in range(n + 1)]
    s, _ = solver_of([region(4000)], rules)
    s.solve()
    assert s.reach[-1] and s.cnt[-1] == 286 and not calls  # each of 667 bands was a call
    s, _ = solver_of([region(66)] * 300, rules)
    s.solve()
    assert s.reach[-1] and 0 < len(calls) <= 12  # many short regions still share the calls of a band


def test_rounds_follow_the_nodes_and_not_the_axis(spark, monkeypatch):
    n = 1200
    rows = [("a", 0, k * 9000, 0 if k == 0 else 2 if k == n else 1) for k in range(n + 1)] + [("b", 5, 5 + 9000 * k, k) for k in range(3)]  # beyond ten blocks of the axis
    df = spark.createDataFrame(rows, "ch string, s long, y long, role long").withColumns({"q": F.lit(0.0), "cs": F.lit(0), "ce": F.lit(0)})

    def solved():
        heard = []
        with on_progress(lambda step, m: heard.append(m["round"])):
            return sorted((r.ch, r.y, r.prev, r.deviation, r.chunks) for r in P.best_paths(df).collect()), len(heard)

    whole, rounds = solved()
    assert rounds == 1 and whole[n] == ("a", n * 9000, (n - 1) * 9000, 2000 * n, n) and whole[-1] == ("b", 18005, 9005, 4000, 2)
    monkeypatch.setattr(P, "NODES", 300)  # blocks of 116 or 117 nodes: three to a slice
    assert solved() == (whole, 4)


def test_positions_around_seeds_are_exchanged_as_seeds(spark):
    rnd = random.Random(7)
    rows = sorted({(rnd.choice("ab"), rnd.randrange(100, 9000)) for _ in range(300)})
    seeds = spark.createDataFrame([(c, y, 100, 9000) for c, y in rows], "ch string, y long, lower long, upper long")
    got = E.refine(seeds)
    want = {(c, p) for c, y in rows for p in [*range(max(100, y - 128), min(9000, y + 128) + 1, 8), y]}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    lines = got._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = [k for k, line in enumerate(lines) if "Generate" in line]
    assert all("Aggregate" not in line for line in lines[:at[0]])  # the many positions meet in no aggregate


def test_points_near_seeds_without_the_positions_around_them(spark, monkeypatch):
    """Safe points are looked up in the seeds; the positions around seeds, about thirty for each, are made by no search."""
    from stripline.operators.escalation import directed
    from stripline.plans import registered

    rnd = random.Random(11)
    rows = sorted({(rnd.choice("ab"), rnd.choice([rnd.randrange(100, 9000), 4000 + rnd.randrange(200)])) for _ in range(60)})
    seeds = spark.createDataFrame([(c, y, 100, 9000) for c, y in rows], "ch string, y long, lower long, upper long")
    points = spark.createDataFrame([(c, y, y % 5) for c in "abc" for y in range(0, 9200)], "ch string, y long, other long")
    want = {(c, p) for c, y in rows for p in [*range(max(100, y - 128), min(9000, y + 128) + 1, 8), y]}
    got = [tuple(r) for r in E.near_seeds(points, seeds).collect()]
    assert len(got) == len(want) and {g[:2] for g in got} == want == {tuple(r) for r in E.refine(seeds).collect()}
    assert all(o == y % 5 for _, y, o in got)

    def refuse(*_, **__):
        raise AssertionError("the positions around seeds are made")

    monkeypatch.setattr(E, "refine", refuse)
    monkeypatch.setattr("stripline.operators.escalation.refine", refuse, raising=False)
    d = spark.createDataFrame([("a", y, "SAFE" if y % 1000 else "UNSAFE", 1.0 * (y % 7), 0.001, 0) for y in range(500, 30000, 500)],
                              "ch string, y long, decision string, band_std double, edge_density double, crossing_components long")
    best = recurrence(0, 30000, [y for y in range(3000, 27001, 500) if y % 1000], 3000, 12000, 7000)[30000]
    chunks = sorted((r.start, r.end) for r in directed(region(spark, "a", 0, 30000), d).collect())
    assert chunks[0][0] == 0 and chunks[-1][1] == 30000 and all(y % 1000 for _, y in chunks[:-1]) and len(chunks) == len(best) - 1
    assert registered()[0]["directed_composition"](spark, "/root/testdata/sf0.001").filter("resolved").count() > 0


def test_many_regions_share_the_calls_of_a_search(spark, monkeypatch):
    """The grouped work is called for tables of whole regions, and not once for each of them."""
    from stripline.operators import blocks as B

    n = 300
    regions = spark.range(n).selectExpr("concat('c', id) ch", "id * 10 s", "id * 10 + 14000 + id e")
    safe = regions.selectExpr("ch", "explode(array(s + 3000, s + 7000, s + 7200, e - 3001)) y")
    best = [recurrence(10 * k, 10 * k + 14000 + k, [10 * k + y for y in (3000, 7000, 7200, 10999 + k)], 3000, 12000, 7000)[10 * k + 14000 + k] for k in range(n)]
    want = {(f"c{k}", a, b) for k, path in enumerate(best) for a, b in zip(path, path[1:])}
    calls = spark.sparkContext.accumulator(0)
    asked = B.by_runs

    def counted(df, keys, order, work, ddl):
        def one(t, first):
            calls.add(1)
            return work(t, first)
        return asked(df, keys, order, one, ddl)

    monkeypatch.setattr(B, "by_runs", counted)
    monkeypatch.setattr(P, "by_runs", counted)
    got = {(r.ch, r.start, r.end) for r in P.complete_path(regions, safe).collect()}
    assert got == want
    assert 0 < calls.value <= 16  # eight partitions, the search and the walk back
    monkeypatch.setattr(B, "RUN_ROWS", 7)  # regions of six nodes, in batches of four rows: one or two to a call
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert {(r.ch, r.start, r.end) for r in P.complete_path(regions, safe).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert calls.value > 200


def test_beams_of_many_regions_share_the_calls(spark, monkeypatch):
    rnd = random.Random(5)
    at = {f"c{k}": sorted(rnd.sample(range(1, 400), 3 + k % 40)) for k in range(200)}
    edge = {(c, y): rnd.choice([0.0, 0.01, 0.02]) for c, ys in at.items() for y in ys}
    zones = spark.createDataFrame([(c, y, e, y % 2) for (c, y), e in edge.items()], "ch string, y long, edge_density double, crossing_components long")
    regions = spark.createDataFrame([(c, 0, 400) for c in at], "ch string, s long, e long")
    calls = spark.sparkContext.accumulator(0)
    asked = P.by_runs

    def counted(df, keys, order, work, ddl):
        def one(t, first):
            calls.add(1)
            return work(t, first)
        return asked(df, keys, order, one, ddl)

    monkeypatch.setattr(P, "by_runs", counted)
    want = {}
    for c, ys in at.items():
        paths = [(0.0, [0])]
        for o in (1, 2):
            t = 400 / 3
            paths = sorted((sc + ((y - p[-1] - t) / t) * ((y - p[-1] - t) / t) + (abs(y - t * o) / t) * (abs(y - t * o) / t) * 0.10 + (edge[c, y] * 1e-3 + y % 2 * 1e-6), [*p, y])
                           for sc, p in paths for y in ys if y - p[-1] >= t * 0.5)[:5]
        ends = [(sc + sum((b - a - t) ** 2 for a, b in zip(p + [400], p[1:] + [400]) if b > a) / 3 / (t * t), [*p, 400]) for sc, p in paths if 400 - p[-1] >= t * 0.5]
        if ends:
            want[c] = min(ends)[1]
    for cells in (1 << 20, 50):  # one pass, and several that keep the best of those before
        monkeypatch.setattr(P.Solver, "CELLS", cells)
        got = {r.ch: r.bounds for r in P.beam_balance(regions, zones, 3, beam=5).collect()}
        assert got == want and len(got) > 100
    assert 0 < calls.value <= 32  # eight partitions, two rounds, twice


@pytest.mark.parametrize("name", ["complete_path", "exhaustive_composition", "beam_balance", "directed_composition"])
def test_evidence_of_a_search_is_sorted_once(spark, monkeypatch, name):
    from stripline.plans import registered, standins

    sorts, asked = [], standins.range_blocks
    monkeypatch.setattr(standins, "range_blocks", lambda *a, **k: sorts.append(1) or asked(*a, **k))
    assert registered()[0][name](spark, "/root/testdata/sf0.001").columns[0] == "ch"
    assert len(sorts) == 1
