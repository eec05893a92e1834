"""Path-search queries."""

from pyspark.sql import functions as F

from stripline.operators import evidence as E
from stripline.operators import layout as L
from stripline.operators import paths as P
from stripline.plans import standins as S
from stripline.plans.plan_evidence import on_path, seeds_of
from stripline.plans.registry import out, query, view
from stripline.session import cut


DEDUPE = """with recursive b as (select ch, kind, center, height, row_number() over (partition by ch order by center, -height, kind) i, count(*) over (partition by ch) n from t_band where height >= 150),
 walk as (select ch, i, i cur, n from b where i=1 union all
  select w.ch, w.i+1, case when x.center - c.center > 8 or x.height > c.height or (x.height = c.height and x.kind='white_band' and c.kind<>'white_band') then x.i else w.cur end, w.n
  from walk w join b x on x.ch=w.ch and x.i=w.i+1 join b c on c.ch=w.ch and c.i=w.cur),
 kept as (select w.ch, w.cur from walk w where w.i=w.n union select w.ch, w.cur from walk w join b x on x.ch=w.ch and x.i=w.i+1 join b c on c.ch=w.ch and c.i=w.cur where x.center - c.center > 8)
select b.ch, b.kind, b.center, b.height from kept k join b on b.ch=k.ch and b.i=k.cur"""
STEP = """list_transform(list_filter(best, lambda b: {ok}), lambda b: {{'edge': b.edge + {small}, 'sh': b.sh + {short}, 'dev': b.dev + abs({d}-7000), 'imb': greatest(b.mx, {d}) - case when b.n=0 then {d} else least(b.mn, {d}) end,
 'n': b.n+1, 'q': b.q - ns[i+1].q, 'tie': {tie}, 'path': list_append(b.path, ns[i+1].y), 'mx': greatest(b.mx, {d}), 'mn': case when b.n=0 then {d} else least(b.mn, {d}) end, 'ce': ns[i+1].ce}})"""
D = "(ns[i+1].y - b.path[-1])"


def recurrence(name: str, nodes: str, loose: bool = False, first: bool = False, sources: bool = False) -> str:
    """SQL of the one-best-path-per-node recurrence: a list of states per region grows node by node."""
    ok = f"{D} <= 12000 and {D} > 0 and " + (f"({D} >= 3000 or b.n=0 or ns[i+1].role=2)" if loose else f"{D} >= 3000")
    step = STEP.format(ok=ok, d=D, small=f"case when {D} < 3000 then 1 else 0 end", short="greatest(0, 4-(ns[i+1].cs-b.ce))" if sources else "0", tie="b.path[-1]" if first else "0")
    return f"""{name} as (select ch, ns, 1 i, [{{'edge': 0::bigint, 'sh': 0::bigint, 'dev': 0::bigint, 'imb': 0::bigint, 'n': 0::bigint, 'q': 0::double, 'tie': 0::bigint, 'path': [ns[1].y], 'mx': 0::bigint, 'mn': 0::bigint, 'ce': ns[1].ce}}] best from {nodes}
 union all select ch, ns, i+1, case when len(c)=0 then best else list_append(best, list_sort(c)[1]) end from (select *, {step} c from {name} where i < len(ns)) z)"""


def nodes_sql(name: str, positions: str, region: str, end: bool = True) -> str:
    """Nodes of the safe search: region ends and the positions strictly inside."""
    tail = "union all select ch, total, 2 from r" if end else ""
    return f"""{name} as (select ch, list({{'y': y, 'role': role, 'q': 0::double, 'cs': 0::bigint, 'ce': 0::bigint}} order by y) ns from (with r as ({region})
 select ch, cast(0 as bigint) y, 0 role from r union all select distinct p.ch, p.y, 1 from ({positions}) p join r on p.ch=r.ch where p.y > 0 and p.y < total {tail}) x group by ch)"""


def chunks_sql(states: str, pick: str) -> str:
    return f"""select ch, p[k] "start", p[k+1] "end" from (select ch, p, unnest(generate_series(1, len(p)-1)) k from (select ch, {pick} p from {states} where i = len(ns)) a where p is not null) b"""


SAFE = "select ch, y_path y from t_decided where decision='SAFE'"
BIG = "select ch, total from t_extent where total > 12000"
TO_END = "list_filter(best, lambda b: b.path[-1] = ns[-1].y)[1].path"
COMPLETE = f"with recursive {nodes_sql('nd', SAFE, BIG)}, {recurrence('dp', 'nd')}, done as ({chunks_sql('dp', TO_END)} union all select ch, 0, total from t_extent where total <= 12000)\n"
REFINED = """select c.ch, c.y from (select ch, unnest(generate_series(greatest(lower,y-128), least(upper,y+128), 8)) y from t_seed union select ch, y from t_seed) c join t_decided d on d.ch=c.ch and d.y_path=c.y and d.decision='SAFE'"""
DIRECTED = f"with recursive {nodes_sql('nd', REFINED, BIG)}, {recurrence('dp', 'nd')}, done as ({chunks_sql('dp', TO_END)} union all select ch, 0, total from t_extent where total <= 12000)\n"
EXHAUSTIVE = f"""with recursive {nodes_sql('n1', SAFE + ' and (y_path//500)%2=0', BIG)}, {recurrence('dp1', 'n1')}, even as ({chunks_sql('dp1', TO_END)} union all select ch, 0, total from t_extent where total <= 12000),
 {nodes_sql('n2', SAFE, BIG + ' and ch not in (select ch from even)')}, {recurrence('dp2', 'n2')}, full_ as ({chunks_sql('dp2', TO_END)}),
 {nodes_sql('n3', SAFE, BIG + ' and ch not in (select ch from even) and ch not in (select ch from full_)', False)}, {recurrence('dp3', 'n3', first=True)},
 pre as ({chunks_sql('dp3', "best[-1].path")}),
 rest as (select t.ch, coalesce(max(p."end"), 0) "start", t.total "end" from t_extent t left join pre p on t.ch=p.ch where t.ch not in (select ch from even) and t.ch not in (select ch from full_) group by t.ch, t.total)
"""
BALANCED = DEDUPE.replace("with recursive", "with recursive", 1).rsplit("select b.ch, b.kind", 1)[0].rstrip().rstrip(",") + f""", one as (select b.ch, b.center y, 1 role, b.height + case when b.kind='white_band' then t.ratio else -t.std end q from kept k join b on b.ch=k.ch and b.i=k.cur
  join t_band t on t.ch=b.ch and t.center=b.center and t.kind=b.kind and t.height=b.height join t_chapter c on c.ch=b.ch where b.center > 0 and b.center < c.total),
 al as (select ch, y, role, q from one union all select ch, cast(0 as bigint), 0, 0 from t_chapter union all select ch, total, 2, 0 from t_chapter),
 cn as (select a.ch, a.y, a.role, a.q, count(*) filter (s.gs < a.y) cs, count(*) filter (s.ge <= a.y) ce from al a join t_strip s on s.ch=a.ch group by all),
 nd as (select ch, list({{'y': y, 'role': role, 'q': q::double, 'cs': cs, 'ce': ce}} order by y) ns from cn where ch in (select ch from t_chapter where total > 12000) group by ch),
 {recurrence('dp', 'nd', sources=True)}, st as (select ch, ns, best, {TO_END} p from dp where i = len(ns)),
 nl as (select ch, ns from st where p is null), {recurrence('dpl', 'nl', loose=True, sources=True)}, sl as (select ch, {TO_END} p from dpl where i = len(ns)),
 pf as (select st.ch, st.ns[-1].y e, list_sort(list_transform(list_filter(best, lambda b: b.n > 0 and ns[-1].y - b.path[-1] >= 3000), lambda b: {{'sh': b.sh, 'dev': b.dev, 'imb': b.imb, 'y': -b.path[-1], 'path': b.path}}))[1].path p from st join sl on st.ch=sl.ch where sl.p is null),
 res as (select ch, p, 'resolved' status, 'bounded_safe_balanced_path' strategy from st where p is not null union all select ch, p, 'resolved', 'bounded_safe_balanced_path_with_edge_chunk' from sl where p is not null
  union all select ch, p, 'partial', 'bounded_safe_balanced_prefix' from pf where p is not null),
 bal as (select ch, p[k] "start", p[k+1] "end", p[k+1]-p[k] height, status, strategy, 'chunk' part from (select *, unnest(generate_series(1, len(p)-1)) k from res) u
  union all select ch, p[-1], e, e-p[-1], 'partial', 'bounded_safe_balanced_prefix', 'residual' from pf where p is not null
  union all select ch, cast(0 as bigint), e, e, 'unresolved', 'no_reachable_safe_path', 'residual' from pf where p is null
  union all select ch, cast(0 as bigint), total, total, 'resolved', 'already_within_max_height', 'chunk' from t_chapter where total <= 12000)
"""


def whole(spark, sf):
    return S.chapter(spark, sf).select("ch", F.lit(0).cast("long").alias("s"), F.col("total").alias("e"))


def balanced(spark, sf):
    return P.balanced_path(whole(spark, sf), cut(S.band(spark, sf)), cut(S.strip(spark, sf)))


@query("balanced_path", BALANCED + "select * from bal")
def balanced_path(spark, sf):
    return out(balanced(spark, sf), "ch", "start", "end", "height", "status", "strategy", "part")


@query("balance_payload", BALANCED + """select b.ch, b."start", b."end", b.height, count(*) source_count, count(*) >= 4 preferred_met from bal b join t_strip s on s.ch=b.ch and s.gs < b."end" and s.ge > b."start" where part='chunk' group by all""")
def balance_payload(spark, sf):
    c = cut(balanced(spark, sf).filter("part = 'chunk'").select("ch", "start", "end", "height"))
    n = L.segment_sources(c, S.strip(spark, sf), ["ch", "start", "end"])
    return out(n, "ch", "start", "end", "height", "source_count", preferred_met=F.col("source_count") >= 4)


@query("dedupe_close_candidates", DEDUPE)
def dedupe_close_candidates(spark, sf):
    b = S.band(spark, sf).filter("height >= 150")
    return out(P.dedupe_close(b), "ch", "kind", "center", "height")


view("t_half", "select ch, concat(ch, '#', i) rc, case when i=0 then 0 else total//2 end s, case when i=0 then total//2 else total end e from t_chapter, (values (0), (1)) t(i)")
view("t_rchapter", "select rc ch, e-s total from t_half")
view("t_rband", "select rc ch, kind, b_start-s b_start, b_end-s b_end, height, center-s center, ratio, std from t_band b join t_half h on b.ch=h.ch and center > s and center < e")
view("t_rstrip", "select rc ch, file, page_no, gs-s gs, ge-s ge from t_strip p join t_half h on p.ch=h.ch")
HALVES = BALANCED.replace("t_chapter", "t_rchapter").replace("t_band", "t_rband").replace("t_strip", "t_rstrip")


@query("level2_decision_reason", HALVES + """, k as (select ch, center, max(case when kind='uniform_color_band' then 1 else 0 end) u from t_rband where height>=150 group by all),
 g as (select b.ch, strategy, max(u) u from bal b left join k on k.ch=b.ch and k.center=b."end" where part='chunk' group by all)
select h.ch, h.s region, strategy, case when strategy like '%edge_chunk' then 'level2_safe_edge_chunk_last_fallback' when u=1 then 'level2_safe_uniform_color_balanced_path' else 'level2_safe_white_balanced_path' end reason from g join t_half h on h.rc=g.ch""")
def level2_decision_reason(spark, sf):
    """Why a region, of which each chapter has two, was resolved: an edge chunk, a path with uniform bands, or one of white bands only."""
    w, mid = whole(spark, sf), F.floor(F.col("e") / 2)
    halves = w.select("ch", F.explode(F.array(F.struct("s", mid.alias("e")), F.struct(mid.alias("s"), "e"))).alias("r")).select("ch", "r.*")
    bands = cut(S.band(spark, sf))
    chunks = cut(P.balanced_path(halves, bands, cut(S.strip(spark, sf))).filter("part = 'chunk'"))
    c = P.into_zones(chunks, P.zoned(halves), ["ch"], "start").withColumnRenamed(P.ZONE, "region").join(halves.select("ch", F.col("s").alias("region"), "e"), ["ch", "region"])
    kinds = bands.filter("height >= 150").groupBy("ch", F.col("center").alias("end")).agg(F.max(F.when(F.col("kind") == "uniform_color_band", 1).otherwise(0)).alias("uniform"))
    inner = F.when(F.col("end") < F.col("e"), F.col("uniform"))  # a region's end is no band of it
    j = c.join(kinds, ["ch", "end"], "left").groupBy("ch", "region", "strategy").agg(F.max(inner).alias("uniform"))
    # The decisions' names.
    why = (F.when(F.col("strategy").endswith("edge_chunk"), "level2_safe_edge_chunk_last_fallback")
           .when(F.col("uniform") == 1, "level2_safe_uniform_color_balanced_path").otherwise("level2_safe_white_balanced_path"))
    return out(j, "ch", "region", "strategy", reason=why)


def searched(spark, sf):
    """Whole strips as regions, their SAFE positions, and the evidence of both, which is sorted and written once."""
    d = cut(on_path(spark, sf).select("ch", "y", "decision", "band_std", "edge_density", "crossing_components"))
    r = cut(d.groupBy("ch").agg((F.max("y") + 500).alias("e")).select("ch", F.lit(0).cast("long").alias("s"), "e"))
    return r, d.filter("decision = 'SAFE'").select("ch", "y", "edge_density", "crossing_components"), d


@query("complete_path", COMPLETE + """select ch, "start", "end", "end"-"start" height from done""")
def complete_path(spark, sf):
    r, safe, _ = searched(spark, sf)
    return out(P.complete_path(r, safe), "ch", "start", "end", "height")


@query("directed_composition", DIRECTED + """select ch, "start", "end", "end"-"start" height, true resolved from done union all select ch, 0, total, total, false from t_extent where ch not in (select ch from done)""")
def directed_composition(spark, sf):
    r, safe, d = searched(spark, sf)
    seeds = seeds_of(d.join(r.select("ch", F.col("e").alias("total")), "ch"))
    done = cut(P.complete_path(r, E.near_seeds(safe.select("ch", "y"), seeds)))
    left = r.join(done.select("ch").distinct(), "ch", "left_anti").select("ch", F.col("s").alias("start"), F.col("e").alias("end"), (F.col("e") - F.col("s")).alias("height"))
    return out(done.withColumn("resolved", F.lit(True)).unionByName(left.withColumn("resolved", F.lit(False))), "ch", "start", "end", "height", "resolved")


@query("exhaustive_composition", EXHAUSTIVE + """select ch, "start", "end", "end"-"start" height, 1::bigint passes, 'chunk' part from even union all select ch, "start", "end", "end"-"start", 2, 'chunk' from full_
union all select ch, "start", "end", "end"-"start", 2, 'prefix' from pre union all select ch, "start", "end", "end"-"start", 2, 'residual' from rest""")
def exhaustive_composition(spark, sf):
    r, safe, _ = searched(spark, sf)
    return out(P.exhaustive_composition(r, safe, 500), "ch", "start", "end", "height", "passes", "part")


def beam_round(o: int, src: str) -> str:
    """SQL of one beam round: every extension of the kept paths, the best 400 stay."""
    d, pos = "((z.y-p.path[-1]-t)/t)", f"(abs(z.y-t*{o})/t)"
    return f"""b{o} as (select ch, score, path, t, e from (select *, row_number() over (partition by ch order by score, path) k from (
  select p.ch, p.score + {d}*{d} + {pos}*{pos}*0.10::double + (z.edge_density*1e-3::double + z.crossing_components*1e-6::double) score, list_append(p.path, z.y) path, t, e
  from {src} p join rep z on z.ch=p.ch and z.y > p.path[-1] and z.y-p.path[-1] >= t*0.5::double) x) y where k<=400)"""


BEAM = f"""with s0 as (select ch, y_path//250 y, edge_density, crossing_components from t_decided where decision='SAFE'),
 s1 as (select *, sum(f) over (partition by ch order by y) g from (select *, case when y - lag(y) over (partition by ch order by y) <= 2 then 0 else 1 end f from s0) a),
 zn as (select ch, g, (min(y)+max(y))/2.0::double mid from s1 group by ch, g),
 rep as (select ch, y, edge_density, crossing_components from (select s1.*, row_number() over (partition by s1.ch, s1.g order by abs(y-mid), edge_density, crossing_components, y) k from s1 join zn on zn.ch=s1.ch and zn.g=s1.g) q where k=1 and y > 0),
 b0 as (select ch, 0::double score, [cast(0 as bigint)] path, (total//250)/4.0::double t, total//250 e from t_extent where ch in (select ch from rep group by ch having count(*) >= 3)),
 {beam_round(1, 'b0')}, {beam_round(2, 'b1')}, {beam_round(3, 'b2')},
 f as (select ch, score, list_append(path, e) bounds, t, [path[2], path[3]-path[2], path[4]-path[3], e-path[4]] h, e/4.0::double m from b3),
 v as (select ch, bounds, score + ((h[1]-m)*(h[1]-m)+(h[2]-m)*(h[2]-m)+(h[3]-m)*(h[3]-m)+(h[4]-m)*(h[4]-m))/4.0::double/greatest(1, m*m) score from f where list_min(h) >= t*0.5::double)
select ch, round(score,6) score, array_to_string(bounds, '-') bounds from (select *, row_number() over (partition by ch order by score, bounds) k from v) w where k=1"""


@query("beam_balance", BEAM)
def beam_balance(spark, sf):
    r, safe, _ = searched(spark, sf)
    s = cut(safe.select("ch", (F.col("y") / 250).cast("long").alias("y"), "edge_density", "crossing_components"))
    r = r.select("ch", "s", (F.col("e") / 250).cast("long").alias("e"))
    b = P.beam_balance(r, E.safe_zones(s), 4)
    return out(b, "ch", score=F.round("score", 6), bounds=F.array_join(F.transform("bounds", lambda x: x.cast("string")), "-"))


WALK = """with recursive near as (select * from (select n.ch, n.y_path y, s.y_path alt, row_number() over (partition by n.ch, n.y_path order by s.edge_density, s.crossing_components, abs(s.y_path-n.y_path), case when s.y_path<n.y_path then 0 else 1 end) r
  from t_decided n join t_decided s on n.ch=s.ch and n.decision='UNSAFE' and s.decision='SAFE' and s.y_path between n.y_path-1500 and n.y_path+1500) z where r=1),
 pick as (select d.ch, d.y_path y, d.decision, d.reason, case when d.decision='SAFE' then d.y_path else n.alt end chosen from t_decided d left join near n on d.ch=n.ch and d.y_path=n.y),
 edge as (select a.ch, a.cur, t.total, p.decision, case when p.y is null then 'no_evidence' else p.reason end reason, case when chosen > cur and chosen < total then chosen end nxt
  from (select ch, cast(0 as bigint) cur from t_extent union select ch, y_path from t_decided where decision='SAFE') a join t_extent t on a.ch=t.ch left join pick p on p.ch=a.ch and p.y=a.cur+12000 where t.total-a.cur > 12000),
 walk as (select ch, cast(0 as bigint) cur from t_extent union all select e.ch, e.nxt from walk w join edge e on e.ch=w.ch and e.cur=w.cur where e.nxt is not null),
 seen as (select e.* from walk w join edge e on e.ch=w.ch and e.cur=w.cur)
"""


@query("level3_residual_walk", WALK + """
select ch, cur "start", nxt "end", reason, null::varchar trigger_reason, 'safe' part from seen where nxt is not null
union all select ch, cur, total, case when decision is not null and total-cur > 3000 then 'continuous_scene_too_long' else reason end, reason, 'residual' from seen where nxt is null
union all select t.ch, coalesce(l, 0), total, 'remaining_within_max_height', null, 'safe' from t_extent t left join (select ch, max(nxt) l from seen group by ch) m on t.ch=m.ch where t.ch not in (select ch from seen where nxt is null)""")
def level3_residual_walk(spark, sf):
    d = cut(on_path(spark, sf))
    r = d.groupBy("ch").agg((F.max("y") + 500).alias("e")).select("ch", F.lit(0).cast("long").alias("s"), "e")
    ok, rest = E.residual_walk(d, r, 1500)
    a = ok.withColumns({"trigger_reason": F.lit(None).cast("string"), "part": F.lit("safe")})
    b = rest.drop("decision").withColumn("part", F.lit("residual"))
    return out(a.unionByName(b), "ch", "start", "end", "reason", "trigger_reason", "part")
