"""Visual balance queries over page features."""

from pyspark.sql import functions as F

from stripline.operators import balance as B
from stripline.operators import evidence as E
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view
from stripline.session import cut

Z = [f"z{i}" for i in range(1, 7)]
view("t_z", "select ch, page_no, gs, ge, h, n, " + ", ".join(f"(f{i}-m{i})/case when s{i}=0 then 1 else s{i} end z{i}" for i in range(1, 7))
     + " from t_feat join (select ch c2, count(*) n, " + ", ".join(f"avg(f{i}) m{i}, stddev_pop(f{i}) s{i}" for i in range(1, 7)) + " from t_feat group by ch) m on ch=c2")
view("t_strength", "select ch, page_no, gs, sqrt(" + "+".join(f"(z{i}-p{i})*(z{i}-p{i})" for i in range(1, 7)) + ") strength from (select *, "
     + ", ".join(f"lag(z{i}) over (partition by ch order by page_no) p{i}" for i in range(1, 7)) + " from t_z) x where p1 is not null")
view("t_rupture", """select * from (select *, row_number() over (partition by ch order by strength desc, gs) rank from (select *, max(strength) over (partition by ch) mx from t_strength) a
 where strength >= greatest(2.0::double, mx*0.9::double)) b where rank<=3""")

MEAN = ", ".join(f"avg(m.z{i}) c{i}" for i in range(1, 7))


def apart(a: str, b: str, left: str = "c") -> str:
    return "sqrt(" + "+".join(f"({a}.{left}{i}-{b}.c{i})*({a}.{left}{i}-{b}.c{i})" for i in range(1, 7)) + ")"


view("t_island", f"""
with w as (select ch, page_no s, k, n from t_z cross join (select unnest([3,4,5]) k) q where page_no + k - 1 <= n),
 c as (select w.ch, w.s, w.k, {MEAN} from w join t_z m on m.ch=w.ch and m.page_no between w.s and w.s+w.k-1 group by all),
 d as (select c.ch, c.s, c.k, avg({apart('m', 'c', 'z')}) disp from c join t_z m on m.ch=c.ch and m.page_no between c.s and c.s+c.k-1 group by all),
 lc as (select w.ch, w.s, w.k, {MEAN} from w join t_z m on m.ch=w.ch and m.page_no between w.s-3 and w.s-1 group by all),
 rc as (select w.ch, w.s, w.k, {MEAN} from w join t_z m on m.ch=w.ch and m.page_no between w.s+w.k and w.s+w.k+2 group by all),
 v as (select w.ch, w.s, w.k, greatest(d.disp, 1e-9::double) inner_, dl.disp/greatest(d.disp, 1e-9::double)-1.0::double gl, dr.disp/greatest(d.disp, 1e-9::double)-1.0::double gr, least({apart('c', 'lc')}, {apart('c', 'rc')}) contrast
  from w join c using (ch, s, k) join d using (ch, s, k) join lc using (ch, s, k) join rc using (ch, s, k) join d dl on dl.ch=w.ch and dl.s=w.s-1 and dl.k=w.k+1 join d dr on dr.ch=w.ch and dr.s=w.s and dr.k=w.k+1
  where w.k < 5 and w.s >= 2 and w.s + w.k <= w.n and not exists (select 1 from t_rupture r where r.ch=w.ch and r.page_no in (w.s, w.s+w.k)))
select v.ch, s first_no, s+k end_no, a.gs start_y, b.gs end_y, round(inner_,6) "internal", round(gl,6) gain_left, round(gr,6) gain_right, round(contrast,6) contrast, round(gl+gr+contrast-inner_,6) score
from v join t_z a on a.ch=v.ch and a.page_no=s join t_z b on b.ch=v.ch and b.page_no=s+k where inner_ <= 0.75 and gl >= 0.25 and gr >= 0.25 and contrast >= 0.65
""")
view("t_islands2", """
with f as (select * from (select *, row_number() over (partition by ch order by score desc, "internal", start_y, end_y) rank from t_island) x where rank=1),
 g as (select i.* from t_island i join f on i.ch=f.ch where i.end_no <= f.first_no or i.first_no >= f.end_no)
select * from f union all select * exclude (r), 2 from (select *, row_number() over (partition by ch order by score desc, "internal", start_y, end_y) r from g) y where r=1
""")


def z(spark, sf):
    return cut(B.standardize(S.feat(spark, sf)))


@query("standardize_features", "select ch, page_no, " + ", ".join(f"round({c},6)+0.0::double {c}" for c in Z) + " from t_z")
def standardize_features(spark, sf):
    return out(B.standardize(S.feat(spark, sf)), "ch", "page_no", **{c: F.round(c, 6) + F.lit(0.0) for c in Z})


@query("regime_rupture", "select ch, page_no, gs, round(strength,6) strength, rank from t_rupture")
def regime_rupture(spark, sf):
    return out(B.ruptures(z(spark, sf)), "ch", "page_no", "gs", "rank", strength=F.round("strength", 6))


def found(spark, sf):
    u = z(spark, sf)
    r = cut(B.ruptures(u))
    return u, r, cut(B.islands(u, r))


ISLAND = ["ch", "first_no", "end_no", "start_y", "end_y", "internal", "gain_left", "gain_right", "contrast", "score"]


@query("visual_islands", "select * from t_island")
def visual_islands(spark, sf):
    return out(found(spark, sf)[2], *ISLAND)


@query("greedy_islands", "select * from t_islands2")
def greedy_islands(spark, sf):
    return out(B.pick_islands(found(spark, sf)[2]), *ISLAND, "rank")


ANCHORS = """with recursive raw as (select ch, gs y, 'strong_regime_rupture' reason, 100+strength priority from t_rupture union all select ch, start_y, 'visual_island_start', 80+score from t_islands2 union all select ch, end_y, 'visual_island_end', 80+score from t_islands2),
 one as (select * from (select *, row_number() over (partition by ch, y order by priority desc, reason) k from raw) x where k=1),
 sz as (select ch, cast(greatest(1, round_even(median(h)*2,0)) as bigint) gap, min(gs) s, max(ge) e from t_feat group by ch),
 c as (select o.ch, y, reason, priority, gap, row_number() over (partition by o.ch order by priority desc, y, reason) r from one o join sz on o.ch=sz.ch where y-s >= gap and e-y >= gap),
 walk as (select ch, 1 r, [y] got from c where r=1 union all
  select w.ch, w.r+1, case when len(list_filter(w.got, lambda g: abs(g-c.y) < c.gap))=0 then list_append(w.got, c.y) else w.got end from walk w join c on c.ch=w.ch and c.r=w.r+1),
 fin as (select ch, arg_max(got, r) got from walk group by ch),
 anc as (select c.ch, c.y, c.reason, c.gap min_gap, priority from c join fin f on f.ch=c.ch where list_contains(f.got, c.y))
"""
PARTITION = ANCHORS + """, tot as (select ch, max(ge) total, count(*) n from t_feat group by ch),
 lim as (select a.ch, y a, coalesce(lag(y) over w, 0) l, coalesce(lead(y) over w, total) r from anc a join tot t on a.ch=t.ch window w as (partition by a.ch order by y)),
 rad as (select *, cast(floor(least(1800, greatest(240, 0.35::double*least(greatest(a-l,1), greatest(r-a,1))))) as bigint) q from lim),
 safe as (select distinct ch, center y, 400-height e from t_band w where kind='white_band' and height>=20 and center>=0 and not exists (select 1 from t_band u where u.ch=w.ch and u.kind='uniform_color_band' and w.center >= greatest(0, u.b_start-16) and w.center < u.b_end+17)),
 pick as (select * from (select rad.ch, a, y, row_number() over (partition by rad.ch, a order by abs(y-a), e, y) k from rad join safe on safe.ch=rad.ch and y between greatest(l+1, a-q) and least(r-1, a+q)) z where k=1),
 sn as (select lim.ch, lim.a, case when exists (select 1 from t_band b where b.ch=lim.ch and b.kind='white_band' and b.height>=100 and b.center=lim.a) then lim.a else pick.y end s from lim left join pick on pick.ch=lim.ch and pick.a=lim.a),
 od as (select *, s is not null and coalesce(s > lag(s) over (partition by ch order by a), true) ok from sn),
 g as (select ch, count(*) anchors, count(*) filter (s is null) lost, count(*) filter (not ok) bad, string_agg(cast(s as varchar), '-' order by s) cuts from od group by ch),
 rs as (select t.ch, anchors, cuts, case when n<4 then 'too_few_slices' when anchors is null then 'no_visual_anchor' when lost>0 then 'no_safe_snap' when bad>0 then 'anchors_not_increasing' end reason from tot t left join g on g.ch=t.ch)
"""


@query("anchor_select", ANCHORS + "select ch, y, reason, min_gap, round(priority,6) priority from anc")
def anchor_select(spark, sf):
    u, r, i = found(spark, sf)
    return out(B.select_anchors(u, r, B.pick_islands(i)), "ch", "y", "reason", "min_gap", priority=F.round("priority", 6))


@query("balance_partition", PARTITION + "select ch, case when reason is null then 'PROPOSTA_GERADA' else 'SEM_PROPOSTA_SAFE' end status, reason, anchors, case when reason is null then cuts end cuts from rs")
def balance_partition(spark, sf):
    """Features, anchors, protected ranges, snapping and the proposal of every chapter."""
    from pyspark.sql import Window as W

    from stripline.operators.blocks import overlap_semi
    u, r, i = found(spark, sf)
    a = cut(B.select_anchors(u, r, B.pick_islands(i)))
    band = cut(S.band(spark, sf))
    w = W.partitionBy("ch").orderBy("y")  # at most seven anchors a chapter
    total = u.groupBy("ch").agg(F.max("ge").alias("total"), F.max("n").alias("n"))
    lim = a.join(total, "ch").select("ch", F.col("y").alias("anchor_y"), F.coalesce(F.lag("y").over(w), F.lit(0)).alias("left"), F.coalesce(F.lead("y").over(w), F.col("total")).alias("right"))
    white = band.filter("kind = 'white_band' and height >= 20").select(
        "ch", F.col("center").alias("y"), (F.lit(400) - F.col("height")).cast("double").alias("edge_density"), F.lit(0).alias("crossing_components"), (F.col("center") + 1).alias("_stop"))
    guard = band.filter("kind = 'uniform_color_band'").select("ch", (F.col("b_start") - 16).alias("r0"), (F.col("b_end") + 17).alias("r1"))
    safe = overlap_semi(white.filter("y >= 0"), guard.withColumn("r0", F.greatest("r0", F.lit(0))), ["ch"], ("y", "_stop"), ("r0", "r1"), anti=True)
    edge = band.filter("kind = 'white_band' and height >= 100").select("ch", F.col("center").alias("y"))
    s = E.anchor_snap(cut(lim), edge, cut(safe.drop("_stop")))
    return out(B.proposal(total.select("ch", "n"), s), "ch", "status", "reason", "anchors", "cuts")
