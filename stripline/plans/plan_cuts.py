"""Cut queries."""

from pyspark.sql import functions as F

from stripline.functions.names import page_range_name
from stripline.operators import cuts as C
from stripline.operators import layout as L
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view
from stripline.session import cut

view("t_pos", "select ch, cast(0 as bigint) cur, total from t_chapter union select ch, center, total from t_band where kind='white_band' and height>=150")
view("t_cand", """
select p.ch, cur, center, height, ratio, center-cur-7000 distance, center <= least(p.total-3000, cur+9500) normal
from t_pos p join t_band b on p.ch=b.ch and b.kind='white_band' and p.total-cur > 9500 and center > cur+3000 and center between cur+5200 and least(p.total-3000, cur+12000)
""")
view("t_edge", """
select ch, cur, center nxt, height, distance, case when normal then 'safe_band_near_target' else 'next_safe_band_forward' end reason from (
 select *, row_number() over (partition by ch, cur order by normal desc, case when normal then abs(distance) else center end, case when normal then -height end, case when normal then -ratio end, center) r
 from t_cand where height>=150) x where r=1
""")
GREEDY = """with recursive walk as (select ch, 0::bigint cur, 0 step from t_chapter union all select e.ch, e.nxt, step+1 from walk w join t_edge e on e.ch=w.ch and e.cur=w.cur),
 path as (select e.ch, cast(e.cur as bigint) cur, e.nxt from walk w join t_edge e on e.ch=w.ch and e.cur=w.cur),
 chunk as (select ch, cur "start", nxt "end" from path union all select c.ch, coalesce(l,cast(0 as bigint)), total from t_chapter c left join (select ch, max(nxt) l from path group by ch) m on c.ch=m.ch where coalesce(l,cast(0 as bigint)) < total)
"""


def tables(spark, sf):
    """Bands, written once for the several passes over them, and chapter totals."""
    return cut(S.band(spark, sf)), S.chapter(spark, sf).select("ch", "total")


@query("next_cut_edges", "select ch, cur, nxt, height, distance, reason from t_edge")
def next_cut_edges(spark, sf):
    return out(C.next_cut_edges(*tables(spark, sf)), "ch", "cur", "nxt", "height", "distance", "reason")


@query("nearest_cut_rank", """
select ch, cur, center, row_number() over (partition by ch, cur order by normal desc, case when normal then abs(distance) else center end, case when normal then -height end, case when normal then -ratio end, center) rank
from t_cand where height>=150""")
def nearest_cut_rank(spark, sf):
    from pyspark.sql import Window as W
    b, t = tables(spark, sf)
    c = C.candidates(C.positions(b, t), b).filter(F.col("height") >= C.MIN_BAND)
    n = F.col("normal")  # a window holds at most max_chunk - low rows of the axis, so (ch, cur) groups are bounded
    w = W.partitionBy("ch", "cur").orderBy(F.desc("normal"), F.when(n, F.abs("distance")).otherwise(F.col("center")),
                                          F.when(n, -F.col("height")), F.when(n, -F.col("ratio")), "center")
    return out(c.withColumn("rank", F.row_number().over(w)), "ch", "cur", "center", "rank")


@query("greedy_cut_path", GREEDY + "select * from path")
def greedy_cut_path(spark, sf):
    return out(C.greedy_cut_path(*tables(spark, sf)), "ch", "cur", "nxt")


@query("cut_decisions", GREEDY + """, stood as (select ch, cur, nxt from path union all select c.ch, c."start", null from chunk c join t_chapter t on c.ch=t.ch and c."end"=t.total)
select c.ch, c.cur, center, case when height<150 then 'rejected' when center=nxt then 'selected' else 'not_selected' end decision,
 case when height<150 then 'white_band_too_short' when center=nxt and normal then 'safe_band_near_target' when center=nxt then 'next_safe_band_forward'
  when normal then 'another_safe_band_ranked_better' else 'forward_candidate_not_needed' end reason from stood s join t_cand c on s.ch=c.ch and s.cur=c.cur""")
def cut_decisions(spark, sf):
    return out(C.cut_decisions(*tables(spark, sf)), "ch", "cur", "center", "decision", "reason")


@query("oversized_chunks", GREEDY + """select ch, "start", "end", "end"-"start" height from chunk where "end"-"start" > 12000""")
def oversized_chunks(spark, sf):
    b, t = tables(spark, sf)
    return out(C.chunks(C.greedy_cut_path(b, t), t).filter(F.col("height") > C.MAX_CHUNK), "ch", "start", "end", "height")


LEVEL1 = GREEDY + """, jump as (select c.ch, c."start", (select min(center) from t_band b where b.ch=c.ch and kind='white_band' and height>=150 and center > c."start"+12000 and center <= b.total-3000) r
  from chunk c where "end"-"start" > 12000),
 again as (select ch, r cur, 0 step from jump where r is not null union all select e.ch, e.nxt, step+1 from again w join t_edge e on e.ch=w.ch and e.cur=w.cur),
 steps as (select e.ch, e.cur "start", e.nxt "end" from again w join t_edge e on e.ch=w.ch and e.cur=w.cur),
 seg as (select ch, "start", "end" from chunk c where not exists (select 1 from jump j where j.ch=c.ch and j."start"=c."start" and r is not null)
  union all select ch, "start", r from jump where r is not null union all select * from steps
  union all select j.ch, coalesce(l, r), total from jump j join t_chapter t on j.ch=t.ch left join (select ch, max("end") l from steps group by ch) m on j.ch=m.ch where r is not null)
"""


@query("level1_partition", LEVEL1 + """select ch, "start", "end", "end"-"start" height, case when "end"-"start" <= 12000 then 'passed' else 'failed' end status from seg where "start"<"end" """)
def level1_partition(spark, sf):
    return out(C.level1_partition(*tables(spark, sf)), "ch", "start", "end", "height", "status")


view("t_redge", """
select ch, cur, nxt, 'greedy' strategy from t_edge
union all select ch, cur, coalesce(s, x, f), case when s is not null then 'strict_safe_zone' when x is not null then 'strict_small_extension' when f is not null then 'strict_extended_safe_zone' else 'no_safe_band' end from (
 select p.ch, p.cur, max(center) filter (center between cur+3000 and least(p.total-3000, cur+12000)) s,
  min(center) filter (center > least(p.total-3000, cur+12000) and center <= least(p.total-3000, cur+13000)) x, min(center) filter (center > cur+13000 and center <= p.total-3000) f
 from t_pos p left join t_band b on p.ch=b.ch and kind='white_band' and height>=150 where p.total-cur > 12000 and not exists (select 1 from t_edge e where e.ch=p.ch and e.cur=p.cur) group by p.ch, p.cur) q
""")


@query("review_proposal", """with recursive walk as (select ch, 0::bigint cur from t_chapter union all select e.ch, e.nxt from walk w join t_redge e on e.ch=w.ch and e.cur=w.cur where e.nxt is not null)
select e.ch, e.cur, e.nxt, e.strategy from walk w join t_redge e on e.ch=w.ch and e.cur=w.cur""")
def review_proposal(spark, sf):
    return out(C.review_proposal(*tables(spark, sf)), "ch", "cur", "nxt", "strategy")


LIMIT = GREEDY + """, c2 as (select distinct ch, center, kind, height, ratio, std from t_band where kind<>'white_band' or height>=150),
 at_ as (select ch, "start" cur, "start" s, "end" e from chunk union select k.ch, center, k."start", k."end" from chunk k join c2 on k.ch=c2.ch and center > k."start" and center < k."end"),
 cnt as (select a.ch, a.cur, a.e, count(*) n, min(page_no) f from at_ a join t_strip s on a.ch=s.ch and s.ge > a.cur and s.gs < a.e group by all),
 over_ as (select c.ch, c.cur, c.e, s.ge allowed_end from cnt c join t_strip s on c.ch=s.ch and s.page_no=c.f+3 where n > 4),
 pick as (select * from (select o.ch, o.cur, center nxt, kind, row_number() over (partition by o.ch, o.cur order by case when kind='white_band' then 0 else 1 end, abs(center-o.cur-7000),
   case when kind='white_band' then -height else std end, case when kind='white_band' then -ratio else 0 end, center) r
  from over_ o join c2 on o.ch=c2.ch and center between o.cur+3000 and least(allowed_end, e-3000)) z where r=1),
 le as (select o.ch, o.cur, p.nxt, p.kind from over_ o left join pick p on o.ch=p.ch and o.cur=p.cur),
 lw as (select ch, "start" cur from chunk union all select l.ch, l.nxt from lw join le l on l.ch=lw.ch and l.cur=lw.cur where l.nxt is not null)
"""


@query("source_limit_cuts", LIMIT + "select le.ch, le.cur, le.nxt, le.kind from lw join le on le.ch=lw.ch and le.cur=lw.cur")
def source_limit_cuts(spark, sf):
    b, t = tables(spark, sf)
    c = cut(C.chunks(C.greedy_cut_path(b, t), t))
    return out(C.source_limit_cuts(c, b, cut(S.strip(spark, sf)), 4), "ch", "cur", "nxt", "kind")


@query("uniform_cut_rank", """
select ch, cur, center, rank from (select p.ch, cur, center, row_number() over (partition by p.ch, cur order by abs(center-cur-7000), std, center) rank
from t_pos p join t_band b on p.ch=b.ch and b.kind='uniform_color_band' and center between cur+3000 and least(cur+12000, p.total-3000)) x""")
def uniform_cut_rank(spark, sf):
    from pyspark.sql import Window as W

    from stripline.operators.blocks import point_join
    b, t = tables(spark, sf)
    at = C.positions(b, t).withColumns({"_lo": F.col("cur") + C.MIN_CHUNK, "_hi": F.least(F.col("cur") + C.MAX_CHUNK, F.col("total") - C.MIN_CHUNK) + 1}).filter("_lo < _hi")
    c = point_join(b.filter("kind = 'uniform_color_band'").select("ch", "center", "std"), at, ["ch"], "center", ("_lo", "_hi"))
    w = W.partitionBy("ch", "cur").orderBy(F.abs(F.col("center") - F.col("cur") - C.TARGET), "std", "center")
    return out(c.withColumn("rank", F.row_number().over(w)), "ch", "cur", "center", "rank")


@query("candidate_union", "select ch, kind, center, height, case when height<150 then 'rejected' else 'eligible' end decision, case when height<150 then case kind when 'white_band' then 'white_band_too_short' else 'uniform_band_too_short' end end reason from t_band")
def candidate_union(spark, sf):
    b = S.band(spark, sf)
    both = b.filter("kind = 'white_band'").unionByName(b.filter("kind <> 'white_band'"))
    short = F.col("height") < C.MIN_BAND
    why = F.when(short & (F.col("kind") == "white_band"), "white_band_too_short").when(short, "uniform_band_too_short")
    return out(both, "ch", "kind", "center", "height", decision=F.when(short, "rejected").otherwise("eligible"), reason=why)


@query("outputs_with_pages", GREEDY + """
select k.ch, k."start", k."end", concat('page-', format('{:03d}', min(page_no)), case when min(page_no)<>max(page_no) then concat('-', format('{:03d}', max(page_no))) else '' end, '.png') as name,
 count(*) pages, case when k."end"-k."start" <= 12000 then 'passed' else 'failed' end status
from chunk k join t_strip s on k.ch=s.ch and greatest(k."start", gs) < least(k."end", ge) group by all""")
def outputs_with_pages(spark, sf):
    b, t = tables(spark, sf)
    c = C.chunks(C.greedy_cut_path(b, t), t)
    s = L.source_spans(c, S.strip(spark, sf)).groupBy("ch", "start", "end").agg(
        F.min("page_no").alias("a"), F.max("page_no").alias("z"), F.count(F.lit(1)).alias("pages"))
    return out(s, "ch", "start", "end", "pages", name=page_range_name(F.col("a"), F.col("z")),
               status=F.when(F.col("end") - F.col("start") <= C.MAX_CHUNK, "passed").otherwise("failed"))
