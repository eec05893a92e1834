"""Composition queries over stage pieces."""

from pyspark.sql import functions as F

from stripline.operators import compose as K
from stripline.operators import official as Q
from stripline.operators.blocks import point_join
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view
from stripline.session import cut

SPAN = ("g_start", "g_end")


def chapters(spark, sf):
    return S.chapter(spark, sf).select("ch", "total")


def review(spark, sf):
    return S.piece(spark, sf).filter("stage = 'review'")


view("t_cover", """
select ch, unnest(list_filter([case when g_start > c then 'gap' when g_start < c then 'overlap' end, case when g_end <= g_start then 'empty' end], lambda k: k is not null)) kind, c "at", g_start "next"
from (select *, coalesce(lag(g_end) over (partition by ch order by g_start, g_end), cast(0 as bigint)) c from t_piece) x
union all select ch, 'incomplete', l, total from (select ch, arg_max(g_end, g_start*1000000+g_end) l, max(total) total from t_piece group by ch) y where l <> total
""")


@query("coverage_check", "select * from t_cover")
def coverage_check(spark, sf):
    return out(K.coverage_errors(S.piece(spark, sf), chapters(spark, sf)), "ch", "kind", "at", "next")


@query("pending_overlap", """
select ch, g_start, g_end, kind from (select ch, g_start, g_end, unnest(list_filter([case when g_start<0 or g_end>total or g_end<=g_start then 'out_of_range' end,
 case when lag(g_end) over (partition by ch order by g_start, g_end) > g_start then 'overlap' end], lambda k: k is not null)) kind from t_piece) x""")
def pending_overlap(spark, sf):
    return out(K.pending_errors(S.piece(spark, sf)), "ch", "g_start", "g_end", "kind")


view("t_parent", "select ch, (page_no-1)//12 pid, min(gs) p_start, max(ge) p_end from t_strip where page_no > 4 group by all")


@query("exact_retiling", """
with j as (select p.ch, p_start, p_end, g_start, g_end from t_piece c join t_parent p on p.ch=c.ch and g_start >= p_start and g_start < p_end),
 w as (select *, coalesce(lag(g_end) over (partition by ch, p_start, p_end order by g_start, g_end), p_start) c from j)
select ch, p_start, p_end, unnest(list_filter([case when g_start > c then 'gap' when g_start < c then 'overlap' end, case when g_end <= g_start then 'empty' end], lambda k: k is not null)) kind, c "at", g_start "next" from w
union all select p.ch, p.p_start, p.p_end, 'incomplete', coalesce(l, p.p_start), p.p_end from t_parent p left join (select ch, p_start, max(g_end) l from j group by all) m on p.ch=m.ch and p.p_start=m.p_start where coalesce(l, p.p_start) <> p.p_end
union all select ch, null, null, 'orphan', g_start, g_end from t_piece c where not exists (select 1 from t_parent p where p.ch=c.ch and g_start >= p_start and g_start < p_end)""")
def exact_retiling(spark, sf):
    par = S.strip(spark, sf).filter("page_no > 4").groupBy("ch", F.floor((F.col("page_no") - 1) / 12).alias("pid")).agg(F.min("gs").alias("p_start"), F.max("ge").alias("p_end"))
    return out(K.retiling_errors(par, S.piece(spark, sf)), "ch", "p_start", "p_end", "kind", "at", "next")


@query("union_stage_pieces", """select ch, g_start, g_end, 'auto_merge' stage from t_piece where stage='auto_merge' union all select ch, g_start, g_end, 'level2' from t_piece where stage='level2'
union all select ch, g_start, g_end, 'manual' from t_piece where stage='review'""")
def union_stage_pieces(spark, sf):
    p = S.piece(spark, sf).select("ch", "g_start", "g_end", F.col("stage").alias("was"))
    u = K.union_stages({"auto_merge": p.filter("was = 'auto_merge'"), "level2": p.filter("was = 'level2'"), "manual": p.filter("was = 'review'")})
    return out(u, "ch", "g_start", "g_end", "stage")


@query("stage_dedupe_exact", """
with a as (select ch, g_start, g_end, stage from t_piece union all select ch, g_start, g_end, 'manual' from t_piece),
 r as (select ch, g_start r_start, g_end r_end from t_piece where stage='review'),
 o as (select *, list_position(['auto_merge','level2','level3','level4','level5','review','manual'], stage) k from a where not exists (select 1 from r where r.ch=a.ch and greatest(r_start,g_start) < least(r_end,g_end)))
select ch, g_start, g_end, arg_min(stage, k) stage from o group by all""")
def stage_dedupe_exact(spark, sf):
    p = S.piece(spark, sf).select("ch", "g_start", "g_end", "stage")
    two = p.unionByName(p.withColumn("stage", F.lit("manual")))
    r = review(spark, sf).select("ch", F.col("g_start").alias("r_start"), F.col("g_end").alias("r_end"))
    return out(K.drop_overlaps_and_repeats(two, r), "ch", "g_start", "g_end", "stage")


@query("needs_review_join", """
with o as (select ch, seg, g_start s, g_end e from t_halved), p as (select ch, g_start rs, g_end re from t_piece where stage='review' and g_end>g_start),
 c as (select distinct ch, center from t_band where kind='white_band' and ratio=0.985),
 x as (select o.*, case when exists (select 1 from p where p.ch=o.ch and greatest(rs,s)<least(re,e)) then 'auto_merge_pending_interval'
  when o.ch not in (select ch from t_piece where stage='review') and exists (select 1 from c where c.ch=o.ch and (center=s or center=e)) then 'review_cut_boundary' end reason from o)
select *, reason is not null or count(reason) over (partition by ch)=0 shown from x""")
def needs_review_join(spark, sf):
    mid = F.floor((F.col("g_start") + F.col("g_end")) / 2)
    h = F.col("half")
    o = S.piece(spark, sf).filter("g_end - g_start > 1").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "ch", (F.col("seg") * 2 + h).alias("seg"), F.when(h == 0, F.col("g_start")).otherwise(mid).alias("s"), F.when(h == 0, mid).otherwise(F.col("g_end")).alias("e"))
    p = review(spark, sf).select("ch", F.col("g_start").alias("r_start"), F.col("g_end").alias("r_end"))
    c = S.band(spark, sf).filter("kind = 'white_band' and ratio = 0.985D").select("ch", "center")
    return out(K.needs_review(o, p, c), "ch", "seg", "s", "e", "reason", "shown")


@query("resolved_only_sources", """
with j as (select p.ch, stage, file from t_piece p join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge))
select distinct ch, file from j where stage<>'review' except select ch, file from j where stage='review'""")
def resolved_only_sources(spark, sf):
    j = K.joined_pages(S.piece(spark, sf), S.strip(spark, sf))
    done = j.filter("stage <> 'review'").select("ch", "file").distinct()
    return done.join(j.filter("stage = 'review'").select("ch", "file"), ["ch", "file"], "left_anti")


@query("scope_equals", """
with a as (select ch, g_start, g_end from t_piece where stage='review'), b as (select ch, min(gs) g_start, max(ge) g_end from t_strip where ((page_no-1)//4)%6=5 group by ch, (page_no-1)//4)
select ch, g_start, g_end, 'left' side, 1::bigint times from (select * from a except all select * from b) union all select ch, g_start, g_end, 'right', 1 from (select * from b except all select * from a)""")
def scope_equals(spark, sf):
    seg = F.floor((F.col("page_no") - 1) / 4)
    b = S.strip(spark, sf).groupBy("ch", seg.alias("seg")).agg(F.min("gs").alias("g_start"), F.max("ge").alias("g_end")).filter("seg % 6 = 5")
    return out(K.interval_difference(review(spark, sf), b, ["ch", "g_start", "g_end"]), "ch", "g_start", "g_end", "side", "times")


view("t_icut", """select p.ch, seg, g_start, g_end, center cut, b.height from t_piece p join t_band b on p.ch=b.ch and kind='white_band' and center > g_start and center < g_end""")


def inner_cuts(spark, sf, pieces=None):
    p = (pieces if pieces is not None else S.piece(spark, sf)).select("ch", "seg", "g_start", "g_end")
    b = S.band(spark, sf).filter("kind = 'white_band'").select("ch", "center", "height")
    return point_join(b, p, ["ch"], "center", SPAN).filter("center > g_start").select("ch", "seg", F.col("center").alias("cut"), "height")


@query("tile_from_cuts", """
with m as (select ch, seg, g_start y from t_piece where g_end > g_start union select ch, seg, g_end from t_piece where g_end > g_start union select ch, seg, cut from t_icut),
 t as (select ch, seg, row_number() over w "index", y "start", lead(y) over w "end", first_value(y) over w r from m window w as (partition by ch, seg order by y))
select ch, seg, "index", "start", "end", "start"-r rel_start, "end"-r rel_end from t where "end" is not null""")
def tile_from_cuts(spark, sf):
    p = S.piece(spark, sf).filter("g_end > g_start")
    return out(K.tile_from_cuts(p, inner_cuts(spark, sf), ["ch", "seg"]), "ch", "seg", "index", "start", "end", "rel_start", "rel_end")


@query("validate_cuts", """
with c as (select p.ch, seg, page_no - seg*4 ord, case when doc_id%9=0 then g_end + 3 when doc_id%5=0 then g_start + 10 else gs end cut from t_piece p join t_strip s on p.ch=s.ch and (page_no-1)//4=seg where s.h % 4 <> 0 or page_no%4 = 1),
 n as (select ch, seg, cut, row_number() over (partition by ch, seg order by ord) ord from c)
select ch, seg, 'empty' kind, null::bigint cut from t_piece p where not exists (select 1 from n where n.ch=p.ch and n.seg=p.seg)
union all select n.ch, n.seg, 'out_of_range', cut from n join t_piece p on n.ch=p.ch and n.seg=p.seg where cut <= g_start or cut >= g_end
union all select ch, seg, 'duplicate', cut from n group by ch, seg, cut having count(*)>1
union all select ch, seg, 'not_ascending', cut from (select *, lag(cut) over (partition by ch, seg order by ord) p from n) z where cut <= p""")
def validate_cuts(spark, sf):
    p = S.piece(spark, sf)
    from pyspark.sql import Window as W
    s = S.strip(spark, sf).withColumn("seg", F.floor((F.col("page_no") - 1) / 4)).filter("h % 4 <> 0 or page_no % 4 = 1")
    c = s.join(p.select("ch", "seg", "g_start", "g_end"), ["ch", "seg"]).withColumn(
        "cut", F.when(F.col("doc_id") % 9 == 0, F.col("g_end") + 3).when(F.col("doc_id") % 5 == 0, F.col("g_start") + 10).otherwise(F.col("gs")))
    c = c.withColumn("ord", F.row_number().over(W.partitionBy("ch", "seg").orderBy("page_no")).cast("long"))  # four pages a piece
    return out(K.cut_errors(p, c.select("ch", "seg", "cut", "ord"), ["ch", "seg"]), "ch", "seg", "kind", "cut")


view("t_sel", "select ch, seg//6 grp, seg, g_start, g_end from t_piece where stage not in ('review','level4') or total%3=0")


def selection(spark, sf):
    return S.piece(spark, sf).filter("stage not in ('review', 'level4') or total % 3 = 0").select("ch", F.floor(F.col("seg") / 6).alias("grp"), "seg", "g_start", "g_end")


@query("merge_files_contiguous", """
select ch, grp, count(*) n, cast(0 as bigint) unknown, arg_min(g_start, seg) region_start, arg_max(g_end, seg) region_end, max(seg)-min(seg)+1=count(*) ok from t_sel group by all""")
def merge_files_contiguous(spark, sf):
    c = K.contiguous(selection(spark, sf).select("ch", "grp", "seg"), S.piece(spark, sf), ["ch", "grp"], ["ch"])
    return out(c, "ch", "grp", "n", "unknown", "region_start", "region_end", "ok")


view("t_ccut", """
with r as (select ch, grp, min(g_start) s, max(g_end) e from t_sel group by all), b as (select ch, grp, g_start cut from t_sel union select ch, grp, g_end from t_sel),
 i as (select b.* from b join r on b.ch=r.ch and b.grp=r.grp where cut > s and cut < e)
select *, null::varchar problem from i union all select ch, grp, null, 'no_internal_cut' from r where not exists (select 1 from i where i.ch=r.ch and i.grp=r.grp)
""")


@query("current_cuts", "select ch, grp, cut, problem from t_ccut")
def current_cuts(spark, sf):
    return out(K.current_cuts(selection(spark, sf), ["ch", "grp"]), "ch", "grp", "cut", "problem")


view("t_spliced", """
select ch, g_start, g_end, stage from t_piece where seg not in (1,2)
union all select ch, s, m, 'balance' from (select ch, min(g_start) s, max(g_end) e, (min(g_start)+max(g_end))//2 m from t_piece where seg in (1,2) group by ch) x
union all select ch, m, e, 'balance' from (select ch, min(g_start) s, max(g_end) e, (min(g_start)+max(g_end))//2 m from t_piece where seg in (1,2) group by ch) x
""")


def spliced(spark, sf):
    p = S.piece(spark, sf)
    rep = p.filter("seg in (1, 2)")
    r = rep.groupBy("ch").agg(F.min("g_start").alias("s"), F.max("g_end").alias("e")).withColumn("m", F.floor((F.col("s") + F.col("e")) / 2))
    prop = r.select("ch", F.explode(F.array(F.struct(F.col("s").alias("g_start"), F.col("m").alias("g_end")), F.struct(F.col("m").alias("g_start"), F.col("e").alias("g_end")))).alias("x")).select("ch", "x.*")
    return K.splice(p, rep, prop, ["ch"])


@query("splice_replace", "select * from t_spliced")
def splice_replace(spark, sf):
    return out(spliced(spark, sf), "ch", "g_start", "g_end", "stage")


COVER_SQL = """select ch, unnest(list_filter([case when g_start > c then 'gap' when g_start < c then 'overlap' end, case when g_end <= g_start then 'empty' end], lambda k: k is not null)) kind, c "at", g_start "next"
from (select *, coalesce(lag(g_end) over (partition by ch order by g_start, g_end), cast(0 as bigint)) c from {src}) x
union all select t.ch, 'incomplete', coalesce(l, 0), total from {tot} t left join (select ch, max(g_end) l from {src} group by ch) y on t.ch=y.ch where coalesce(l, 0) <> total"""


view("t_esel", "select ch, file, seg from (select ch, seg, case when seg=3 and total%5=0 then 'gone.png' else file end file from t_oout join (select ch, max(total) total from t_piece group by ch) x using (ch)) y where seg between 1 and 3 and not (seg=2 and ch like '%src1/%')")
view("t_eprop", """
select ch, concat('p-', ch) proposal_id, case when total%3=0 then 'p-other' else concat('p-', ch) end status_id, case when total%7=0 then 'EFETIVADO' else 'PROPOSTA_GERADA' end status, s + case when total%4=1 then 10 else 0 end region_start, case when total%31=0 then s else e end region_end, total
from (select ch, max(total) total, min(g_start) filter (seg between 1 and 3) s, max(g_end) filter (seg between 1 and 3) e from t_piece group by ch having count(*) filter (seg between 1 and 3) > 0) x""")
view("t_eart", """
select ch, case when i=2 and total%6=0 then 'out-0.png' when i=1 and total%10=0 then 'a/b.png' else concat('bal-', i, '.png') end file, region_start + w*i + case when i=1 and total%9=0 then 2 else 0 end g_start, case when i=2 then region_end else region_start + w*(i+1) end g_end,
 case when i=2 then region_end else region_start + w*(i+1) end - (region_start + w*i) height, not (i=0 and total%8=0) there from (select *, (region_end-region_start)//3 w, unnest([0,1,2]) i from t_eprop where total%12<>5) x""")
view("t_ecand", "select ch, file, g_start, g_end from t_oout where ch in (select ch from t_eprop) and (ch, seg) not in (select o.ch, o.seg from t_oout o join t_esel s on o.ch=s.ch and o.file=s.file) union all select ch, file, g_start, g_end from t_eart")


def effect_parts(spark, sf):
    """Proposals that put three pieces in place of the second to fourth output, with a fault of every kind somewhere."""
    m, o, _, _ = official_parts(spark, sf)
    t, sg, i, w = (F.col(c) for c in ("total", "seg", "i", "w"))
    p = S.piece(spark, sf)
    inside = sg.between(1, 3)
    r = p.groupBy("ch").agg(F.max("total").alias("total"), F.min(F.when(inside, F.col("g_start"))).alias("s"), F.max(F.when(inside, F.col("g_end"))).alias("e"), F.count_if(inside).alias("k")).filter("k > 0")
    name = F.concat(F.lit("p-"), "ch")
    prop = cut(r.select("ch", "total", name.alias("proposal_id"), F.when(t % 3 == 0, "p-other").otherwise(name).alias("status_id"), F.when(t % 7 == 0, "EFETIVADO").otherwise("PROPOSTA_GERADA").alias("status"),
                        (F.col("s") + F.when(t % 4 == 1, 10).otherwise(0)).alias("region_start"), F.when(t % 31 == 0, F.col("s")).otherwise(F.col("e")).alias("region_end")))
    tot = p.groupBy("ch").agg(F.max("total").alias("total"))
    sel = o.join(tot, "ch").filter(inside & ~((sg == 2) & F.col("ch").contains("src1/"))).select(
        "ch", F.when((sg == 3) & (t % 5 == 0), "gone.png").otherwise(F.col("file")).alias("file"))
    a = prop.filter(t % 12 != 5).withColumn("w", F.expr("(region_end - region_start) div 3")).withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    begin, end = F.col("region_start") + w * i, F.when(i == 2, F.col("region_end")).otherwise(F.col("region_start") + w * (i + 1))
    art = a.select("ch", F.when((i == 2) & (t % 6 == 0), "out-0.png").when((i == 1) & (t % 10 == 0), "a/b.png").otherwise(F.concat(F.lit("bal-"), i.cast("string"), F.lit(".png"))).alias("file"),
                   (begin + F.when((i == 1) & (t % 9 == 0), 2).otherwise(0)).alias("g_start"), end.alias("g_end"), (end - begin).alias("height"), (~((i == 0) & (t % 8 == 0))).alias("there"))
    man = m.select("ch", "source_total_height", F.when(F.col("source_total_height") % 37 == 0, 0).otherwise(700).alias("source_width"), "validation_ok")
    return prop.drop("total"), sel, cut(art), o, man


@query("effect_precheck", f"""
with k as (select s.ch, count(*) n, count(*) filter (o.seg is null) unknown, min(o.seg) a, max(o.seg) z, arg_min(o.g_start, o.seg) s, arg_max(o.g_end, o.seg) e from t_esel s left join t_oout o on s.ch=o.ch and s.file=o.file where s.ch in (select ch from t_eprop) group by s.ch),
 h as (select ch, count(*) arts from t_eart group by ch), mm as (select ch, source_total_height th, validation_ok vok from t_omani),
 p as (select t.*, n, unknown, a, z, s, e, arts, th, vok, unknown=0 and n>=2 sure from t_eprop t left join k using (ch) left join h using (ch) left join mm using (ch)),
 ac as (select ch, unnest(list_filter([case when g_start > c then 'gap' when g_start < c then 'overlap' end, case when g_end <= g_start then 'empty' end], lambda k: k is not null)) kind, c "at", g_start "next" from (
   select x.*, coalesce(lag(g_end) over (partition by x.ch order by g_start, g_end), region_start) c from t_eart x join t_eprop q on x.ch=q.ch) y
  union all select q.ch, 'incomplete', l, region_end from t_eprop q join (select ch, arg_max(g_end, g_start*1000000000000+g_end) l from t_eart group by ch) y on q.ch=y.ch where l<>region_end),
 cc as ({COVER_SQL.format(src='t_ecand', tot='(select ch, source_total_height total from t_omani where ch in (select ch from t_eprop))')})
select ch, unnest(list_filter([case when proposal_id<>status_id then 'id_differs' end, case when status<>'PROPOSTA_GERADA' then 'not_generated' end, case when region_end<=region_start then 'empty_region' end, case when coalesce(n,0)<2 then 'selection_too_small' end,
  case when unknown>0 then 'unknown_file' end, case when sure and z-a+1<>n then 'not_contiguous' end, case when sure and (s<>region_start or e<>region_end) then 'region_moved' end, case when arts is null then 'no_artifacts' end,
  case when th<=0 or th%37=0 or not vok then 'bad_manifest' end], lambda k: k is not null)) kind, region_start "at", region_end "next" from p
union all select ch, unnest(list_filter([case when trim(file)='' or contains(file,'/') or not there then 'artifact_missing' end, case when g_end<=g_start or height<>g_end-g_start then 'artifact_height' end], lambda k: k is not null)), g_start, g_end from t_eart
union all select ch, concat('artifact_', kind), "at", "next" from ac union all select ch, concat('candidate_', kind), "at", "next" from cc
union all select ch, 'repeated_name', max(g_start), count(*) from t_ecand group by ch, file having count(*) > 1""")
def effect_precheck(spark, sf):
    """A proposal takes effect only if it is the generated one, still fits the official composition, and the spliced composition covers the chapter."""
    return out(Q.effect_errors(*effect_parts(spark, sf)), "ch", "kind", "at", "next")


view("t_selreg", "select ch, min(seg) seg, arg_min(g_start, seg) r_start, arg_min(g_end, seg) r_end from t_piece where stage='review' and g_end>g_start group by ch")
view("t_manual", """select ch, r_start g_start, (r_start+r_end)//2 g_end from t_selreg union all select ch, (r_start+r_end)//2, r_end from t_selreg""")
view("t_cpieces", """select p.ch, p.g_start, p.g_end from t_piece p join t_selreg r on p.ch=r.ch where not (greatest(r_start,p.g_start) < least(r_end,p.g_end)) union all select ch, g_start, g_end from t_manual""")
view("t_ctot", "select c.ch, total from t_chapter c join t_selreg r on c.ch=r.ch")


@query("manual_candidate", f"""
select p.ch, 'pending_outside' kind, p.g_start "at", p.g_end "next" from t_piece p join t_selreg r on p.ch=r.ch where stage='review' and (p.g_start < r_start or p.g_end > r_end)
union all {COVER_SQL.format(src='t_cpieces', tot='t_ctot')}""")
def manual_candidate(spark, sf):
    rv = review(spark, sf)
    sel = rv.filter("g_end > g_start").groupBy("ch").agg(F.min_by("g_start", "seg").alias("r_start"), F.min_by("g_end", "seg").alias("r_end"))
    m = F.floor((F.col("r_start") + F.col("r_end")) / 2)
    man = sel.select("ch", F.explode(F.array(F.struct(F.col("r_start").alias("g_start"), m.alias("g_end")), F.struct(m.alias("g_start"), F.col("r_end").alias("g_end")))).alias("x")).select("ch", "x.*")
    return out(K.manual_candidate(S.piece(spark, sf), man, sel, rv, chapters(spark, sf)), "ch", "kind", "at", "next")


view("t_bpage", "select p.ch, seg, g_start b_start, g_end b_end, file, page_no, gs, ge from t_piece p join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge) where stage='review'")


@query("manual_range", """
with q as (select ch, seg, min(file) f, max(file) l from t_bpage group by all), r as (select ch, seg, f start_file, l end_file from q union all select ch, seg, l, f from q union all select ch, seg, f, 'page-missing.png' from q),
 j as (select r.*, a.page_no an, z.page_no zn, greatest(a.b_start,a.gs) rs, least(z.b_end,z.ge) re from r left join t_bpage a on r.ch=a.ch and r.seg=a.seg and r.start_file=a.file left join t_bpage z on r.ch=z.ch and r.seg=z.seg and r.end_file=z.file),
 k as (select *, case when an is null or zn is null then 'file_outside_block' when zn<an then 'end_before_start' when re<=rs then 'empty_region' end problem from j)
select ch, seg, start_file, end_file, problem, case when problem is null then zn-an+1 end page_count, case when problem is null then rs end region_start, case when problem is null then re end region_end from k""")
def manual_range(spark, sf):
    j = K.joined_pages(review(spark, sf), S.strip(spark, sf)).select("ch", "seg", F.col("g_start").alias("b_start"), F.col("g_end").alias("b_end"), "file", "page_no", "gs", "ge")
    q = j.groupBy("ch", "seg").agg(F.min("file").alias("f"), F.max("file").alias("l"))
    pair = lambda a, z: F.struct(a.alias("start_file"), z.alias("end_file"))
    f, z = F.col("f"), F.col("l")
    r = q.select("ch", "seg", F.explode(F.array(pair(f, z), pair(z, f), pair(f, F.lit("page-missing.png")))).alias("x")).select("ch", "seg", "x.*")
    return out(K.manual_range(r, j, ["ch", "seg"]), "ch", "seg", "start_file", "end_file", "problem", "page_count", "region_start", "region_end")


@query("review_pieces", """
with c as (select p.ch, p.seg, p.g_start, p.g_end, coalesce(list(cut order by cut) filter (cut is not null), cast([] as bigint[])) b from t_piece p left join t_icut i on p.ch=i.ch and p.seg=i.seg where stage='review' group by all),
 d as (select ch, seg, g_start, g_end, list_concat(list_concat([g_start], b), [g_end]) b, len(b)+1 - case when (seg+g_start)%5=0 then 1 else 0 end n from c)
select ch, seg, i-1 "index", b[i] "start", b[i+1] "end", concat('out-', i, '.png') as name, case when b[i+1] <= b[i] then 'empty_block' end problem
from (select *, unnest(generate_series(1, n)) i from d where n = len(b)-1) x""")
def review_pieces(spark, sf):
    p = review(spark, sf)
    c = inner_cuts(spark, sf, p).groupBy("ch", "seg").agg(F.array_sort(F.collect_list("cut")).alias("boundaries"))  # cuts of four pages
    r = p.join(c, ["ch", "seg"], "left").withColumn("boundaries", F.coalesce("boundaries", F.array().cast("array<bigint>")))
    n = F.size("boundaries") + 1 - F.when((F.col("seg") + F.col("g_start")) % 5 == 0, 1).otherwise(0)
    names = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("out-"), i.cast("string"), F.lit(".png")))).otherwise(F.array().cast("array<string>"))
    return out(K.review_pieces(r.withColumn("outputs", names), ["ch", "seg"]), "ch", "seg", "index", "start", "end", "name", "problem")


@query("stage_result_summary", """
with j as (select p.ch, file, g_start*10000+page_no o from t_piece p join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge) where stage='review'),
 f as (select ch, count(distinct file) pending_files, arg_min(file, o) first_file from j group by ch),
 r as (select ch, count(*) filter (stage='review') residuals, count(*) filter (stage<>'review') stage_files, cast(coalesce(sum(g_end-g_start) filter (stage='review'), 0) as bigint) residual_height from t_piece group by ch)
select r.ch, stage_files, residuals, residual_height, coalesce(pending_files, 0) pending_files, first_file, case when residuals > 0 then 'review' else 'done' end next_stage from r left join f on r.ch=f.ch""")
def stage_result_summary(spark, sf):
    j = K.joined_pages(review(spark, sf), S.strip(spark, sf)).withColumn("o", F.col("g_start") * 10000 + F.col("page_no"))
    seen = K.first_seen(j, ["ch"], "file", "o").groupBy("ch").agg(F.count(F.lit(1)).alias("pending_files"), F.min_by("file", "first_at").alias("first_file"))
    rv = F.col("stage") == "review"
    r = S.piece(spark, sf).groupBy("ch").agg(F.count_if(rv).alias("residuals"), F.count_if(~rv).alias("stage_files"),
                                             F.coalesce(F.sum(F.when(rv, F.col("g_end") - F.col("g_start"))), F.lit(0)).alias("residual_height"))
    return out(r.join(seen, "ch", "left"), "ch", "stage_files", "residuals", "residual_height", "first_file", pending_files=F.coalesce("pending_files", F.lit(0)),
               next_stage=F.when(F.col("residuals") > 0, "review").otherwise("done"))


@query("absorption_rate", """
with h as (select ch, stage, cast(sum(g_end-g_start) as bigint) height from t_piece group by all)
select h.ch, stage, height, round(height/total,6) share from h join t_chapter c on h.ch=c.ch
union all select null, stage, cast(sum(height) as bigint), round(sum(height)/(select sum(total) from t_chapter),6) from h group by stage""")
def absorption_rate(spark, sf):
    return out(K.absorption(S.piece(spark, sf), chapters(spark, sf)), "ch", "stage", "height", share=F.round("share", 6))


view("t_oout", """
select ch, seg, case when seg%97=5 then concat('../', seg, '.png') when seg%89=7 then '' when seg%83=9 then 'out-0.png' else concat('out-', seg, '.png') end file, g_start, g_end,
 case when g_start%101=0 then 699 when g_start%3=0 then null else 700 end width, g_end-g_start + case when g_start%103=0 then 1 else 0 end height from t_piece""")
view("t_omani", """
select ch, total%19<>0 readable, total, case when total%23=0 then null else n + case when total%11=0 then 1 else 0 end end merged_images, total + case when total%13=0 then 1 else 0 end source_total_height, total%5<>0 validation_ok,
 case when total%17=0 then 1 when total%2=0 then 0 end coverage_start, case when total%3=0 then total end coverage_end from (select ch, max(total) total, count(*) n from t_piece group by ch) x""")
view("t_oart", "select ch, file, case when g_end%109=0 then 701 when g_end%113=0 then null else 700 end width, g_end-g_start height from t_oout where g_end%107<>0")
view("t_opage", "select ch, page_no, case when page_no%23=0 and total%3=0 then 701 when page_no%19=0 and total%7=0 then null else 700 end width, case when page_no%17=0 and total%4=0 then 0 else h end height from t_strip")
view("t_ocover", f"""{COVER_SQL.format(src='t_oout', tot='(select ch, source_total_height total from t_omani)')}""")
HAVE = "from t_oout o left join (select ch c, file f, width aw, height ah, true there from t_oart) a on o.ch=a.c and o.file=a.f"
DEEP = f"""
with n as (select ch, count(*) n from t_oout group by ch), p as (select ch, count(*) filter (width is null or height is null) bad, count(*) filter (width<=0 or height<=0) emp, min(width) w, max(width) w2, sum(height) h from t_opage group by ch),
 m as (select t.*, n, bad, emp, w, w2, h, coalesce(coverage_start, 0) cs, coalesce(coverage_end, source_total_height) ce, case when merged_images > 0 then merged_images else n end d from t_omani t join n using (ch) left join p using (ch)),
 j as (select o.*, aw, ah, there, w {HAVE} join m on m.ch=o.ch)
select ch, unnest(list_filter([case when not readable then 'unreadable_manifest' end, case when d<=0 or d<>n then 'count_differs' end, case when source_total_height<=0 then 'no_total' end, case when cs<>0 then 'coverage_start' end,
  case when ce<>source_total_height then 'coverage_end' end, case when bad is null then 'no_pages' end, case when bad>0 then 'page_unreadable' end, case when emp>0 then 'page_empty' end, case when w<>w2 then 'page_widths_differ' end,
  case when h<>source_total_height then 'pages_differ_from_total' end], lambda k: k is not null)) kind, n "at", source_total_height "next" from m
union all select ch, unnest(list_filter([case when trim(file)='' then 'no_name' end, case when there is null then 'missing_file' end, case when coalesce(width, w)<>w then 'width_differs' end, case when height<>g_end-g_start then 'height_differs' end,
  case when there and coalesce(aw<>w or ah<>g_end-g_start, true) then 'image_differs' end], lambda k: k is not null)), g_start, g_end from j
union all select * from t_ocover"""
LIGHT_SQL = f"""
with n as (select ch, count(*) n from t_oout group by ch), m as (select t.*, n from t_omani t join n using (ch)), j as (select o.*, there {HAVE})
select ch, unnest(list_filter([case when not readable then 'unreadable_manifest' end, case when coalesce(merged_images, 0)<=0 or merged_images<>n then 'count_differs' end, case when source_total_height<=0 then 'no_total' end,
  case when coalesce(coverage_start, -1)<>0 then 'coverage_start' end, case when coalesce(coverage_end<>source_total_height, true) then 'coverage_end' end, case when not validation_ok then 'not_validated' end], lambda k: k is not null)) kind, n "at", source_total_height "next" from m
union all select ch, unnest(list_filter([case when trim(file)='' or contains(file, '/') then 'unsafe_name' end, case when there is null then 'missing_file' end], lambda k: k is not null)), g_start, g_end from j
union all select ch, 'repeated_name', max(g_start), count(*) from t_oout group by ch, file having count(*) > 1
union all select * from t_ocover"""


def official_parts(spark, sf):
    """Manifests, outputs, artifacts and pages of the official compositions; every check fails somewhere."""
    seg, s, e, t = (F.col(c) for c in ("seg", "g_start", "g_end", "total"))
    name = F.when(seg % 97 == 5, F.concat(F.lit("../"), seg.cast("string"), F.lit(".png"))).when(seg % 89 == 7, "").when(seg % 83 == 9, "out-0.png").otherwise(
        F.concat(F.lit("out-"), seg.cast("string"), F.lit(".png")))
    p = S.piece(spark, sf)
    o = cut(p.select("ch", "seg", name.alias("file"), "g_start", "g_end", F.when(s % 101 == 0, 699).when(s % 3 == 0, F.lit(None)).otherwise(700).alias("width"),
                     (e - s + F.when(s % 103 == 0, 1).otherwise(0)).alias("height")))
    m = p.groupBy("ch").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n")).select(
        "ch", (t % 19 != 0).alias("readable"), F.when(t % 23 != 0, F.col("n") + F.when(t % 11 == 0, 1).otherwise(0)).alias("merged_images"),
        (t + F.when(t % 13 == 0, 1).otherwise(0)).alias("source_total_height"), (t % 5 != 0).alias("validation_ok"),
        F.when(t % 17 == 0, 1).when(t % 2 == 0, 0).alias("coverage_start"), F.when(t % 3 == 0, t).alias("coverage_end"))
    a = o.filter(e % 107 != 0).select("ch", "file", F.when(e % 109 == 0, 701).when(e % 113 == 0, F.lit(None)).otherwise(700).alias("width"), (e - s).alias("height"))
    k = F.col("page_no")
    g = S.strip(spark, sf).select("ch", "page_no", F.when((k % 23 == 0) & (t % 3 == 0), 701).when((k % 19 == 0) & (t % 7 == 0), F.lit(None)).otherwise(700).alias("width"),
                                  F.when((k % 17 == 0) & (t % 4 == 0), 0).otherwise(F.col("h")).alias("height"))
    return cut(m), o, a, g


@query("official_errors", DEEP)
def official_errors(spark, sf):
    m, o, a, g = official_parts(spark, sf)
    return out(Q.official_errors(m, o, a, g), "ch", "kind", "at", "next")


@query("official_errors_light", LIGHT_SQL)
def official_errors_light(spark, sf):
    m, o, a, _ = official_parts(spark, sf)
    return out(Q.official_errors(m, o, a), "ch", "kind", "at", "next")


@query("official_valid", f"with e as ({DEEP}) select c.ch, count(kind) errors, count(kind)=0 valid from t_chapter c left join e on c.ch=e.ch group by c.ch")
def official_valid(spark, sf):
    """Deep check of official compositions; valid means no error row."""
    m, o, a, g = official_parts(spark, sf)
    n = Q.official_errors(m, o, a, g).groupBy("ch").agg(F.count(F.lit(1)).alias("errors"))
    j = chapters(spark, sf).join(n, "ch", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return out(j, "ch", "errors", valid=F.col("errors") == 0)


@query("review_approve_check", """
with b as (select ch, seg, count(*)+1 bounds from t_icut group by all), o as (select ch, seg, count(*) outputs from t_icut where height >= 20 group by all)
select p.ch, p.seg, coalesce(bounds,1)+1 bounds, coalesce(outputs,0)+1 outputs, coalesce(bounds,1)+1 = coalesce(outputs,0)+2 ok,
 case when g_end-g_start <= 0 then 'empty_region' when coalesce(bounds,1)+1 <> coalesce(outputs,0)+2 then 'bounds_do_not_fit_outputs' end problem
from t_piece p left join b on p.ch=b.ch and p.seg=b.seg left join o on p.ch=o.ch and p.seg=o.seg where stage='review'""")
def review_approve_check(spark, sf):
    """An approval needs one bound more than outputs and no empty region."""
    c = inner_cuts(spark, sf).groupBy("ch", "seg").agg((F.count(F.lit(1)) + 1).alias("b"), F.count_if(F.col("height") >= 20).alias("o"))
    j = review(spark, sf).join(c, ["ch", "seg"], "left").withColumns({
        "bounds": F.coalesce("b", F.lit(1)) + 1, "outputs": F.coalesce("o", F.lit(0)) + 1})
    fit = F.col("bounds") == F.col("outputs") + 1
    return out(j, "ch", "seg", "bounds", "outputs", ok=fit, problem=F.when(F.col("g_end") <= F.col("g_start"), "empty_region").when(~fit, "bounds_do_not_fit_outputs"))


view("t_appr", """
select source ch, 700 + case when source in ('src1','src7') and doc_id%5=0 then 1 else 0 end width, n_chars height, row_number() over (partition by source order by doc_id) - 1 i from documents
""")


@query("review_approve_images", """
with s as (select ch, count(*) n, min(width) <> max(width) wide from t_appr where ch <> 'src3' group by ch), m as (select ch, count(*) + case when ch='src9' then 0 else 1 end m from t_appr group by ch)
select m.ch, case when m.ch='src2' then 'scope_not_supported' when n is null then 'no_images' when m <> n + 1 then 'bounds_do_not_fit_outputs' when wide then 'widths_differ' when m.ch='src5' then 'height_differs_from_bounds' end problem
from m left join s on s.ch=m.ch""")
def review_approve_images(spark, sf):
    """Proposals of one image per document of a source; scopes, widths, heights and bounds are wrong in some."""
    from stripline.operators.blocks import range_blocks, running

    ch = F.col("ch")
    d = S.table(spark, sf, "documents").select(F.col("source").alias("ch"), "doc_id", F.col("n_chars").alias("height"))
    d = d.withColumns({"width": F.lit(700) + F.when(ch.isin("src1", "src7") & (F.col("doc_id") % 5 == 0), 1).otherwise(0), "step": F.col("height") + F.when(ch == "src5", 3).otherwise(0)})
    a = cut(running(range_blocks(d, ["ch"], ["doc_id"]), ["ch"], ["doc_id"], sums={"y": "step"}, number="k", totals={"all": "step"}).withColumn("i", F.col("k") - 1))
    last = a.filter("ch <> 'src9'").groupBy("ch").agg(F.max("k").alias("i"), F.max("all").alias("y"))
    p = a.select("ch").distinct().withColumn("scope", F.when(ch == "src2", "regions").when(ch == "src4", "pending_segments"))
    return out(K.approval_problems(p, a.filter("ch <> 'src3'"), a.select("ch", "i", "y").unionByName(last), ["ch"]), "ch", "problem")
