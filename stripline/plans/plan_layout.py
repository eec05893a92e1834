"""Layout queries."""

from pyspark.sql import functions as F

from stripline.operators import layout as L
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view


@query("page_spans", """
select ch, file, page_index, global_start, global_end, width_error from (
 select ch, file, row_number() over w page_index, cast(coalesce(sum(height) over (w rows between unbounded preceding and 1 preceding),0) as bigint) global_start,
  cast(sum(height) over w as bigint) global_end, width <> first_value(width) over w width_error
 from t_dim where width is not null window w as (partition by ch order by p_partkey)) p""")
def page_spans(spark, sf):
    d = S.dim(spark, sf).filter("width is not null")
    return out(L.page_spans(d, order="p_partkey"), "ch", "file", "page_index", "global_start", "global_end", "width_error")


view("t_point", """
select ch, center y, kind from t_band union all select ch, total, 'past_end' from t_chapter
""")


def points(spark, sf):
    b = S.band(spark, sf).select("ch", F.col("center").alias("y"), "kind")
    return b.unionByName(S.chapter(spark, sf).select("ch", F.col("total").alias("y"), F.lit("past_end").alias("kind")))


@query("page_at_y", """
select p.ch, p.y, p.kind, s.file, case when p.y >= s.total then s.h else p.y - s.gs end local_y
from t_point p join t_strip s on s.ch = p.ch and ((s.gs <= p.y and p.y < s.ge) or (p.y >= s.total and s.ge = s.total and s.h > 0))""")
def page_at_y(spark, sf):
    return out(L.page_at_y(points(spark, sf), S.strip(spark, sf), "y"), "ch", "y", "kind", "file", "local_y")


@query("source_spans", """
select p.ch, seg, stage, file, greatest(g_start,gs) global_start, least(g_end,ge) global_end, greatest(g_start,gs)-gs local_start, least(g_end,ge)-gs local_end
from t_piece p join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge)""")
def source_spans(spark, sf):
    j = L.source_spans(S.piece(spark, sf), S.strip(spark, sf), ("g_start", "g_end"))
    return out(j, "ch", "seg", "stage", "file", "global_start", "global_end", "local_start", "local_end")


@query("segment_sources", """
select p.ch, seg, count(s.file) source_count from t_piece p left join t_strip s on p.ch=s.ch and g_end > gs and g_start < ge and gs < ge group by all""")
def segment_sources(spark, sf):
    j = L.segment_sources(S.piece(spark, sf), S.strip(spark, sf), ["ch", "seg"], ("g_start", "g_end"))
    return out(j, "ch", "seg", "source_count")


@query("region_view", """
select p.ch, seg, kind, center - g_start center, greatest(g_start,b_start)-g_start view_start, least(g_end,b_end)-g_start view_end
from t_piece p join t_band b on p.ch=b.ch and greatest(g_start,b_start) < least(g_end,b_end) where stage='review'""")
def region_view(spark, sf):
    r = S.piece(spark, sf).filter("stage = 'review'").drop("total")
    j = L.region_view(r, S.band(spark, sf).drop("total"), ("g_start", "g_end"), ("b_start", "b_end"))
    return out(j, "ch", "seg", "kind", "view_start", "view_end", center=F.col("center") - F.col("g_start"))


@query("globalize_items", """
with item as (select p.ch, seg, kind, g_start origin, center - g_start local from t_piece p join t_band b on p.ch=b.ch and center >= g_start and center < g_end where stage='review')
select i.ch, seg, kind, origin+local global_y, file, origin+local-gs local_y from item i join t_strip s on i.ch=s.ch and gs <= origin+local and origin+local < ge""")
def globalize_items(spark, sf):
    from stripline.operators.blocks import point_join
    r = S.piece(spark, sf).filter("stage = 'review'").select("ch", "seg", "g_start", "g_end")
    items = point_join(S.band(spark, sf).select("ch", "kind", "center"), r, ["ch"], "center", ("g_start", "g_end"))
    items = items.select("ch", "seg", "kind", F.col("g_start").alias("origin"), (F.col("center") - F.col("g_start")).alias("local"))
    return out(L.globalize(items, S.strip(spark, sf), "origin", "local"), "ch", "seg", "kind", "global_y", "file", "local_y")


@query("pending_blocks", """
select p.ch, seg, arg_min(file, page_no) first_file, arg_max(file, page_no) last_file, count(file) n_pages,
 cast(sum(least(g_end,ge)-greatest(g_start,gs)) as bigint) height, case when count(file)=0 then 'no_page_matches_block' end problem
from t_piece p left join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge) where stage='review' group by all""")
def pending_blocks(spark, sf):
    p = S.piece(spark, sf).filter("stage = 'review'")
    j = L.pending_blocks(p, S.strip(spark, sf), ["ch", "seg"], ("g_start", "g_end"))
    return out(j, "ch", "seg", "first_file", "last_file", "n_pages", "height", "problem")


@query("context_window_sources", """
with f as (select p.ch, seg, g_start, g_end, min(page_no) first_no from t_piece p join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge) group by all)
select f.ch, seg, file, gs < g_end and ge > g_start included from f join t_strip s on f.ch=s.ch and page_no between first_no and first_no+7""")
def context_window_sources(spark, sf):
    p = S.piece(spark, sf).select("ch", "seg", "g_start", "g_end")
    return out(L.context_window(p, S.strip(spark, sf), 8, ("g_start", "g_end")), "ch", "seg", "file", "included")


view("t_named", """
select ch, seg, g_start, g_end, concat('page-', format('{:03d}', a), case when a<>b then concat('-', format('{:03d}', b)) else '' end, '.png') as name from (
 select p.ch, seg, g_start, g_end, min(page_no) a, max(page_no) b
 from t_piece p join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge) group by all) x
""")


@query("page_range_name", "select ch, seg, name from t_named")
def page_range_name(spark, sf):
    p = S.piece(spark, sf)
    return out(L.name_outputs(p, S.strip(spark, sf), ["ch", "seg"], ("g_start", "g_end")), "ch", "seg", "name")


@query("name_collision", """
with n as (select ch, seg, g_start, g_end, concat('page-', format('{:03d}', a), case when a<>b then concat('-', format('{:03d}', b)) else '' end, '.png') as name from (
 select p.ch, seg, g_start, g_end, min(page_no) a, max(page_no) b
 from t_halved p join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge) group by all) x)
select ch, seg, name, count(*) over (partition by ch, name) > 1 collides,
 case when count(*) over (partition by ch, name) > 1 then concat(replace(name,'.png',''), '__y-', cast(g_start as varchar), '-', cast(g_end as varchar), '.png') else name end unique_name from n""")
def name_collision(spark, sf):
    mid = F.floor((F.col("g_start") + F.col("g_end")) / 2)
    p = S.piece(spark, sf).filter("g_end - g_start > 1").withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    p = p.select("ch", (F.col("seg") * 2 + F.col("half")).alias("seg"),
                 F.when(F.col("half") == 0, F.col("g_start")).otherwise(mid).alias("g_start"),
                 F.when(F.col("half") == 0, mid).otherwise(F.col("g_end")).alias("g_end"))
    n = L.name_outputs(p, S.strip(spark, sf), ["ch", "seg"], ("g_start", "g_end"))
    return out(L.resolve_collisions(n, ("g_start", "g_end")), "ch", "seg", "name", "collides", "unique_name")


@query("evenly_spaced_sample", """
with n as (select ch, max(page_no) n, least(6, max(page_no)) c from t_strip group by ch),
i as (select distinct ch, cast(case when c=1 then 0 else round_even(i*(n-1)/(c-1.0), 0) end as bigint)+1 page_no from (select *, unnest(generate_series(0, c-1)) i from n) x)
select s.ch, s.page_no, s.file from t_strip s join i on s.ch=i.ch and s.page_no=i.page_no""")
def evenly_spaced_sample(spark, sf):
    return out(L.evenly_spaced(S.strip(spark, sf), 6, "page_no"), "ch", "page_no", "file")


@query("stack_crops", """
select p.ch, seg, md5(string_agg(substr(text, greatest(g_start,gs)-gs+1, least(g_end,ge)-greatest(g_start,gs)), '' order by gs)) content_md5, count(*) n_slices
from t_piece p join t_strip s on p.ch=s.ch and greatest(g_start,gs) < least(g_end,ge) join documents d on s.doc_id=d.doc_id group by p.ch, seg""")
def stack_crops(spark, sf):
    pages = S.strip(spark, sf).withColumnRenamed("file", "name").withColumnRenamed("doc_id", "file")
    spans = L.source_spans(S.piece(spark, sf).select("ch", "seg", "g_start", "g_end"), pages, ("g_start", "g_end"))
    text = S.table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")
    cut = spans.join(text, "file").withColumn("part", F.substr("text", (F.col("local_start") + 1).cast("int"), (F.col("local_end") - F.col("local_start")).cast("int")))
    s = L.stack_slices(cut.select("ch", "seg", "global_start", "part"), ["ch", "seg"], "part")
    return out(s, "ch", "seg", "n_slices", content_md5=F.md5("content"))


for _name, _cols in {
    "strip": "ch file page_no doc_id h gs ge total", "band": "ch kind b_start b_end height center ratio std", "dim": "ch file width height dpi",
    "profile": "ch y page white_ratio std delta s1 s2 edges", "evidence": "ch y y_path band_std edge_density crossing_components diagonal_crossings text_fx_clusters text_fx_background_std",
    "piece": "ch seg stage g_start g_end total", "manifest": "ch lvl total_height sha upstream_sha residual_n", "box": "id page role_ x1 y1 x2 y2 conf brightness texture bright_ratio",
    "file": "doc_id rel size hash in_dest dest_hash", "log": "event_id ts chapter request_id event state", "seq": "chapter page_no expected in_progress bad_marker",
    "feat": "ch page_no h gs ge f1 f2 f3 f4 f5 f6", "json": "chapter version body", "error": "ch file issue_type msg",
}.items():
    def _table(spark, sf, _n=_name, _c=_cols):
        return out({"json": S.json_body}.get(_n, getattr(S, _n, None))(spark, sf), *_c.split())
    query(f"table_{_name}", f"select {', '.join(_cols.split())} from t_{_name}")(_table)
