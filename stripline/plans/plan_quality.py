"""Size, sequence, PDF and balance queries."""

from pyspark.sql import functions as F

from stripline.functions.rules import scene_guard
from stripline.operators import quality as Q
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view

view("t_hist", "select ch, width, count(*) n from t_dim where width is not null group by all")
view("t_dominant", "select ch, width dominant, n uses from (select *, row_number() over (partition by ch order by n desc, width) r from t_hist) x where r=1")
view("t_class", """
select d.*, dominant, abs(width-dominant) difference_px, round(abs(width-dominant)/dominant*100.0,3) difference_percent,
 case when width is null then null when width=dominant then 'PADRAO' when abs(width-dominant)/dominant*100.0<=3 then 'DENTRO_TOLERANCIA' else 'EXCECAO_DIMENSAO' end class
from t_dim d join t_dominant m on d.ch=m.ch
""")
view("t_dimsum", """
select ch, count(width) image_count, min(width) min_width, max(width) max_width, max(dominant) dominant, round(max(dominant)*3.0::double/100.0,2) tolerance_px,
 count(*) filter (class in ('PADRAO','DENTRO_TOLERANCIA')) within_, count(*) filter (class='EXCECAO_DIMENSAO') exceptions, count(*) filter (width is null) unreadable,
 case when count(width)=0 then 'SEM_IMAGENS_VALIDAS' when count(*) filter (class='EXCECAO_DIMENSAO')=0 and count(*) filter (width is null)=0 then 'OK' else 'REQUER_ANALISE' end status
from t_class group by ch
""")


@query("dominant_value", "select ch, dominant, uses from t_dominant")
def dominant_value(spark, sf):
    return out(Q.dominant_width(S.dim(spark, sf)), "ch", "dominant", "uses")


@query("width_histogram", "select ch, width, n from t_hist")
def width_histogram(spark, sf):
    return out(Q.width_histogram(S.dim(spark, sf)), "ch", "width", "n")


@query("dim_classify", "select ch, file, width, dominant, difference_px, difference_percent, class from t_class")
def dim_classify(spark, sf):
    return out(Q.classified(S.dim(spark, sf)), "ch", "file", "width", "dominant", "difference_px", "difference_percent", "class")


SUM_COLS = "ch image_count min_width max_width dominant tolerance_px exceptions unreadable status".split()


@query("dim_chapter_summary", f"select {', '.join(SUM_COLS)}, within_ from t_dimsum")
def dim_chapter_summary(spark, sf):
    return out(Q.chapter_summary(S.dim(spark, sf)), *SUM_COLS, within_=F.col("within"))


@query("dim_run_summary", """select count(*) chapters_analyzed, count(*) filter (status='OK') chapters_ok, count(*) filter (status='REQUER_ANALISE') chapters_requiring_analysis from t_dimsum""")
def dim_run_summary(spark, sf):
    return Q.run_summary(Q.chapter_summary(S.dim(spark, sf)))


@query("upsert_current", """
with old as (select p_brand ch, count(*) image_count, 'OLD' status from part group by 1 union all select 'removed/'||r_name, 0, 'OLD' from region),
 new as (select ch, image_count, status from t_dimsum where dominant=700)
select * from old where ch not in (select ch from new) union all select * from new""")
def upsert_current(spark, sf):
    old = S.table(spark, sf, "part").groupBy(F.col("p_brand").alias("ch")).agg(F.count(F.lit(1)).alias("image_count")).withColumn("status", F.lit("OLD"))
    gone = S.table(spark, sf, "region").select(F.concat(F.lit("removed/"), "r_name").alias("ch"), F.lit(0).cast("long").alias("image_count"), F.lit("OLD").alias("status"))
    new = Q.chapter_summary(S.dim(spark, sf)).filter("dominant = 700").select("ch", "image_count", "status")
    return Q.upsert_current(old.unionByName(gone), new)


@query("resize_plan", """
with x as (select ch, file, width, height, dominant, greatest(1, cast(round_even(height*(dominant/width),0) as bigint)) target_height,
 replace(file,'.png','_old.png') backup, p_partkey%19=0 blocked from t_class where class='EXCECAO_DIMENSAO')
select *, bool_or(blocked) over (partition by ch) chapter_blocked from x""")
def resize_plan(spark, sf):
    p = Q.resize_plan(S.dim(spark, sf), F.col("p_partkey") % 19 == 0)
    return out(p, "ch", "file", "width", "height", "dominant", "target_height", "backup", "blocked", "chapter_blocked")


@query("render_report_text", """
with w as (select ch, string_agg(concat('''', width, ''': ', n), ', ' order by width) widths from t_hist group by ch)
select s.ch, u.section, u.line, '' item from t_dimsum s join w on s.ch=w.ch, lateral (select unnest(range(7)) section, unnest([
 concat('CAPÍTULO ', s.ch, ' — ', status), concat('Imagens: ', image_count), concat('Largura dominante: ', dominant, 'px'),
 concat('Faixa observada: ', min_width, 'px – ', max_width, 'px'), concat('Tolerância em pixels: ±', tolerance_px, 'px'),
 concat('Distribuição: {', widths, '}'), concat('Dentro do padrão/tolerância: ', within_, ' · Exceções: ', exceptions)]) line) u
union all select ch, 7, printf('  %-24s %dx%d · diferença %dpx (%.3f%%)', file, width, height, difference_px, difference_percent), file from t_class where class='EXCECAO_DIMENSAO'""")
def render_report_text(spark, sf):
    return out(Q.report_lines(S.dim(spark, sf)), "ch", "section", "line", "item")


@query("pdf_limits", """
with d as (select ch, file, width*72.0/coalesce(nullif(dpi,0.0),96.0) pdf_width, height*72.0/coalesce(nullif(dpi,0.0),96.0) pdf_height from t_dim where width is not null)
select *, pdf_width between 3 and 14400 and pdf_height between 3 and 14400 pdf_ok from d""")
def pdf_limits(spark, sf):
    return out(Q.pdf_limits(S.dim(spark, sf)), "ch", "file", "pdf_width", "pdf_height", "pdf_ok")


view("t_gap", """
select chapter, missing from (select chapter, unnest(generate_series(1, max(page_no))) missing from t_seq group by chapter) g
where not exists (select 1 from t_seq s where s.chapter=g.chapter and s.page_no=g.missing)
""")
view("t_total", "select chapter, count(*) found, max(expected) expected, count(*)<>max(expected) mismatch, bool_or(in_progress) in_progress, bool_or(bad_marker) bad_marker from t_seq group by chapter")


@query("sequence_gap", "select chapter, missing from t_gap")
def sequence_gap(spark, sf):
    return out(Q.sequence_gaps(S.seq(spark, sf), ["chapter"]), "chapter", "missing")


def limited(spark, sf):
    """Sequences whose expectation counts one page more in some chapters."""
    return S.seq(spark, sf).withColumn("expected", F.col("expected") + F.when(F.col("chapter") % 5 == 0, 1).otherwise(0))


@query("expected_total_check", """
select chapter, found, expected + case when chapter%5=0 then 1 else 0 end expected, chapter%5=0 or mismatch mismatch from t_total""")
def expected_total_check(spark, sf):
    return out(Q.total_check(limited(spark, sf), ["chapter"], "expected"), "chapter", "found", "expected", "mismatch")


view("t_cherr", """
select chapter, 1 ord, 0 item, concat('Total de imagens divergente: esperado ', expected+1, ', encontrado ', found, '.') error from t_total where chapter%5=0
union all select chapter, 2, missing, printf('Sequência de páginas incompleta: faltando page-%03d.', missing) from t_gap
""")


@query("chapter_validation", "select chapter, cast(ord as bigint) ord, item::bigint item, error from t_cherr")
def chapter_validation(spark, sf):
    return out(Q.chapter_errors(limited(spark, sf), ["chapter"], "expected"), "chapter", "ord", "item", "error")


def imaged(spark, sf):
    """Chapters, some of them without images, and images with a problem where they can't be read."""
    d = S.dim(spark, sf).withColumns({"problem": F.lit("cannot identify image file"), "format": F.lit("PNG"), "mode": F.lit("RGB")})
    empty = S.table(spark, sf, "nation").select(F.col("n_name").alias("ch"))
    return d.select("ch").distinct().unionByName(empty), d


view("t_imgerr", f"""
select n_name ch, 0 ord, '' file, '{Q.NO_IMAGES}' error from nation
union all select ch, 3, file, printf('{Q.UNREADABLE}', file, 'cannot identify image file') from t_dim where width is null
union all select ch, 3, file, printf('{Q.OUTSIDE}', file, width, height, 'PNG', 'RGB', w, h) from (
 select *, width*72.0/coalesce(nullif(dpi,0.0),96.0) w, height*72.0/coalesce(nullif(dpi,0.0),96.0) h from t_dim where width is not null) x where not (w between 3 and 14400 and h between 3 and 14400)
""")


@query("chapter_image_errors", "select ch, ord::bigint ord, file, error from t_imgerr")
def chapter_image_errors(spark, sf):
    return out(Q.image_errors(*imaged(spark, sf)), "ch", "ord", "file", "error")


@query("chapter_validation_result", """
select c.ch, count(e.ch) n_errors, count(e.ch)=0 ok from (select distinct ch from t_dim union all select n_name from nation) c left join t_imgerr e on e.ch=c.ch group by c.ch""")
def chapter_validation_result(spark, sf):
    chapters, images = imaged(spark, sf)
    return out(Q.validation_result(chapters, Q.image_errors(chapters, images)), "ch", "n_errors", "ok")


def routed(spark, sf):
    p = limited(spark, sf)
    n = Q.chapter_errors(p, ["chapter"], "expected").groupBy("chapter").agg(F.count(F.lit(1)).alias("n_errors"))
    c = p.groupBy("chapter").agg(F.max("in_progress").alias("in_progress"), F.max("bad_marker").alias("bad_marker"))
    return Q.batch_route(c.join(n, "chapter", "left").withColumns({
        "n_errors": F.coalesce("n_errors", F.lit(0)), "pdf_exists": F.col("chapter") % 23 == 0}))


view("t_route", """
select t.chapter, case when t.chapter%23=0 then 'skipped' when in_progress then 'download_not_completed' when bad_marker then 'download_state_invalid'
 when e.chapter is not null then 'image_validation_failed' else 'generated' end route
from t_total t left join (select distinct chapter from t_cherr) e on t.chapter=e.chapter
""")


@query("pdf_batch_route", "select chapter, route from t_route")
def pdf_batch_route(spark, sf):
    return out(routed(spark, sf), "chapter", "route")


@query("batch_summary", """select count(*) selected, count(*) filter (route='generated' and chapter%7<>0) generated, count(*) filter (route='skipped') skipped,
 count(*) filter (route not in ('generated','skipped')) validation_failed, count(*) filter (route='generated' and chapter%7=0) generation_failed from t_route""")
def batch_summary(spark, sf):
    return Q.batch_summary(routed(spark, sf).withColumn("broke", F.col("chapter") % 7 == 0), "broke")


view("t_bal", """
select ch, seg, height, round((p+n)/2.0::double,2) neighbor_mean, round(height/((p+n)/2.0::double),4) ratio from (
 select ch, seg, g_end-g_start height, lag(g_end-g_start) over w p, lead(g_end-g_start) over w n from t_piece window w as (partition by ch order by seg)) x
where height>0 and p>0 and n>0 and height/((p+n)/2.0::double) < 0.5
""")


def heights(spark, sf):
    return S.piece(spark, sf).withColumn("height", F.col("g_end") - F.col("g_start"))


@query("neighbor_balance", "select * from t_bal")
def neighbor_balance(spark, sf):
    return out(Q.neighbor_balance(heights(spark, sf)), "ch", "seg", "height", "neighbor_mean", "ratio")


@query("balance_summary", """
select count(*) chapters, count(*) filter (bad) unbalanced, count(*) filter (not bad) balanced from (select ch, ch in (select ch from t_bal) bad from (select distinct ch from t_piece) c) x""")
def balance_summary(spark, sf):
    return Q.balance_summary(heights(spark, sf))


@query("scene_guard", """select ch, seg, case when g_end-g_start > 3000 then 'INCONCLUSIVE' end decision, case when g_end-g_start > 3000 then 'continuous_scene_too_long' end reason from t_piece""")
def guard(spark, sf):
    r = scene_guard(F.col("height"))
    return out(heights(spark, sf), "ch", "seg", reason=r, decision=F.when(r.isNotNull(), "INCONCLUSIVE"))
