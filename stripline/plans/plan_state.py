"""Lineage and state queries."""

from pyspark.sql import functions as F

from stripline.operators import lineage as N
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view

view("t_wide", """
select c.ch, c.total, c.total%9=0 merge_ok, c.total%13=0 legacy, l2.sha s2, l2.total_height t2, l2.residual_n n2, l3.sha s3, l3.total_height t3, l3.residual_n n3,
 l4.sha s4, l4.total_height t4, l4.residual_n n4, l5.sha s5, l5.total_height t5, l5.residual_n n5,
 case when l2.ch is null then 'missing' when l2.total_height<>c.total then 'total_mismatch' else 'ok' end p2,
 case when l3.ch is null then 'missing' when l2.ch is null then 'missing_upstream' when l3.total_height<>l2.total_height then 'total_mismatch' when l3.upstream_sha<>l2.sha then 'stale' else 'ok' end p3,
 case when l4.ch is null then 'missing' when l3.ch is null then 'missing_upstream' when l4.total_height<>l3.total_height then 'total_mismatch' when l4.upstream_sha<>l3.sha then 'stale' else 'ok' end p4,
 case when l5.ch is null then 'missing' when l4.ch is null then 'missing_upstream' when l5.total_height<>l4.total_height then 'total_mismatch' when l5.upstream_sha<>l4.sha then 'stale' else 'ok' end p5
from t_chapter c left join t_manifest l2 on c.ch=l2.ch and l2.lvl=2 left join t_manifest l3 on c.ch=l3.ch and l3.lvl=3 left join t_manifest l4 on c.ch=l4.ch and l4.lvl=4 left join t_manifest l5 on c.ch=l5.ch and l5.lvl=5
""")
view("t_auth", """
select ch, case when p2<>'ok' then 'historical' when s3 is null and n2>0 then 'level3_pending' when s3 is null then 'level2' when p3 in ('total_mismatch','stale') then 'level3' when n3=0 then 'level3' when s4 is null then 'level3'
  when p4 in ('total_mismatch','stale') then 'level4' when n4=0 then 'level4' when legacy then 'legacy_level4' when s5 is null then 'level4' when p5 in ('total_mismatch','stale') then 'level5' else 'level5' end source,
 case when p2<>'ok' or s3 is null or p3 in ('total_mismatch','stale') or n3=0 then null when s4 is null then n3 when p4 in ('total_mismatch','stale') or n4=0 then null when legacy or s5 is null then n4
  when p5 in ('total_mismatch','stale') or n5=0 then null else n5 end pending,
 case when p2<>'ok' then null when s3 is null and n2>0 then 'level3_not_validated' when s3 is null then null when p3 in ('total_mismatch','stale') then concat('level3_', p3) when n3=0 or s4 is null then null
  when p4 in ('total_mismatch','stale') then concat('level4_', p4) when n4=0 or legacy or s5 is null then null when p5 in ('total_mismatch','stale') then concat('level5_', p5) end error
from t_wide
""")
view("t_flags", """
select *, case when merge_ok then 'concluido' when level3_pending then 'pendente_level3' when level4_pending then 'pendente_level4' when level5_pending then 'pendente_level5' when needs_review then 'pendente_review'
  when s2 is not null or validated_without_pending then 'parcial' else 'novo' end merge_state
from (select *, not merge_ok and not validated_without_pending and (s2 is null or (level2_validated and ((v5 and coalesce(n5>0,false)) or (legacy and v4 and coalesce(n4>0,false))))) needs_review
 from (select *, not merge_ok failed, p2='ok' level2_validated, p2='ok' and not coalesce(n2>0,false) validated_without_pending, not merge_ok and p2='ok' and coalesce(n2>0,false) and not v3 level3_pending,
   not merge_ok and v3 and coalesce(n3>0,false) and not v4 level4_pending, not merge_ok and v4 and coalesce(n4>0,false) and not legacy and not v5 level5_pending
  from (select *, p2='ok' and p3='ok' v3, p2='ok' and p3='ok' and p4='ok' v4, p2='ok' and p3='ok' and p4='ok' and p5='ok' v5 from t_wide) a) b) c
""")


def wide(spark, sf):
    c = S.chapter(spark, sf).select("ch", "total", (F.col("total") % 9 == 0).alias("merge_ok"), (F.col("total") % 13 == 0).alias("legacy"))
    return N.by_level(c, S.manifest(spark, sf))


def states(spark, sf):
    return N.state_rows(wide(spark, sf))


@query("manifest_snapshot", """
select c.ch, l.lvl, m.ch is not null present, sha, total_height from t_chapter c join (select unnest([2,3,4,5])::bigint lvl) l on true left join t_manifest m on m.ch=c.ch and m.lvl=l.lvl""")
def manifest_snapshot(spark, sf):
    return out(N.manifest_snapshot(S.chapter(spark, sf), S.manifest(spark, sf)), "ch", "lvl", "present", "sha", "total_height")


@query("manifest_lineage", " union all ".join(
    f"select ch, {n}::bigint lvl, p{n} link, {' and '.join(f'p{k}=' + repr('ok') for k in range(2, n + 1))} chain_ok from t_wide where p{n}<>'missing'" for n in (2, 3, 4, 5)))
def manifest_lineage(spark, sf):
    return out(N.lineage(wide(spark, sf)), "ch", "lvl", "link", "chain_ok")


@query("authoritative_pending", "select ch, source, case when pending=0 then null else pending end pending, error from t_auth")
def authoritative_pending(spark, sf):
    w = wide(spark, sf).withColumn("a", N.authority())
    return out(w, "ch", source=F.col("a.source"), pending=F.nullif(F.col("a.pending"), F.lit(0)), error=F.col("a.error"))


FLAGS = "ch merge_state failed level2_validated level3_pending level4_pending level5_pending needs_review".split()


@query("state_rows", f"select {', '.join('f.' + c for c in FLAGS)}, pages, f.total%6=0 pdf from t_flags f join t_chapter c on f.ch=c.ch")
def state_rows(spark, sf):
    pdf = S.chapter(spark, sf).filter("total % 6 = 0").select("ch", F.lit(True).alias("pdf"))
    j = states(spark, sf).join(S.chapter(spark, sf).select("ch", "pages"), "ch", "left").join(pdf, "ch", "left")
    return out(j, *FLAGS, "pages", pdf=F.coalesce("pdf", F.lit(False)))


@query("merge_state", "select ch, merge_state from t_flags")
def merge_state(spark, sf):
    return out(states(spark, sf), "ch", "merge_state")


@query("level2_validated", "select ch, level2_validated, validated_without_pending from t_flags")
def level2_validated(spark, sf):
    return out(states(spark, sf), "ch", "level2_validated", "validated_without_pending")


@query("stage_detail", " union all ".join(
    f"select f.ch, {n}::bigint lvl, n{n} residual, a.source='level{n}' and a.pending is not null authoritative, merge_ok and n{n}=0 finalised from t_flags f join t_auth a on f.ch=a.ch where n{n} is not null" for n in (2, 3, 4, 5)))
def stage_detail(spark, sf):
    return out(N.stage_detail(states(spark, sf)), "ch", "lvl", "residual", "authoritative", "finalised")


@query("work_summary", """
select count(*) chapters, count(*) filter (merge_ok) merges, count(*) filter (merge_state='pendente_review') pending, count(*) filter (merge_state='novo') "new", count(*) filter (merge_state='parcial') "partial",
 count(*) filter (level3_pending) level3_pending, count(*) filter (level4_pending) level4_pending, count(*) filter (level5_pending) level5_pending, count(*) filter (failed) merge_failed, count(*) filter (needs_review) review_pending from t_flags""")
def work_summary(spark, sf):
    return N.work_summary(states(spark, sf))


view("t_man", """
select ch, case when not inside then 'outside_review' when s5 is not null and not v5 then 'blocked' when s5 is not null and n5>0 then 'pending' when s5 is not null then 'resolved'
  when old and n4>0 then 'pending' when old then 'resolved' else 'blocked' end status, case when not inside then null when s5 is not null then 'level5' when old then 'legacy_level4' else 'review' end source
from (select *, needs_review or merge_state='pendente_review' inside, legacy and s4 is not null and p4='ok' old from t_flags) x
""")


@query("manual_state", "select * from t_man")
def manual_state(spark, sf):
    return out(N.manual_state(states(spark, sf)), "ch", "status", "source")


@query("manual_summary", """select count(*) total, count(*) filter (status='pending') pending, count(*) filter (status='resolved') resolved, count(*) filter (status='blocked') blocked from t_man""")
def manual_summary(spark, sf):
    return N.manual_summary(N.manual_state(states(spark, sf)))


@query("catalog", "select source provider, lang work, count(*) pages from documents group by all")
def catalog(spark, sf):
    """Works of every provider in natural order."""
    from stripline.functions.names import natural_key
    d = S.table(spark, sf, "documents").groupBy(F.col("source").alias("provider"), F.col("lang").alias("work")).agg(F.count(F.lit(1)).alias("pages"))
    return d.orderBy(natural_key("provider"), natural_key("work"))


@query("chapter_select", """
with c as (select ch, row_number() over (order by ch) n from t_chapter), p as (select unnest(string_split('1,3,9-5,78-200', ',')) x),
 r as (select cast(split_part(x,'-',1) as bigint) a, cast(case when contains(x,'-') then split_part(x,'-',2) else x end as bigint) b from p)
select distinct n as ordinal, ch from c join r on n between least(a,b) and greatest(a,b)""")
def chapter_select(spark, sf):
    """Chapters picked by a list such as ``1,3,9-5``; reversed ranges are turned and everything is clipped to the total."""
    from stripline.operators.blocks import range_blocks, running
    ordered = running(range_blocks(S.chapter(spark, sf).select(F.lit(1).alias("one"), "ch"), ["one"], ["ch"]), ["one"], ["ch"], number="ordinal")
    part = F.explode(F.split(F.lit("1,3,9-5,78-200"), ","))
    picks = spark.range(1).select(part.alias("x")).withColumns({"a": F.split_part("x", F.lit("-"), F.lit(1)).cast("long"), "b": F.split_part("x", F.lit("-"), F.lit(-1)).cast("long")})
    picks = picks.select(F.explode(F.sequence(F.least("a", "b"), F.greatest("a", "b"))).alias("ordinal")).distinct()
    return out(ordered.join(picks, "ordinal", "left_semi"), "ordinal", "ch")
