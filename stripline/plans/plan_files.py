"""File, export and manifest queries."""

from pyspark.sql import functions as F

from stripline.functions import names as M
from stripline.operators import export as X
from stripline.operators import lineage as N
from stripline.operators.blocks import top_k
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view
from stripline.sources import manifests as J

c = F.col
ACTIVE = "lower(rel) similar to '.*[.](png|jpg|jpeg|webp)' and not lower(rel) similar to '.*_old[.][a-z]+'"
EXPORTED = "not regexp_matches(rel, '(?i)([.]json|_mask[.]png)$')"


@query("active_filter", f"select rel from t_file where {ACTIVE}")
def active_filter(spark, sf):
    return out(S.file(spark, sf).filter(M.is_active_page("rel")), "rel")


@query("export_exclude", f"select rel from t_file where {EXPORTED}")
def export_exclude(spark, sf):
    return out(S.file(spark, sf).filter(M.is_exported("rel")), "rel")


view("t_plan", f"""
select rel, ch, size, hash, case when not in_dest then 'new' when dest_hash=hash then 'identical' else 'conflict' end status from t_file where {EXPORTED}
""")


def plan(spark, sf):
    f = S.file(spark, sf)
    dest = f.filter("in_dest").select("rel", c("size").alias("d_size"), c("dest_hash").alias("d_hash"))
    return X.export_plan(f.select("rel", "ch", "size", "hash"), dest)


@query("export_plan", "select rel, size, status from t_plan")
def export_plan(spark, sf):
    return out(plan(spark, sf), "rel", "size", "status")


@query("export_summary", """
select *, new_files>0 and conflicts=0 can_export, new_files=0 and conflicts=0 and identical_files>0 already_exported from (
 select ch, count(*) files, sum(size)::bigint bytes, count(*) filter (status='new') new_files, count(*) filter (status='identical') identical_files, count(*) filter (status='conflict') conflicts from t_plan group by ch) x""")
def export_summary(spark, sf):
    return X.export_summary(plan(spark, sf), ["ch"])


@query("export_copy", """
with bad as (select distinct ch from t_plan where status='conflict') select rel, size, hash from t_plan where status='new' and ch not in (select ch from bad)""")
def export_copy(spark, sf):
    """The new files of chapters without a conflict, copied to a fresh table and read back from there."""
    import uuid

    from stripline.session import cut, shared_dir
    p = plan(spark, sf)
    p = cut(p.join(p.filter("status = 'conflict'").select("ch").distinct(), "ch", "left_anti"))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    X.export_copy(p, p.select("rel", F.col("hash").alias("content")), path)
    return out(spark.read.parquet(path), "rel", "size", "hash")


@query("plan_signature_diff", f"""
with a as (select rel, size, status from t_plan), b as (select rel, size + case when doc_id%31=0 then 1 else 0 end size, case when not in_dest then 'new' when dest_hash=hash then 'identical' else 'conflict' end status from t_file where {EXPORTED})
select rel, size, status, 'left' side from (select * from a except select * from b) union all select rel, size, status, 'right' from (select * from b except select * from a)""")
def plan_signature_diff(spark, sf):
    f = S.file(spark, sf).withColumn("size", c("size") + F.when(c("doc_id") % 31 == 0, 1).otherwise(0))
    dest = f.filter("in_dest").select("rel", c("size").alias("d_size"), c("dest_hash").alias("d_hash"))
    now = X.export_plan(f.select("rel", "size", "hash"), dest)
    d = X.set_difference(plan(spark, sf), now, ["rel", "size", "status"])
    return out(d, "rel", "size", "status", "side")


@query("plan_tree_diff", """
with b as (select doc_id, rel, size + case when doc_id%197=0 then 1 else 0 end size, hash from t_file where doc_id%311<>5), a as (select doc_id, rel, size, hash from t_file)
select *, 'left' side from (select * from a except select * from b) union all select *, 'right' from (select * from b except select * from a)""")
def plan_tree_diff(spark, sf):
    """Files of two plans that differ, found by comparing their hash trees from the top."""
    from stripline.operators.lineage import tree_diff

    f = S.file(spark, sf).select("doc_id", "rel", "size", "hash")
    now = f.filter("doc_id % 311 <> 5").withColumn("size", c("size") + F.when(c("doc_id") % 197 == 0, 1).otherwise(0))
    return out(tree_diff(f, now, [], "doc_id", ["rel", "size", "hash"], fan=16), "doc_id", "rel", "size", "hash", "side")


@query("source_staleness", "select rel, case when not in_dest then 'missing' else 'changed' end problem from t_file where not in_dest or dest_hash<>hash")
def source_staleness(spark, sf):
    f = S.file(spark, sf)
    return out(X.stale_sources(f.select("rel", "hash"), f.filter("in_dest").select("rel", c("dest_hash").alias("hash"))), "rel", "problem")


@query("staging_matches_manifest", "select rel, case when in_dest then 'right' else 'left' end side from t_file where doc_id%3=0 and doc_id%2=0 or (in_dest and doc_id%29=0)")
def staging_matches_manifest(spark, sf):
    """Names in the manifest only (left) or in staging only (right)."""
    f = S.file(spark, sf)
    listed = f.filter("not (in_dest and doc_id % 29 = 0)").select("rel")
    staged = f.filter("in_dest or doc_id % 2 = 1").select("rel")
    return out(X.set_difference(listed, staged, ["rel"]), "rel", "side")


@query("artifact_completeness", """
select doc_id, case when doc_id%7=0 then 0 when doc_id%11=0 then 2 else 1 end::bigint n_clean, case when doc_id%5=0 then 0 else 1 end::bigint n_mask from documents where doc_id%7=0 or doc_id%11=0 or doc_id%5=0""")
def artifact_completeness(spark, sf):
    k = c("doc_id")
    d = S.table(spark, sf, "documents").select("doc_id")
    clean = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 11 == 0, F.array(F.lit("clean"), F.lit("clean"))).otherwise(F.array(F.lit("clean")))
    mask = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("mask")))
    outputs = d.select("doc_id", F.explode(F.concat(clean, mask)).alias("kind"))
    return out(X.completeness(d, outputs, "doc_id"), "doc_id", "n_clean", "n_mask")


@query("page_number", "select rel, try_cast(nullif(regexp_extract(string_split(rel,'/')[3], '(?i)^page-(\\d+)', 1),'') as bigint) number from t_file")
def page_number(spark, sf):
    return out(S.file(spark, sf), "rel", number=M.page_number(F.regexp_extract("rel", r"([^/]*)$", 1)))


@query("natural_sort", "select rel, row_number() over (order by cast(regexp_extract(rel,'src(\\d+)',1) as bigint), string_split(rel,'/')[2], doc_id, rel) pos from t_file")
def natural_sort(spark, sf):
    """Global natural order with positions: a range exchange on the key, then counts per range."""
    from stripline.operators.blocks import range_blocks, running
    f = S.file(spark, sf).select(F.lit(1).alias("one"), "rel", M.natural_key("rel").alias("k"))
    return out(running(range_blocks(f, ["one"], ["k", "rel"]), ["one"], ["k", "rel"], number="pos"), "rel", "pos")


@query("chapter_sort_numeric", """
with x as (select distinct case when doc_id%4=0 then concat('Extra ', source) when doc_id%4=1 then cast(doc_id/2 as varchar) else cast(doc_id as varchar) end chapter, lang stage from documents)
select chapter, stage, row_number() over (order by try_cast(chapter as double) is null, coalesce(try_cast(chapter as double), 0), lower(chapter), stage) pos from x""")
def chapter_sort_numeric(spark, sf):
    from stripline.operators.blocks import range_blocks, running
    k = c("doc_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("Extra "), "source")).when(k % 4 == 1, (k / 2).cast("string")).otherwise(k.cast("string"))
    x = S.table(spark, sf, "documents").select(name.alias("chapter"), c("lang").alias("stage")).distinct()
    num = F.expr("try_cast(chapter as double)")
    x = x.select(F.lit(1).alias("one"), "chapter", "stage", num.isNull().alias("a"), F.coalesce(num, F.lit(0.0)).alias("b"), F.lower("chapter").alias("d"))
    order = ["a", "b", "d", "stage"]
    return out(running(range_blocks(x, ["one"], order), ["one"], order, number="pos"), "chapter", "stage", "pos")


@query("safe_name_check", """
with n as (select doc_id, case doc_id%6 when 0 then concat('../', source, '.png') when 1 then '' when 2 then concat(source, '.jpg') when 3 then '..' when 4 then concat(lang, '\\', source, '.png') else concat(source, '-', cast(doc_id as varchar), '.png') end as name from documents)
select doc_id, doc_id%6=5 ok from n""")
def safe_name_check(spark, sf):
    k = c("doc_id")
    s = lambda *p: F.concat(*p)
    name = (F.when(k % 6 == 0, s(F.lit("../"), "source", F.lit(".png"))).when(k % 6 == 1, "").when(k % 6 == 2, s("source", F.lit(".jpg"))).when(k % 6 == 3, "..")
            .when(k % 6 == 4, s("lang", F.lit("\\"), "source", F.lit(".png"))).otherwise(s("source", F.lit("-"), k.cast("string"), F.lit(".png"))))
    return out(S.table(spark, sf, "documents"), "doc_id", ok=M.is_safe_png(name))


@query("list_artifacts", """
with a as (select doc_id, case doc_id%3 when 0 then concat('merged-', format('{:03d}', doc_id), '.png') when 1 then concat('page-', format('{:03d}', doc_id), '-', format('{:03d}', doc_id+2), '.png') else concat('page-', format('{:03d}', doc_id), '.txt') end as name from documents)
select name, case when name like 'page-%' then 0 else 1 end::bigint scheme, doc_id "first", case when name like 'page-%' then doc_id+2 else 0 end "last" from a where name like '%.png'""")
def list_artifacts(spark, sf):
    """Artifacts under the two naming schemes, the page-range scheme first, then by numbers."""
    k = c("doc_id")
    name = (F.when(k % 3 == 0, F.concat(F.lit("merged-"), M.zero_pad(k), F.lit(".png"))).when(k % 3 == 1, M.page_range_name(k, k + 2))
            .otherwise(F.concat(F.lit("page-"), M.zero_pad(k), F.lit(".txt"))))
    d = S.table(spark, sf, "documents").select(name.alias("name")).filter(c("name").rlike(r"(?i)^(page-\d+(-\d+)?|merged-\d+)\.png$"))
    is_range = c("name").startswith("page-")
    a = F.regexp_extract("name", r"-(\d+)", 1).cast("long")
    b = F.nullif(F.regexp_extract("name", r"-\d+-(\d+)", 1), F.lit("")).cast("long")
    d = d.withColumns({"scheme": F.when(is_range, 0).otherwise(1), "first": a, "last": F.when(is_range, F.coalesce(b, a)).otherwise(0)})
    return out(d.orderBy("scheme", "first", "last", "name"), "name", "scheme", "first", "last")


@query("file_hash", "select doc_id, sha256(text) sha256 from documents")
def file_hash(spark, sf):
    return out(S.table(spark, sf, "documents"), "doc_id", sha256=F.sha2("text", 256))


TREE = """
with r as (select ch, page_no p, sha256(concat_ws('|', file, cast(h as varchar), cast(gs as varchar), cast({ge} as varchar))) h from t_strip),
 a as (select ch, p//1024 p, sha256(string_agg(h, '' order by p)) h from r group by ch, p//1024), b as (select ch, p//1024 p, sha256(string_agg(h, '' order by p)) h from a group by ch, p//1024),
 d as (select ch, p//1024 p, sha256(string_agg(h, '' order by p)) h from b group by ch, p//1024)
select ch, sha256(string_agg(h, '' order by p)) fingerprint from d group by ch"""


@query("fingerprint", TREE.format(ge="ge"))
def fingerprint(spark, sf):
    return N.fingerprint(S.strip(spark, sf), ["ch"], "page_no", ["file", "h", "gs", "ge"])


@query("review_fingerprint", f"""
with s as ({TREE.format(ge="ge")}), n as ({TREE.format(ge="case when total%5=0 and page_no=2 then ge+1 else ge end")})
select s.ch, s.fingerprint, n.fingerprint<>s.fingerprint stale from s join n on s.ch=n.ch""")
def review_fingerprint(spark, sf):
    """Stored against current fingerprints: unequal ones make a review stale."""
    s = S.strip(spark, sf)
    cols = ["file", "h", "gs", "ge"]
    now = s.withColumn("ge", F.when((c("total") % 5 == 0) & (c("page_no") == 2), c("ge") + 1).otherwise(c("ge")))
    j = N.fingerprint(s, ["ch"], "page_no", cols).join(N.fingerprint(now, ["ch"], "page_no", cols, name="current"), "ch")
    return out(j, "ch", "fingerprint", stale=c("current") != c("fingerprint"))


view("t_parsed", """
select *, case when json_valid(body) then body ->> '$.algorithm' end algorithm, case when json_valid(body) then body ->> '$.status' end status, case when json_valid(body) then (body ->> '$.integrity_ok')='true' end integrity_ok,
 case when json_valid(body) then body ->> '$.source_stage' end source_stage, case when json_valid(body) then cast(json_extract(body,'$.sources') as varchar[]) end sources, case when json_valid(body) then cast(json_extract(body,'$.cleans') as varchar[]) end cleans from t_json
""")


def parsed(spark, sf):
    p = J.parse(S.json_body(spark, sf))
    return p.select("chapter", "version", "body", c("m").isNotNull().alias("ok"), "m.*")


@query("read_manifest", """
select chapter, version, case when algorithm is null then 'invalid_json' when algorithm<>'clean_v2' then 'unsupported_algorithm' end reject, status from t_parsed""")
def read_manifest(spark, sf):
    ok, bad = J.read_manifest(S.json_body(spark, sf), ["clean_v2"])
    cols = ["chapter", "version"]
    st = c("m.status").alias("status")
    return out(ok.select(*cols, F.lit(None).cast("string").alias("reject"), st).unionByName(bad.select(*cols, "reject", st)), "chapter", "version", "reject", "status")


@query("read_reports_permissive", """
select chapter, version, coalesce(status, 'invalid_report') issue_type, case when algorithm is null then 'Relatório inválido ou ilegível.' end message from t_parsed""")
def read_reports_permissive(spark, sf):
    return out(J.read_reports(S.json_body(spark, sf)), "chapter", "version", "issue_type", "message")


@query("latest_version", "select chapter, max(version) version, arg_max(status, version) status from t_parsed where status in ('PROPOSTA_GERADA','EFETIVADO') group by chapter")
def latest_version(spark, sf):
    p = parsed(spark, sf).filter(c("status").isin("PROPOSTA_GERADA", "EFETIVADO"))
    return p.groupBy("chapter").agg(F.max("version").alias("version"), F.max_by("status", "version").alias("status"))


view("t_gatej", "select * from t_parsed where algorithm='clean_v2' and integrity_ok and source_stage in ('ORIGINAL','MERGED') and len(sources)>0 and len(sources)=len(cleans)")


def gate(spark, sf):
    p = parsed(spark, sf)
    return p.filter((c("algorithm") == "clean_v2") & c("integrity_ok") & c("source_stage").isin("ORIGINAL", "MERGED") & (F.size("sources") > 0) & (F.size("sources") == F.size("cleans")))


@query("manifest_gate", "select chapter, version, source_stage from t_gatej")
def manifest_gate(spark, sf):
    return out(gate(spark, sf), "chapter", "version", "source_stage")


view("t_pairs", "select chapter, version, source_stage, i pos, sources[i+1] source_file, cleans[i+1] clean_file from (select *, unnest(generate_series(0, len(sources)-1)) i from t_gatej) x")


def pairs(spark, sf):
    z = gate(spark, sf).select("chapter", "version", "source_stage", F.posexplode(F.arrays_zip("sources", "cleans")).alias("pos", "p"))
    return z.select("chapter", "version", "source_stage", "pos", c("p.sources").alias("source_file"), c("p.cleans").alias("clean_file"))


@query("pair_in_manifest", """
with q as (select conv_id chapter, turn version, concat('page-', turn, '.png') s, concat('page-', turn + case when turn%3=2 then 1 else 0 end, '_clean.png') k from conversations)
select q.chapter, q.version, s, k, p.pos is not null paired from q left join t_pairs p on p.chapter=q.chapter and p.version=q.version and source_file=s and clean_file=k""")
def pair_in_manifest(spark, sf):
    t = c("turn")
    q = S.table(spark, sf, "conversations").select(c("conv_id").alias("chapter"), t.alias("version"), F.concat(F.lit("page-"), t.cast("string"), F.lit(".png")).alias("s"),
                                                   F.concat(F.lit("page-"), (t + F.when(t % 3 == 2, 1).otherwise(0)).cast("string"), F.lit("_clean.png")).alias("k"))
    p = pairs(spark, sf).select("chapter", "version", c("source_file").alias("s"), c("clean_file").alias("k"), F.lit(True).alias("hit"))
    return out(q.join(p, ["chapter", "version", "s", "k"], "left"), "chapter", "version", "s", "k", paired=F.coalesce("hit", F.lit(False)))


def stage_name(x):
    u = F.upper(F.trim(x))
    return F.when(u == "MERGED", "MERGE").when(u.isin("MERGE", "ORIGINAL"), u)


@query("stage_normalize", """
select doc_id, case u when 'MERGED' then 'MERGE' when 'MERGE' then 'MERGE' when 'ORIGINAL' then 'ORIGINAL' end stage, u not in ('MERGED','MERGE','ORIGINAL') invalid
from (select doc_id, upper(case doc_id%4 when 0 then 'merged' when 1 then 'Original' when 2 then 'MERGE' else lang end) u from documents) x""")
def stage_normalize(spark, sf):
    k = c("doc_id") % 4
    raw = F.when(k == 0, "merged").when(k == 1, "Original").when(k == 2, "MERGE").otherwise(c("lang"))
    s = stage_name(raw)
    return out(S.table(spark, sf, "documents"), "doc_id", stage=s, invalid=s.isNull())


@query("textoff_rows", """
select chapter, source_stage, version, count(*) pages, count(*) filter (pos=0 and version%3=0) pending from t_pairs group by all""")
def textoff_rows(spark, sf):
    """Manifests of both stages as rows with page counts and pending pages."""
    p = pairs(spark, sf)
    both = p.filter("source_stage = 'ORIGINAL'").unionByName(p.filter("source_stage = 'MERGED'"))
    pend = p.filter("pos = 0 and version % 3 = 0").select("chapter", "version", "source_file", F.lit(1).alias("flag"))
    j = both.join(pend, ["chapter", "version", "source_file"], "left")
    return j.groupBy("chapter", "source_stage", "version").agg(F.count(F.lit(1)).alias("pages"), F.count("flag").alias("pending"))


view("t_pend", "select chapter, version, source_file, clean_file, source_stage from t_pairs where pos=0")


@query("textoff_queue", """
select distinct chapter, version, source_file, clean_file from t_pend p where exists (select 1 from t_seq s where s.chapter=p.chapter and s.page_no=p.version+1) and exists (select 1 from t_pairs q where q.chapter=p.chapter and q.version=p.version and q.pos=1)""")
def textoff_queue(spark, sf):
    """Pending pages whose source and clean files exist."""
    p = pairs(spark, sf)
    sources = S.seq(spark, sf).select("chapter", (c("page_no") - 1).alias("version"))
    cleans = p.filter("pos = 1").select("chapter", "version")
    return out(p.filter("pos = 0").join(sources, ["chapter", "version"], "left_semi").join(cleans, ["chapter", "version"], "left_semi"), "chapter", "version", "source_file", "clean_file")


@query("upsert_pending", """
with old as (select chapter, source_stage, source_file, 'CONCLUIDO' status, version created from t_pairs where version%2=0 and pos=0), new as (select chapter, source_stage, source_file, version at_ from t_pairs where version%3=0 and pos=0)
select coalesce(o.chapter,n.chapter) chapter, coalesce(o.source_stage,n.source_stage) source_stage, coalesce(o.source_file,n.source_file) source_file,
 case when n.chapter is not null then 'PENDENTE' else status end status, coalesce(created, at_) created_at, coalesce(at_+100, created) updated_at
from old o full join new n on o.chapter=n.chapter and o.source_stage=n.source_stage and o.source_file=n.source_file""")
def upsert_pending(spark, sf):
    p = pairs(spark, sf).filter("pos = 0")
    key = ["chapter", "source_stage", "source_file"]
    old = p.filter("version % 2 = 0").select(*key, F.lit("CONCLUIDO").alias("status"), c("version").alias("created"))
    new = p.filter("version % 3 = 0").select(*key, c("version").alias("at"))
    j = old.join(new, key, "full")
    return out(j, *key, status=F.when(c("at").isNotNull(), "PENDENTE").otherwise(c("status")), created_at=F.coalesce("created", "at"), updated_at=F.coalesce(c("at") + 100, c("created")))


@query("idempotent_apply", """
with a as (select distinct chapter, version from t_parsed where status='EFETIVADO') select p.chapter, p.version, case when a.version is not null then 'noop' when p.status is null then 'invalid' else 'apply' end action
from t_parsed p left join a on a.chapter=p.chapter and a.version=p.version+1""")
def idempotent_apply(spark, sf):
    """A proposal applied already (the next version says so) is a no-op."""
    p = parsed(spark, sf)
    done = p.filter("status = 'EFETIVADO'").select("chapter", (c("version") - 1).alias("version")).distinct().withColumn("done", F.lit(True))
    j = p.join(done, ["chapter", "version"], "left")
    return out(j, "chapter", "version", action=F.when(c("done"), "noop").when(c("status").isNull(), "invalid").otherwise("apply"))


view("t_corr", """
select doc_id id, concat('p-', doc_id) want_proposal_id, source want_chapter, case when doc_id%3=0 then 'MERGE' else 'IMG' end want_source_stage, concat('page-', doc_id, '.png') want_source_file, concat('clean-', doc_id, '.png') want_clean_file,
 case when doc_id%41=0 then null when doc_id%43=0 then 'clean-x.png' else concat('clean-', doc_id, '.png') end pending_clean, doc_id%47<>0 readable, doc_id%53<>0 schema_ok, case when doc_id%11=0 then 'EFETIVADO' else 'PREVIA' end status,
 case when doc_id%13=0 then null else concat('p-', doc_id) end proposal_id, case when doc_id%17=0 then 'src99' else source end chapter, case when doc_id%19=0 then 'IMG' when doc_id%3=0 then 'MERGE' else 'IMG' end source_stage,
 concat('page-', doc_id + case when doc_id%23=0 then 1 else 0 end, '.png') source_file, concat('clean-', doc_id + case when doc_id%29=0 then 1 else 0 end, '.png') clean_file,
 case when doc_id%31=0 then null when doc_id%7=0 then md5('old') else md5(concat('clean-', doc_id)) end base_sha256, case when doc_id%9=0 then md5('old') else md5(concat('page-', doc_id)) end source_sha256,
 case when doc_id%37=0 then '../preview.png' else concat('preview-', doc_id, '.png') end preview_file, n_chars from documents""")
view("t_corrimg", """
select concat(k, '-', doc_id, '.png') file, md5(concat(k, '-', doc_id)) sha, 700 + case when k='preview' and doc_id%10=0 then 1 else 0 end w, n_chars + case when k='page' and doc_id%15=0 then 2 else 0 end h
from documents, (values ('page'), ('clean'), ('preview')) t(k) where not (k='preview' and doc_id%21=0) and not (k='clean' and doc_id%26=0)""")


@query("correction_precheck", """
with j as (select t.*, c.file cf, c.sha cs, c.w cw, c.h ch, s.file sf, s.sha ss, s.w sw, s.h sh, p.file pf, p.w pw, p.h ph from t_corr t left join t_corrimg c on want_clean_file=c.file left join t_corrimg s on want_source_file=s.file left join t_corrimg p on preview_file=p.file)
select id, unnest(list_filter([case when not (readable and schema_ok) then 'invalid_schema' end, case when status<>'PREVIA' then 'not_available' end, case when proposal_id is distinct from want_proposal_id then 'proposal_id_differs' end,
 case when chapter<>want_chapter then 'chapter_differs' end, case when source_stage<>want_source_stage then 'source_stage_differs' end, case when source_file<>want_source_file then 'source_file_differs' end, case when clean_file<>want_clean_file then 'clean_file_differs' end,
 case when pending_clean is distinct from want_clean_file then 'not_pending' end, case when coalesce(base_sha256<>cs, true) then 'base_changed' end, case when coalesce(source_sha256<>ss, true) then 'source_changed' end, case when contains(preview_file, '/') or pf is null then 'no_preview' end,
 case when pf is not null and cf is not null and (pw<>cw or ph<>ch) then 'preview_size' end, case when want_source_stage='MERGE' and pf is not null and sf is not null and (pw<>sw or ph<>sh) then 'merge_size' end], lambda k: k is not null)) kind from j""")
def correction_precheck(spark, sf):
    """Corrections of cleaned pages, one per document, against the pending list and the images of today."""
    from stripline.operators.official import correction_errors

    k, d = c("doc_id"), S.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    name = lambda kind, n=k, end=".png": F.concat(F.lit(f"{kind}-"), n.cast("string"), F.lit(end))
    stage = F.when(k % 3 == 0, "MERGE").otherwise("IMG")
    want = d.select(k.alias("id"), name("p", end="").alias("want_proposal_id"), c("source").alias("want_chapter"), stage.alias("want_source_stage"), name("page").alias("want_source_file"), name("clean").alias("want_clean_file"),
                    F.when(k % 41 == 0, F.lit(None)).when(k % 43 == 0, "clean-x.png").otherwise(name("clean")).alias("pending_clean"))
    one = lambda n: k + F.when(k % n == 0, 1).otherwise(0)
    old = F.md5(F.lit("old").cast("binary"))
    sha = lambda kind: F.md5(name(kind, end="").cast("binary"))
    prop = d.select(
        k.alias("id"), (k % 47 != 0).alias("readable"), (k % 53 != 0).alias("schema_ok"), F.when(k % 11 == 0, "EFETIVADO").otherwise("PREVIA").alias("status"), F.when(k % 13 != 0, name("p", end="")).alias("proposal_id"),
        F.when(k % 17 == 0, "src99").otherwise(c("source")).alias("chapter"), F.when(k % 19 == 0, "IMG").otherwise(stage).alias("source_stage"), name("page", one(23)).alias("source_file"), name("clean", one(29)).alias("clean_file"),
        F.when(k % 31 == 0, F.lit(None)).when(k % 7 == 0, old).otherwise(sha("clean")).alias("base_sha256"), F.when(k % 9 == 0, old).otherwise(sha("page")).alias("source_sha256"),
        F.when(k % 37 == 0, "../preview.png").otherwise(name("preview")).alias("preview_file"))
    kinds = d.withColumn("k", F.explode(F.array(*map(F.lit, ("page", "clean", "preview"))))).filter(~((c("k") == "preview") & (k % 21 == 0)) & ~((c("k") == "clean") & (k % 26 == 0)))
    stem = F.concat(c("k"), F.lit("-"), k.cast("string"))
    images = kinds.select(F.concat(stem, F.lit(".png")).alias("file"), F.md5(stem.cast("binary")).alias("sha256"), (700 + F.when((c("k") == "preview") & (k % 10 == 0), 1).otherwise(0)).alias("width"),
                          (c("n_chars") + F.when((c("k") == "page") & (k % 15 == 0), 2).otherwise(0)).alias("height"))
    return out(correction_errors(prop, want, images, ["id"]), "id", "kind")


PDF = "case when page_id%17=0 then '' else concat(case when page_id%13=0 then 'PDF' else '%PDF-1.4 ' end, '<< /Type /Pages >> ', replace(replace(html, '<p>', '<< /Type /Page >>'), '<p ', '<< /Type/Page ')) end"


@query("scan_pdf_pages", f"""
select page_id, starts_with(b, '%PDF') header_ok, len(regexp_extract_all(b, '/Type\\s*/Page')) - len(regexp_extract_all(b, '/Type\\s*/Pages')) pages, length(b)=0 is_empty from (select page_id, {PDF} b from pages) x""")
def scan_pdf_pages(spark, sf):
    """Page objects of documents made from the web pages, a page object for each paragraph; some are empty or lack the header."""
    from stripline.sources.pages import object_pages

    body = F.replace(F.replace(c("html"), F.lit("<p>"), F.lit("<< /Type /Page >>")), F.lit("<p "), F.lit("<< /Type/Page "))
    head = F.when(c("page_id") % 13 == 0, "PDF").otherwise("%PDF-1.4 ")
    pdf = F.when(c("page_id") % 17 == 0, "").otherwise(F.concat(head, F.lit("<< /Type /Pages >> "), body))
    return out(object_pages(S.table(spark, sf, "pages").select("page_id", pdf.cast("binary").alias("content"))), "page_id", "header_ok", "pages", "is_empty")


@query("bad_pages_from_errors", "select ch, regexp_extract(msg, 'page-\\d+\\.[A-Za-z0-9]+') page, count(*) messages from t_error group by all")
def bad_pages_from_errors(spark, sf):
    e = S.error(spark, sf).select("ch", F.explode(F.regexp_extract_all("msg", F.lit(r"(?i)(page-\d+\.[a-z0-9]+)"), F.lit(1))).alias("page"))
    return e.groupBy("ch", "page").agg(F.count(F.lit(1)).alias("messages"))


view("t_report", """
select c.ch, case when e.ch is not null and total%4<>0 then 'image_validation_failed' when total%6=0 then 'pdf_page_count_mismatch' when total%6=1 then 'download_not_completed' when total%6=2 then 'download_state_invalid'
  when total%6=3 then 'pdf_validation_failed' when total%6=4 then 'image_validation_failed' end issue_type, case when total%8<>0 then concat('aviso de ', c.ch) end message, total%5=0 pdf_generated,
 case when total%7=0 then null when total%9=0 then pages+1 else pages end expected, case when total%14<>0 then pages end found, pages pdf_expected, case when total%10<>0 then pages-1 end pdf_found, total
from t_chapter c left join (select distinct ch from t_error) e on c.ch=e.ch""")
view("t_repmeta", "select s.ch, file, case when page_no%5<>0 then 700 end width, h height, case when page_no%2=0 then 525.0 end pdf_width, h*0.75 pdf_height, page_no from t_strip s where total%11<>0 and not (page_no%13=3 and total%2=0)")


@query("render_divergence_text", """
with b as (select distinct ch, file from t_error), n as (select ch, count(*) bad, arg_min(regexp_extract(file, 'page-([0-9]+)', 1)::bigint, regexp_extract(file, 'page-([0-9]+)', 1)::bigint) pg from b group by ch),
 m as (select ch, count(*) meta, count(distinct page_no) dif, min(page_no) lo, max(page_no) hi from t_repmeta group by ch),
 r as (select t.*, coalesce(bad, 0) bad, pg, coalesce(meta, 0) meta, coalesce(expected > 0 and meta=expected and dif=expected and lo=1 and hi=expected, false) seq, coalesce(issue_type, '') iss, coalesce(message, '') msg from t_report t left join n using (ch) left join m using (ch)),
 q as (select *, iss='image_validation_failed' and bad>0 imgs, iss='image_validation_failed' and coalesce(expected=found, false) and (meta=0 or seq) mine from r),
 l as (select ch, unnest([
  {'s':0, 'k':0, 'l': format('{:<24} {}', concat('Capítulo ', ch), case iss when 'image_validation_failed' then 'Imagem incompatível' when 'pdf_page_count_mismatch' then 'Páginas do PDF divergentes' when 'pdf_validation_failed' then 'Validação do PDF' when 'download_not_completed' then 'Download em andamento' when 'download_state_invalid' then 'Estado de download inválido' when '' then 'Divergência' else iss end)},
  {'s':1, 'k':0, 'l': concat('CAPÍTULO ', ch, case when pdf_generated then ' — PDF GERADO' else ' — PDF NÃO GERADO' end)},
  {'s':2, 'k':0, 'l': ''}, {'s':2, 'k':1, 'l': 'Validação do capítulo'},
  {'s':2, 'k':2, 'l': case when expected is not null and found is not null then concat(case when expected=found then '✓ ' else '✕ ' end, found, ' de ', expected, ' páginas encontradas') when found is not null then concat('✓ ', found, ' páginas encontradas') end},
  {'s':2, 'k':3, 'l': case when meta>0 and expected is not null then case when seq then '✓ Sequência completa' else '✕ Sequência de páginas divergente' end end},
  {'s':2, 'k':4, 'l': case when found>0 and meta=found then '✓ Imagens legíveis' end},
  {'s':3, 'k':0, 'l': ''}, {'s':3, 'k':1, 'l': 'Divergência'},
  {'s':3, 'k':2, 'l': case when imgs then null when iss='pdf_page_count_mismatch' then concat('✕ Quantidade de páginas do PDF divergente: esperado ', pdf_expected, ', encontrado ', coalesce(pdf_found::varchar, 'None')) else concat('✕ ', case when msg='' then 'Divergência registrada.' else msg end) end},
  {'s':4, 'k':0, 'l': ''}, {'s':4, 'k':1, 'l': 'Conclusão'},
  {'s':4, 'k':2, 'l': case when mine then 'O capítulo está completo.' when iss='pdf_page_count_mismatch' then 'As imagens do capítulo foram validadas.' when iss='download_not_completed' then 'O capítulo ainda estava em download.' when iss='download_state_invalid' then 'O estado persistente do capítulo não pôde ser validado.' when msg<>'' then msg else 'A divergência requer revisão.' end},
  {'s':4, 'k':3, 'l': case when mine and bad=1 then 'A geração do PDF foi bloqueada por uma única imagem incompatível' when mine then concat('A geração do PDF foi bloqueada por ', bad, ' imagens incompatíveis') when iss='pdf_page_count_mismatch' then 'O PDF gerado apresentou quantidade de páginas divergente.' when iss='download_not_completed' then 'A geração do PDF foi bloqueada para evitar um arquivo incompleto.' when iss='download_state_invalid' then 'A geração do PDF foi bloqueada por segurança.' end},
  {'s':4, 'k':4, 'l': case when mine then 'com a regra de segurança do PDF.' end},
  {'s':5, 'k':0, 'l': ''}, {'s':5, 'k':1, 'l': 'Ação sugerida'},
  {'s':5, 'k':2, 'l': case when imgs and bad=1 then concat('Revisar visualmente a página ', pg, ' antes de decidir por exceção/correção.') when imgs then 'Revisar visualmente as páginas divergentes antes de decidir por exceção/correção.' when iss='pdf_page_count_mismatch' then 'Comparar a quantidade de imagens com as páginas do PDF antes de gerar novamente.'
    when iss='download_not_completed' then 'Aguardar a conclusão do download antes de gerar o PDF.' when iss='download_state_invalid' then 'Revisar o estado do capítulo antes de tentar gerar o PDF.' else 'Revisar os detalhes técnicos do relatório.' end}]) x from q),
 i as (select b.ch, regexp_extract(b.file, 'page-([0-9]+)', 1)::bigint page, unnest([{'k':2, 'l': concat('✕ ', b.file)}, {'k':3, 'l': case when width is not null then concat('  Dimensão da imagem: ', width, 'x', height) end},
  {'k':4, 'l': case when pdf_width is not null then format('  Dimensão no PDF: {:.2f}x{:.2f}', pdf_width::double, pdf_height::double) end}, {'k':5, 'l': '  Motivo: altura/dimensão abaixo do mínimo permitido'}]) x
  from b join q on b.ch=q.ch and imgs left join t_repmeta t on t.ch=b.ch and t.file=b.file)
select ch, x.s::bigint section, 0::bigint page, x.k::bigint k, x.l line from l where x.l is not null union all select ch, 3, page, x.k, x.l from i where x.l is not null""")
def render_divergence_text(spark, sf):
    """Narratives of reports of every issue type, with and without incompatible images."""
    from stripline.operators.quality import divergence_lines

    t, k, pages = c("total"), c("page_no"), c("pages")
    e = S.error(spark, sf).select("ch", "file")
    six = F.when(t % 6 == 0, "pdf_page_count_mismatch").when(t % 6 == 1, "download_not_completed").when(t % 6 == 2, "download_state_invalid").when(t % 6 == 3, "pdf_validation_failed").when(t % 6 == 4, "image_validation_failed")
    r = S.chapter(spark, sf).join(e.select("ch").distinct().withColumn("bad", F.lit(True)), "ch", "left").select(
        "ch", c("ch").alias("name"), F.when(c("bad") & (t % 4 != 0), "image_validation_failed").otherwise(six).alias("issue_type"), F.when(t % 8 != 0, F.concat(F.lit("aviso de "), "ch")).alias("message"),
        (t % 5 == 0).alias("pdf_generated"), F.when(t % 7 == 0, F.lit(None)).when(t % 9 == 0, pages + 1).otherwise(pages).alias("expected"), F.when(t % 14 != 0, pages).alias("found"), pages.alias("pdf_expected"),
        F.when(t % 10 != 0, pages - 1).alias("pdf_found"))
    m = S.strip(spark, sf).filter((t % 11 != 0) & ~((k % 13 == 3) & (t % 2 == 0))).select(
        "ch", "file", F.when(k % 5 != 0, 700).alias("width"), c("h").alias("height"), F.when(k % 2 == 0, 525.0).alias("pdf_width"), (c("h") * 0.75).alias("pdf_height"))
    return out(divergence_lines(r, e, m), "ch", "section", "page", "k", "line")


@query("write_report_json", """
select ch, 'header' kind, to_json({'errors': count(*), 'files': count(distinct file)})::varchar json from t_error group by ch
union all select ch, 'error', to_json({'file': file, 'issue_type': issue_type, 'message': msg})::varchar from t_error""")
def write_report_json(spark, sf):
    e = S.error(spark, sf)
    head = e.groupBy("ch").agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("file").alias("files"))
    return out(J.manifest_lines(head, {"error": e.select("ch", "file", "issue_type", c("msg").alias("message"))}, ["ch"]), "ch", "kind", "json")


@query("write_chapter_manifest", """
select ch, 'header' kind, to_json({'total_height': total, 'source_pages': pages, 'algorithm': 'whitespace_v3', 'target': 7000})::varchar json from t_chapter
union all select ch, 'output', to_json({'index': seg, 'global_start': g_start, 'global_end': g_end, 'stage': stage})::varchar from t_piece
union all select ch, 'source', to_json({'file': file, 'global_start': gs, 'global_end': ge})::varchar from t_strip""")
def write_chapter_manifest(spark, sf):
    head = S.chapter(spark, sf).select("ch", c("total").alias("total_height"), c("pages").alias("source_pages"), F.lit("whitespace_v3").alias("algorithm"), F.lit(7000).alias("target"))
    o = S.piece(spark, sf).select("ch", c("seg").alias("index"), c("g_start").alias("global_start"), c("g_end").alias("global_end"), "stage")
    s = S.strip(spark, sf).select("ch", "file", c("gs").alias("global_start"), c("ge").alias("global_end"))
    return out(J.manifest_lines(head, {"output": o, "source": s}, ["ch"]), "ch", "kind", "json")


@query("read_markers", """
select chapter, in_progress, case when bad_marker then 'invalid' when in_progress then 'in_progress' else 'completed' end status, case when not in_progress and not bad_marker and expected>0 then expected end expected_pages from t_total""")
def read_markers(spark, sf):
    """Completion and in-progress markers; an expectation counts only where the chapter is complete."""
    s = S.seq(spark, sf)
    done = s.filter("not in_progress and not bad_marker").groupBy("chapter").agg(F.max("expected").alias("expected"))
    going = s.filter("in_progress").select("chapter", F.lit(True).alias("going")).distinct()
    broken = s.filter("bad_marker").select("chapter", F.lit(True).alias("broken")).distinct()
    j = s.select("chapter").distinct().join(done, "chapter", "left").join(going, "chapter", "left").join(broken, "chapter", "left")
    return out(j, "chapter", in_progress=F.coalesce("going", F.lit(False)), expected_pages=F.when(c("expected") > 0, c("expected")),
               status=F.when(c("broken"), "invalid").when(c("going"), "in_progress").otherwise("completed"))


@query("promote_versioned", """
with bad as (select distinct ch from (select ch from t_cover) x) select ch, seg, stage, g_start, g_end from t_piece where ch not in (select ch from bad)""")
def promote_versioned(spark, sf):
    """Chapters without a coverage error become the official version; a second promotion is refused while that one is valid."""
    import uuid

    from stripline.operators import compose as K
    from stripline.session import cut, shared_dir
    from stripline.sources.sinks import current_version, promote_versioned
    p = cut(S.piece(spark, sf))
    totals = S.chapter(spark, sf).select("ch", "total")
    bad = cut(K.coverage_errors(p, totals))
    good = p.join(bad.select("ch").distinct(), "ch", "left_anti")
    root = f"{shared_dir(spark)}/official-{uuid.uuid4().hex}"

    def errors_of(df):
        return K.coverage_errors(df, totals.join(df.select("ch").distinct(), "ch", "left_semi"))

    promote_versioned(good, errors_of, root)
    return out(spark.read.parquet(current_version(spark, root)), "ch", "seg", "stage", "g_start", "g_end")
