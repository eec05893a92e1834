"""The domain tables of the registered queries, derived from the given tables.

A chapter is the documents of one source and language, a page is one document and a pixel row is one character.  Every
view has a DataFrame form built on the skew-safe operators and a plain SQL form for the comparison run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripline.operators.blocks import id_blocks, range_blocks, running
from stripline.plans.registry import view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages_of(spark: SparkSession, sf: str, *extra) -> DataFrame:
    d = table(spark, sf, "documents")
    d = d.select(F.concat_ws("/", "source", "lang").alias("ch"), "doc_id", F.col("n_chars").alias("h"), *extra)
    d = running(id_blocks(d, "doc_id"), ["ch"], ["doc_id"], sums={"gs": "h"}, number="page_no", totals={"total": "h"}).drop("_b")
    digits = F.col("page_no").cast("string")
    return d.withColumns({
        "ge": F.col("gs") + F.col("h"),
        "file": F.concat(F.lit("page-"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lit(".png")),
    })


view("t_strip", """
select ch, concat('page-', format('{:04d}', page_no), '.png') file,
 page_no, doc_id, h, gs, ge, total
from (select concat(source,'/',lang) ch, row_number() over w page_no, doc_id, n_chars h,
  cast(sum(n_chars) over w as bigint) - n_chars gs, cast(sum(n_chars) over w as bigint) ge,
  cast(sum(n_chars) over (partition by source,lang) as bigint) total
 from documents window w as (partition by source,lang order by doc_id rows between unbounded preceding and current row)) p
""")


def strip(spark: SparkSession, sf: str) -> DataFrame:
    """Pages laid out on their chapter's axis."""
    return pages_of(spark, sf).select("ch", "file", "page_no", "doc_id", "h", "gs", "ge", "total")


view("t_band", """
select ch, 'white_band' kind, gs-bh//2 b_start, gs-bh//2+bh b_end, bh height, gs center, 0.985+(doc_id%15)/1000.0 ratio, cast(null as double) std, total
 from (select *, (doc_id*37)%400 bh from t_strip where gs>0) a
union all select ch, 'uniform_color_band', c-bh//2, c-bh//2+bh, bh, c, cast(null as double), (doc_id%50)/10.0, total
 from (select *, gs+h//2 c, (doc_id*53)%500 bh from t_strip) b
""")


def band(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate bands: white at page starts, uniform colour in mid-page."""
    one = F.struct(
        F.lit("white_band").alias("kind"), (F.col("doc_id") * 37 % 400).alias("height"), F.col("gs").alias("center"),
        (F.lit(0.985) + F.col("doc_id") % 15 / 1000.0).alias("ratio"), F.lit(None).cast("double").alias("std"))
    two = F.struct(
        F.lit("uniform_color_band").alias("kind"), (F.col("doc_id") * 53 % 500).alias("height"),
        (F.col("gs") + F.floor(F.col("h") / 2)).alias("center"),
        F.lit(None).cast("double").alias("ratio"), (F.col("doc_id") % 50 / 10.0).alias("std"))
    both = F.when(F.col("gs") > 0, F.array(one, two)).otherwise(F.array(two))
    b = strip(spark, sf).select("ch", "total", F.explode(both).alias("b")).select("ch", "b.*", "total")
    start = F.col("center") - F.floor(F.col("height") / 2)
    return b.select("ch", "kind", start.alias("b_start"), (start + F.col("height")).alias("b_end"), "height", "center", "ratio", "std", "total")


view("t_dim", """
select p_brand ch, concat('page-', format('{:06d}', p_partkey), '.png') file, p_partkey,
 cast(case when p_partkey%97=0 then null when p_partkey%10<7 then 700 when p_partkey%10=7 then 710 else 600+p_size*5 end as bigint) width,
 cast(case when p_partkey%97=0 then null when p_partkey%101=0 then 3 else 900+p_size*20 end as bigint) height,
 case when p_partkey%13=0 then 0.0 when p_partkey%17=0 then null else 96.0 end::double dpi from part
""")


def dim(spark: SparkSession, sf: str) -> DataFrame:
    """Page sizes with unreadable rows, three-pixel pages and bad resolutions."""
    k, s = F.col("p_partkey"), F.col("p_size")
    digits = k.cast("string")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("ch"),
        F.concat(F.lit("page-"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")), F.lit(".png")).alias("file"),
        "p_partkey",
        F.when(k % 97 == 0, None).when(k % 10 < 7, 700).when(k % 10 == 7, 710).otherwise(600 + s * 5).cast("long").alias("width"),
        F.when(k % 97 == 0, None).when(k % 101 == 0, 3).otherwise(900 + s * 20).cast("long").alias("height"),
        F.when(k % 13 == 0, 0.0).when(k % 17 == 0, None).otherwise(96.0).cast("double").alias("dpi"),
    )


view("t_rows", """
select user_id ch, row_number() over (partition by user_id order by ts, event_id) - 1 y, event_id, event_type, value from events
""")
view("t_profile", """
select ch, y, y//20 page, cast(round(value*100) as bigint) white_px, cast(round(value*100) as bigint)/50000 white_ratio, case when event_id%9<6 then 1.0 else 6.0 end::double std, ((event_id%5)*1.0)::double delta,
 cast(floor(value) as bigint) s1, cast(floor(value)*floor(value) as bigint) s2, event_id%3 edges from t_rows
""")
view("t_evidence", """
select ch, (y+1)*2 y, (y+1)*500 y_path, round(value/20.0,4) band_std, (event_id%40)/1000.0 edge_density,
 case when event_type='error' then 1 else 0 end::bigint crossing_components, case when event_type='signup' and event_id%2=0 then 1 else 0 end::bigint diagonal_crossings,
 event_id%6 text_fx_clusters, ((event_id%30)*1.0)::double text_fx_background_std from t_rows
""")


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as pixel rows of a strip, numbered from 0 in time order."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("ch"), "ts", "event_id", "event_type", "value")
    e = running(range_blocks(e, ["ch"], ["ts", "event_id"]), ["ch"], ["ts", "event_id"], number="_r")
    return e.select("ch", (F.col("_r") - 1).alias("y"), "event_id", "event_type", "value")


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """Row profile: whiteness, channel spread, change to the row above and moments of every pixel row."""
    e, v = F.col("event_id"), F.floor("value")
    px = F.round(F.col("value") * 100).cast("long")
    return rows(spark, sf).select(
        "ch", "y", F.floor(F.col("y") / 20).alias("page"), px.alias("white_px"), (px / 50000).alias("white_ratio"),
        F.when(e % 9 < 6, 1.0).otherwise(6.0).alias("std"), (e % 5 * 1.0).alias("delta"),
        v.alias("s1"), (v * v).alias("s2"), (e % 3).alias("edges"))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Structural evidence at every scanned position."""
    e, t = F.col("event_id"), F.col("event_type")
    return rows(spark, sf).select(
        "ch", ((F.col("y") + 1) * 2).alias("y"), ((F.col("y") + 1) * 500).alias("y_path"),
        F.round(F.col("value") / 20.0, 4).alias("band_std"), (e % 40 / 1000.0).alias("edge_density"),
        F.when(t == "error", 1).otherwise(0).cast("long").alias("crossing_components"),
        F.when((t == "signup") & (e % 2 == 0), 1).otherwise(0).cast("long").alias("diagonal_crossings"),
        (e % 6).alias("text_fx_clusters"), (e % 30 * 1.0).alias("text_fx_background_std"))


view("t_piece", """
select ch, seg, case seg%6 when 0 then 'auto_merge' when 1 then 'level2' when 2 then 'level3' when 3 then 'level4' when 4 then 'level5' else 'review' end stage,
 g_start, g_end + case when (seg*7+total)%29=0 then 5 when (seg*7+total)%23=0 then -7 else 0 end g_end, total
from (select ch, seg, min(gs) g_start, max(ge) g_end, max(total) total from (select *, (page_no-1)//4 seg from t_strip) s group by ch, seg) p
""")
STAGES = ["auto_merge", "level2", "level3", "level4", "level5", "review"]


def piece(spark: SparkSession, sf: str) -> DataFrame:
    """Stage pieces of four pages, some ending five rows late or seven rows early."""
    seg = F.floor((F.col("page_no") - 1) / 4)
    p = strip(spark, sf).groupBy("ch", seg.alias("seg")).agg(
        F.min("gs").alias("g_start"), F.max("ge").alias("g_end"), F.max("total").alias("total"))
    k = F.col("seg") * 7 + F.col("total")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("seg") % 6 + 1).cast("int"))
    fault = F.when(k % 29 == 0, 5).when(k % 23 == 0, -7).otherwise(0)
    return p.select("ch", "seg", stage.alias("stage"), "g_start", (F.col("g_end") + fault).alias("g_end"), "total")


view("t_halved", """
select ch, seg*2+half seg, case half when 0 then g_start else (g_start+g_end)//2 end g_start, case half when 0 then (g_start+g_end)//2 else g_end end g_end
from t_piece cross join (select 0 half union all select 1) h where g_end - g_start > 1
""")
view("t_chapter", """
select concat(source,'/',lang) ch, cast(sum(n_chars) as bigint) total, count(*) pages from documents group by all
""")
view("t_manifest", """
select ch, lvl, total, pages, total + case when total%11=lvl then 1 else 0 end total_height, md5(concat(ch,'#',cast(lvl as varchar))) sha,
 case when total%5=lvl%5 then 'stale' else md5(concat(ch,'#',cast(lvl-1 as varchar))) end upstream_sha, (total+lvl)%3 residual_n
from (select *, unnest(generate_series(2, case when total%7=0 then 3 else 5 end)) lvl from t_chapter) c
""")


def chapter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("ch")).agg(
        F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("pages"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of levels 2 to 5 per chapter, with stale hashes, wrong totals and missing levels."""
    top = F.when(F.col("total") % 7 == 0, 3).otherwise(5)
    c = chapter(spark, sf).withColumn("lvl", F.explode(F.sequence(F.lit(2).cast("long"), top.cast("long"))))
    sha = lambda n: F.md5(F.concat(F.col("ch"), F.lit("#"), n.cast("string")))
    return c.select(
        "ch", "lvl", "total", "pages", (F.col("total") + F.when(F.col("total") % 11 == F.col("lvl"), 1).otherwise(0)).alias("total_height"),
        sha(F.col("lvl")).alias("sha"),
        F.when(F.col("total") % 5 == F.col("lvl") % 5, "stale").otherwise(sha(F.col("lvl") - 1)).alias("upstream_sha"),
        ((F.col("total") + F.col("lvl")) % 3).alias("residual_n"))


view("t_box", """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice*100) as bigint), cast(l_quantity as bigint), strftime(l_shipdate, '%Y%m%d')) id,
 l_orderkey page, case when l_returnflag='A' then 'detection' else 'ocr' end role_,
 l_partkey%600 x1, (l_suppkey*7)%900 y1, l_partkey%600+cast(l_quantity as bigint)+20 x2, (l_suppkey*7)%900+l_linenumber*15+10 y2,
 round(0.4+l_discount*6,2) conf, 190+l_tax*800 brightness, l_quantity*2 texture, round(0.5+l_discount,2) bright_ratio from lineitem
""")


def box(spark: SparkSession, sf: str) -> DataFrame:
    """Detection and text boxes on pages."""
    c = F.col
    x1, y1 = c("l_partkey") % 600, c("l_suppkey") * 7 % 900
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(c("l_extendedprice") * 100).cast("long"),
                        c("l_quantity").cast("long"), F.date_format("l_shipdate", "yyyyMMdd"))
    return table(spark, sf, "lineitem").select(
        ident.alias("id"), c("l_orderkey").alias("page"), F.when(c("l_returnflag") == "A", "detection").otherwise("ocr").alias("role_"),
        x1.alias("x1"), y1.alias("y1"), (x1 + c("l_quantity").cast("long") + 20).alias("x2"),
        (y1 + c("l_linenumber") * 15 + 10).cast("long").alias("y2"), F.round(0.4 + c("l_discount") * 6, 2).alias("conf"),
        (190 + c("l_tax") * 800).alias("brightness"), (c("l_quantity") * 2).alias("texture"),
        F.round(0.5 + c("l_discount"), 2).alias("bright_ratio"))


view("t_file", """
select doc_id, concat(source,'/',lang) ch, concat(source,'/',lang,'/page-',cast(doc_id as varchar),case doc_id%11 when 0 then '_old.png' when 1 then '_mask.png' when 2 then '.json' else '.png' end) rel,
 n_chars size, md5(text) hash, doc_id%3<>0 in_dest, case when doc_id%7=0 then 'changed' else md5(text) end dest_hash from documents
""")


def file(spark: SparkSession, sf: str) -> DataFrame:
    """Files at a source and at a destination: new, identical, changed and excluded names."""
    k = F.col("doc_id")
    tail = F.when(k % 11 == 0, "_old.png").when(k % 11 == 1, "_mask.png").when(k % 11 == 2, ".json").otherwise(".png")
    ch = F.concat_ws("/", "source", "lang")
    return table(spark, sf, "documents").select(
        "doc_id", ch.alias("ch"), F.concat(ch, F.lit("/page-"), k.cast("string"), tail).alias("rel"), F.col("n_chars").alias("size"),
        F.md5("text").alias("hash"), (k % 3 != 0).alias("in_dest"),
        F.when(k % 7 == 0, "changed").otherwise(F.md5("text")).alias("dest_hash"))


view("t_log", """
select event_id, ts, concat('cap-',cast(user_id as varchar)) chapter, concat(cast(user_id as varchar),'-',cast(cast(ts as date) as varchar)) request_id,
 case event_type when 'view' then 'job_requested' when 'click' then 'job_started' when 'purchase' then 'job_finished' when 'error' then 'job_failed' else 'chapter_transition' end event,
 case when value<100 then 'novo' when value<250 then 'parcial' else 'concluido' end state, props from events
""")


def log_of(e: DataFrame) -> DataFrame:
    t = F.col("event_type")
    return e.select(
        "event_id", "ts", F.concat(F.lit("cap-"), F.col("user_id").cast("string")).alias("chapter"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string")).alias("request_id"),
        F.when(t == "view", "job_requested").when(t == "click", "job_started").when(t == "purchase", "job_finished")
        .when(t == "error", "job_failed").otherwise("chapter_transition").alias("event"),
        F.when(F.col("value") < 100, "novo").when(F.col("value") < 250, "parcial").otherwise("concluido").alias("state"), "props")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Processing log with chapter states and request ids."""
    return log_of(table(spark, sf, "events"))


view("t_seq", """
select conv_id chapter, turn+1+case when conv_id%11=0 and turn>=1 then 1 else 0 end page_no, mx+1 expected, conv_id%13=0 in_progress, conv_id%17=0 bad_marker
 from (select *, max(turn) over (partition by conv_id) mx from conversations) c
""")


def seq(spark: SparkSession, sf: str) -> DataFrame:
    """Page numbers of chapters with holes, expected totals and markers."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    top = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("expected"))
    shift = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") >= 1), 1).otherwise(0)
    return c.join(top, "conv_id").select(
        F.col("conv_id").alias("chapter"), (F.col("turn") + 1 + shift).alias("page_no"), "expected",
        (F.col("conv_id") % 13 == 0).alias("in_progress"), (F.col("conv_id") % 17 == 0).alias("bad_marker"))


FEATURES = [" ", "e", "a", "n", ".", "h"]
view("t_feat", "select ch, page_no, h, gs, ge, total, file, " + ", ".join(
    f"round(length(replace(text,'{c}',''))/(h*1.0),6) f{i}" for i, c in enumerate(FEATURES, 1))
    + " from t_strip join (select doc_id, text from documents) d using (doc_id)")


def feat(spark: SparkSession, sf: str) -> DataFrame:
    """Six features per page; as in SQL, those of a page with a height of 0 are not a number, or infinite if it has text."""
    def share(c: str) -> Column:
        left, h = F.length(F.replace("text", F.lit(c), F.lit(""))), F.col("n_chars")
        by_zero = F.when(left > 0, float("inf")).when(left == 0, float("nan"))
        return F.round(F.when(h == 0, by_zero).otherwise(left / (h * 1.0)), 6)

    f = [share(c).alias(f"f{i}") for i, c in enumerate(FEATURES, 1)]
    return pages_of(spark, sf, *f).select("ch", "page_no", "h", "gs", "ge", "total", "file", *[f"f{i}" for i in range(1, 7)])


view("t_json", """
select conv_id chapter, turn version, case when conv_id%19=0 then '{"status":' else concat('{"algorithm":"', case when conv_id%7=0 then 'legacy' else 'clean_v2' end,
 '","status":"', case role when 'user' then 'PROPOSTA_GERADA' else 'EFETIVADO' end, '","integrity_ok":', case when turn%5=4 then 'false' else 'true' end,
 ',"source_stage":"', case when conv_id%2=0 then 'ORIGINAL' else 'MERGED' end, '","sources":["page-', cast(turn as varchar), '.png","page-', cast(turn+1 as varchar),
 '.png"],"cleans":["page-', cast(turn as varchar), '_clean.png"', case when conv_id%11=0 then '' else concat(',"page-', cast(turn+1 as varchar), '_clean.png"') end, ']}') end body from conversations
""")


def json_body(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest bodies, some of them cut short."""
    k, t, s = F.col("conv_id"), F.col("turn"), lambda c: c.cast("string")
    body = F.concat(
        F.lit('{"algorithm":"'), F.when(k % 7 == 0, "legacy").otherwise("clean_v2"),
        F.lit('","status":"'), F.when(F.col("role") == "user", "PROPOSTA_GERADA").otherwise("EFETIVADO"),
        F.lit('","integrity_ok":'), F.when(t % 5 == 4, "false").otherwise("true"),
        F.lit(',"source_stage":"'), F.when(k % 2 == 0, "ORIGINAL").otherwise("MERGED"),
        F.lit('","sources":["page-'), s(t), F.lit('.png","page-'), s(t + 1), F.lit('.png"],"cleans":["page-'), s(t), F.lit('_clean.png"'),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(',"page-'), s(t + 1), F.lit('_clean.png"'))), F.lit("]}"))
    return table(spark, sf, "conversations").select(k.alias("chapter"), t.alias("version"), F.when(k % 19 == 0, '{"status":').otherwise(body).alias("body"))


view("t_error", """
select ch, file, case when width is null then 'image_unreadable' else 'image_validation_failed' end issue_type,
 case when width is null then concat('unreadable: ', file) else concat('limits: ', file, ' gives ', cast(height*72//96 as varchar), ' units') end msg
from t_dim where width is null or height*72/96.0 < 3
""")


def error(spark: SparkSession, sf: str) -> DataFrame:
    """Unreadable pages and pages below the minimum size."""
    bad = dim(spark, sf).filter(F.col("width").isNull() | (F.col("height") * 72 / 96.0 < 3))
    none = F.col("width").isNull()
    return bad.select(
        "ch", "file", F.when(none, "image_unreadable").otherwise("image_validation_failed").alias("issue_type"),
        F.when(none, F.concat(F.lit("unreadable: "), "file")).otherwise(
            F.concat(F.lit("limits: "), "file", F.lit(" gives "), F.floor(F.col("height") * 72 / 96).cast("string"), F.lit(" units"))).alias("msg"))


IMAGE_WIDTH = 16


def images(spark: SparkSession, sf: str, *extra) -> DataFrame:
    """Documents as small colour images: three text bytes per pixel, sixteen pixels per row, the last row filled with white."""
    row = IMAGE_WIDTH * 3
    raw = F.encode("text", "UTF-8")
    h = F.ceil(F.octet_length(raw) / row)
    return table(spark, sf, "documents").select(
        "doc_id", F.lit(IMAGE_WIDTH).alias("width"), h.cast("int").alias("height"),
        F.rpad(raw, (h * row).cast("int"), F.unhex(F.lit("FF"))).alias("data"), *extra)


view("t_byte", """
select doc_id, i, v, i//48 y, (i%48)//3 x, i%3 c from (
 select doc_id, unnest(generate_series(0, len(b)-1)) i, unnest(list_transform(b, lambda s: cast(concat('0x', s) as bigint))) v from (
  select doc_id, regexp_extract_all(rpad(hex(encode(text)), cast(ceil(octet_length(encode(text))/48.0) as integer)*96, 'F'), '..') b from documents) a) p
""")
