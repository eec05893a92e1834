"""Image queries: every document as a small colour image (see ``standins.images``)."""

import uuid

from pyspark.sql import functions as F

from stripline.operators import images as I
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view
from stripline.session import shared_dir

LIGHT, DARK = 104, 100
view("t_pix", "select doc_id, y, x, max(v) filter (c=0) b, max(v) filter (c=1) g, max(v) filter (c=2) r from t_byte group by doc_id, y, x")
view("t_lum", "select *, (r*19595+g*38470+b*7471+32768)>>16 lum from t_pix")
view("t_irow", """select doc_id, y, count(*) n, count(*) filter (lum>=104) white_px, avg(b) mb, avg(g) mg, avg(r) mr, greatest(stddev_pop(b), stddev_pop(g), stddev_pop(r)) std, sum(lum)::bigint s1, sum(lum*lum)::bigint s2 from t_lum group by doc_id, y""")


def profile(spark, sf):
    return I.row_profile(S.images(spark, sf), ["doc_id"], light=LIGHT)


@query("row_whiteness", "select doc_id, y, white_px, white_px/n white_ratio from t_irow")
def row_whiteness(spark, sf):
    return out(profile(spark, sf), "doc_id", "y", "white_px", white_ratio=F.col("white_px") / F.col("n"))


@query("row_uniformity", """
select doc_id, y, round(mr,6) r, round(mg,6) g, round(mb,6) b, round(std,4) std, round(coalesce(greatest(abs(mr-lag(mr) over w), abs(mg-lag(mg) over w), abs(mb-lag(mb) over w)),0),6) delta from t_irow window w as (partition by doc_id order by y)""")
def row_uniformity(spark, sf):
    return out(profile(spark, sf), "doc_id", "y", **{c: F.round(c, 6) for c in ("r", "g", "b", "delta")}, std=F.round("std", 4))


@query("row_moments", """
select i.doc_id, i.y, n, s1, s2, e edges from t_irow i join (select doc_id, y, count(*) filter (d>=24) e from (select *, abs(lum-lag(lum) over (partition by doc_id, y order by x)) d from t_lum) a group by doc_id, y) b on i.doc_id=b.doc_id and i.y=b.y""")
def row_moments(spark, sf):
    return out(profile(spark, sf), "doc_id", "y", "n", "s1", "s2", "edges")


@query("slice_features", """
with d as (select doc_id, y, avg(case when lum<104 then 1.0::double else 0 end) rd from t_lum group by doc_id, y)
select l.doc_id, round(avg(lum),4) mean, round(stddev_pop(lum),4) std, count(*) filter (lum<104)/count(*) content, count(*) filter (lum>=110)/count(*) bright, count(*) filter (lum<=60)/count(*) dark, any_value(rs) row_std
from t_lum l join (select doc_id, round(stddev_pop(rd),6) rs from d group by doc_id) q on l.doc_id=q.doc_id group by l.doc_id""")
def slice_features(spark, sf):
    f = I.slice_features(S.images(spark, sf), ["doc_id"], 104, 110, 60)
    return out(f, "doc_id", mean=F.round("mean", 4), std=F.round("std", 4), row_std=F.round("row_std", 6), **{c: F.col(c) for c in ("content", "bright", "dark")})


@query("dark_components", """
with recursive t_run as (select row_number() over (order by doc_id, y, min(x)) i, doc_id, y, min(x) a, max(x)+1 z from (select doc_id, y, x, x-row_number() over (partition by doc_id, y order by x) k from t_pix where round_even((b+g+r)/3.0, 0)<=100) p group by doc_id, y, k),
 t_touch as (select u.i a, l.i b from t_run u join t_run l on u.doc_id=l.doc_id and l.y=u.y+1 and u.a<l.z and l.a<u.z),
 t_link as (select a, b from t_touch union all select b, a from t_touch),
 cc(i, lab) using key (i) as (select i, i from t_run union select e.b, min(c.lab) from cc c join t_link e on e.a=c.i join recurring.cc o on o.i=e.b where c.lab<o.lab group by e.b)
select doc_id, min(a) x, min(y) y, max(z)-min(a) w, max(y)+1-min(y) h, sum(z-a)::bigint pixels from t_run join cc using (i) group by doc_id, lab""")
def dark_components(spark, sf):
    return out(I.dark_components(S.images(spark, sf), ["doc_id"], DARK), "doc_id", "x", "y", "w", "h", "pixels")


@query("component_context", """
with q as (select *, doc_id%8 x0, doc_id%3 y0, doc_id%8+3+doc_id%6 x1, doc_id%3+1+doc_id%4 y1 from t_lum),
 z as (select doc_id, lum, case when x>=x0 and x<x1 and y>=y0 and y<y1 then 'in' when x>=x0 and x<x1 and y<y0 and y>=y0-12 then 't' when x>=x0 and x<x1 and y>=y1 and y<y1+12 then 'b'
  when y>=y0 and y<y1 and x<x0 and x>=x0-12 then 'l' when y>=y0 and y<y1 and x>=x1 and x<x1+12 then 'r' end s from q),
 m as (select doc_id, avg(lum) filter (s='in') im, stddev_pop(lum) filter (s='in') sd, avg(lum) filter (s='t') t, avg(lum) filter (s='b') b, avg(lum) filter (s='l') l, avg(lum) filter (s='r') r from z group by doc_id)
select doc_id, round(im,4) inside_mean, round(sd,4) inside_std, round(greatest(t,b,l,r)-least(t,b,l,r),4) context_range, (case when t is null then 0 else 1 end + case when b is null then 0 else 1 end + case when l is null then 0 else 1 end + case when r is null then 0 else 1 end)::bigint sides from m where im is not null""")
def component_context(spark, sf):
    """One box in each image, of another place and size from document to document; it may reach over the edge."""
    d = F.col("doc_id")
    f = I.component_context(S.images(spark, sf).withColumns({"x": d % 8, "y": d % 3, "w": 3 + d % 6, "h": 1 + d % 4}), ["doc_id"])
    return out(f, "doc_id", "sides", inside_mean=F.round("inside_mean", 4), inside_std=F.round("inside_std", 4), context_range=F.round("context_range", 4))


def pairs(spark, sf):
    """Images with a replacement (vowels swapped for capitals) and a mask of every second pixel row."""
    row = S.IMAGE_WIDTH * 3
    d = S.table(spark, sf, "documents")
    raw = F.encode(F.translate("text", "aeiou", "AEIOU"), "UTF-8")
    h = F.ceil(F.octet_length(raw) / row).cast("int")
    other = d.select("doc_id", F.rpad(raw, h * row, F.unhex(F.lit("FF"))).alias("other"), F.unhex(F.repeat(F.concat(F.repeat(F.lit("01"), F.lit(16)), F.repeat(F.lit("00"), F.lit(16))), h)).alias("m"), h.alias("h"))
    other = other.select("doc_id", "other", F.substring("m", F.lit(1), F.col("h") * S.IMAGE_WIDTH).alias("mask"))
    return S.images(spark, sf).join(other, "doc_id")


view("t_chg", "select doc_id, y, x, bool_or(chr(v::integer) in ('a','e','i','o','u')) ch from t_byte group by doc_id, y, x")


@query("pixel_diff", "select doc_id, y, count(*) filter (ch) changed from t_chg group by doc_id, y")
def pixel_diff(spark, sf):
    return out(I.pixel_diff(pairs(spark, sf), ["doc_id"]), "doc_id", "y", "changed")


@query("integrity_outside_mask", "select doc_id, count(*) filter (ch and y%2=1) outside_mask, count(*) filter (ch and y%2=1)=0 integrity_ok from t_chg group by doc_id")
def integrity_outside_mask(spark, sf):
    d = I.pixel_diff(pairs(spark, sf), ["doc_id"]).groupBy("doc_id").agg(F.sum("outside_mask").alias("outside_mask"))
    return d.withColumn("integrity_ok", F.col("outside_mask") == 0)


@query("masked_composite", "select doc_id, md5(string_agg(printf('%02X', case when y%2=0 and chr(v::integer) in ('a','e','i','o','u') then v-32 else v end), '' order by i)) md5 from t_byte group by doc_id")
def masked_composite(spark, sf):
    return out(I.masked_composite(pairs(spark, sf), ["doc_id"]), "doc_id", md5=F.md5(F.hex("out")))


RAW = "unhex(rpad(hex(encode(text)), cast(ceil(octet_length(encode(text))/48.0) as integer)*96, 'F'))"


def written(spark, files):
    """Folder below the shared one that holds a file for each row."""
    from stripline.sources.sinks import write_files

    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    write_files(files, root)
    return root


def page_name(spark, sf):
    """Path of a document's page: its source as the chapter, some of them backups."""
    k = F.col("doc_id")
    return F.concat("source", F.lit("/page-"), k.cast("string"), F.when(k % 31 == 0, "_old.png").when(k % 7 == 0, ".PNG").otherwise(".png"))


@query("scan_images", f"""
select source ch, doc_id page_no, case when doc_id%97<>0 then 16 end::bigint width, case when doc_id%97<>0 then cast(ceil(octet_length(encode(text))/48.0) as bigint) end height, case when doc_id%97<>0 then md5({RAW}) end pixels,
 case when doc_id%97=0 then 'unreadable' end problem from documents where doc_id%31<>0""")
def scan_images(spark, sf):
    """Image files of all documents, decoded; files cut short stay as error rows, backups are left out."""
    from stripline.sources.pages import scan_images as scan
    from stripline.sources.sinks import encode_png

    k = F.col("doc_id")
    png = encode_png(S.images(spark, sf, "source"), ["doc_id", "source"])
    cut_short = F.when(k % 97 == 0, F.substring("content", 1, 20)).otherwise(F.col("content"))
    root = written(spark, png.select(page_name(spark, sf).alias("path"), cut_short.alias("content")))
    return out(scan(spark, root), "ch", "page_no", "width", "height", "problem", pixels=F.md5("data"))


@query("image_sizes", """
select doc_id, case when doc_id%97<>0 then 16 end::bigint width, case when doc_id%97<>0 then cast(ceil(octet_length(encode(text))/48.0) as bigint) end height, case when doc_id%97=0 then 'unreadable' end problem from documents""")
def image_sizes(spark, sf):
    """Sizes from PNG headers; files cut short stay as error rows."""
    from stripline.sources.pages import png_size
    from stripline.sources.sinks import encode_png
    files = encode_png(S.images(spark, sf), ["doc_id"])
    broken = F.col("doc_id") % 97 == 0
    files = files.withColumn("content", F.when(broken, F.substring("content", 2, 20)).otherwise(F.col("content")))
    return out(png_size(files), "doc_id", "width", "height", problem=F.when(F.col("width").isNull(), "unreadable"))


@query("scan_pages", """
select source ch, concat('page-', doc_id, case when doc_id%7=0 then '.PNG' else '.png' end) file, doc_id page_no, octet_length(encode(text)) size, sha256(encode(text)) sha256 from documents where doc_id%31<>0""")
def scan_pages(spark, sf):
    """Page files of all documents by chapter and number, with size and hash; backups are left out."""
    from stripline.sources.pages import scan_pages as scan

    root = written(spark, S.table(spark, sf, "documents").select(page_name(spark, sf).alias("path"), F.encode("text", "UTF-8").alias("content")))
    return out(scan(spark, root, content=True), "ch", "file", "page_no", "size", "sha256")


@query("strip_scan_images", """
with b as (select doc_id, y, x, c, v, abs(lead(v) over (partition by doc_id, y, c order by x) - v) rv, abs(lead(v) over (partition by doc_id, x, c order by y) - v) dv from t_byte),
 rc as (select doc_id, y, c, sum(v) f1, sum(v*v) f2, sum(v) filter (x between 4 and 11) m1, sum(v*v) filter (x between 4 and 11) m2 from b group by all),
 rr as (select doc_id, y, coalesce(sum(rv), 0) fr, coalesce(sum(rv) filter (x between 4 and 10), 0) mr, coalesce(sum(dv), 0) fd, coalesce(sum(dv) filter (x between 4 and 11), 0) md from b group by all),
 wc as (select doc_id, y, c, count(*) over w n, sum(f1) over w/288.0 fa, sum(f2) over w/288.0 fb, sum(m1) over w/144.0 ma, sum(m2) over w/144.0 mb from rc window w as (partition by doc_id, c order by y range between current row and 17 following)),
 sd as (select doc_id, y, max(sqrt(greatest(fb-fa*fa, 0))) fs, max(sqrt(greatest(mb-ma*ma, 0))) ms from wc where n=18 and y%9=0 group by all),
 wr as (select doc_id, y, sum(fr) over w/(18*15*3.0) fr, sum(mr) over w/(18*7*3.0) mr, sum(fd) over v/(17*16*3.0) fd, sum(md) over v/(17*8*3.0) md from rr window w as (partition by doc_id order by y range between current row and 17 following), v as (partition by doc_id order by y range between current row and 16 following))
select doc_id, y, y+9 center, round(ms,6) uniform_std, round(greatest(mr,md),6) edge_mean, round(fs,6) full_std, round(greatest(fr,fd),6) full_edge from sd join wr using (doc_id, y) where ms<=36 and fs<=36 and greatest(mr,md)<=32 and greatest(fr,fd)<=32""")
def strip_scan_images(spark, sf):
    """Flat strips of images, by their pixels: the eight centre columns and the full width."""
    s = I.strip_scan(S.images(spark, sf), ["doc_id"], 36.0, 32.0, sample=8)
    return out(s, "doc_id", "y", "center", **{c: F.round(c, 6) for c in ("uniform_std", "edge_mean", "full_std", "full_edge")})


@query("stack_crops_images", f"""
with p as (select doc_id, hex({RAW}) x, cast(ceil(octet_length(encode(text))/48.0) as bigint) h from documents),
 q as (select doc_id//4 strip, doc_id, h//4 a, greatest(h//4, h - doc_id%3) z, x from p)
select strip, md5(unhex(string_agg(substr(x, a*96+1, (z-a)*96), '' order by doc_id))) content_md5, sum(z-a)::bigint n_rows, count(*) n_slices from q group by strip""")
def stack_crops_images(spark, sf):
    """Row slices of four neighbouring images each, stacked in order."""
    i = S.images(spark, sf)
    a = F.floor(F.col("height") / 4)
    i = i.withColumns({"strip": F.floor(F.col("doc_id") / 4), "a": a, "z": F.greatest(a, F.col("height") - F.col("doc_id") % 3)})
    s = I.stack_rows(I.crop_rows(i, "a", "z"), ["strip"], "doc_id")
    return out(s, "strip", "n_slices", content_md5=F.md5("data"), n_rows=F.expr("octet_length(data) div 48"))
