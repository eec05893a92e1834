"""Text-removal queries over boxes."""

from pyspark.sql import functions as F

from stripline.functions import geometry as G
from stripline.operators import textoff as X
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view

c = F.col
view("t_gate", f"""
select *, conf>=0.55 and bright_ratio>=0.55 and brightness>=205 and not (brightness>=225 and texture<50) gate_ok,
 case when conf>=0.55 and bright_ratio>=0.55 and brightness>=205 and not (brightness>=225 and texture<50) then '{G.GATE_APPROVED}' when brightness>=225 and texture<50 then printf('{G.GATE_LETTERING}', brightness::double, texture::double)
 else printf('{G.GATE_REJECTED}', brightness::double, bright_ratio::double) end reason
from t_box where role_='detection'
""")


def boxes(spark, sf, role):
    return S.box(spark, sf).filter(c("role_") == role)


def gated(spark, sf):
    return X.gate(boxes(spark, sf, "detection"))


@query("detector_gate", "select id, page, gate_ok, reason from t_gate")
def detector_gate(spark, sf):
    return out(gated(spark, sf), "id", "page", "gate_ok", "reason")


view("t_pair", """
select o.page, o.id, d.id region_id, greatest(0, least(o.x2,d.x2)-greatest(o.x1,d.x1))*greatest(0, least(o.y2,d.y2)-greatest(o.y1,d.y1))/((o.x2-o.x1)*(o.y2-o.y1)) containment, d.gate_ok
from t_box o join t_gate d on o.page=d.page and (o.x1+o.x2)/2 between d.x1 and d.x2 and (o.y1+o.y2)/2 between d.y1 and d.y2 where o.role_='ocr'
""")
view("t_assoc", """
select o.id, o.page, region_id, case when o.conf>=0.60 and region_id is not null then 'auto_clean' else 'preserve' end decision, case when o.conf<0.60 then 'low_confidence' when region_id is null then 'no_region' else 'associated' end why
from t_box o left join (select * from (select *, row_number() over (partition by page, id order by containment desc, region_id) r from t_pair where gate_ok and containment>=0.8) x where r=1) b on o.page=b.page and o.id=b.id where o.role_='ocr'
""")


@query("rect_containment", "select page, id, region_id, round(containment,6) containment from t_pair")
def rect_containment(spark, sf):
    return out(X.text_in_regions(boxes(spark, sf, "ocr"), boxes(spark, sf, "detection")), "page", "id", "region_id", containment=F.round("containment", 6))


def associated(spark, sf):
    return X.ocr_to_detection(boxes(spark, sf, "ocr"), gated(spark, sf).filter("gate_ok").select("page", "id", *X.BOX))


@query("ocr_to_detection", "select id, page, region_id, decision, why from t_assoc")
def ocr_to_detection(spark, sf):
    return out(associated(spark, sf), "id", "page", "region_id", "decision", "why")


@query("clean_summary", """
select * from (select count(*) detections, count(*) filter (gate_ok) approved from t_gate) a, (select count(*) ocr_regions, count(*) filter (decision='auto_clean') auto_clean, count(*) filter (decision<>'auto_clean') preserved from t_assoc) b""")
def clean_summary(spark, sf):
    return X.clean_summary(gated(spark, sf), associated(spark, sf))


@query("protected_ranges_reject", """
select id, page, (y1+y2)//2 y from t_box o where role_='ocr' and not exists (select 1 from t_box d where d.role_='detection' and d.page=o.page and (o.y1+o.y2)//2 between greatest(0, d.y1-16) and least(1000, d.y2+16))""")
def protected_ranges_reject(spark, sf):
    cand = boxes(spark, sf, "ocr").select("id", "page", F.floor((c("y1") + c("y2")) / 2).alias("y"))
    return out(X.outside_protected(cand, boxes(spark, sf, "detection"), 1000), "id", "page", "y")


@query("component_type", """
select id, case when not ((x2-x1)*(y2-y1)*10 >= 20000 and bright_ratio*1.6 >= 0.85) then null when texture/10 >= 2.5 then 'TYPE_A'
 when texture/10 <= 1.5 and brightness-190 >= 25 and brightness <= 245 and l >= 3 then 'TYPE_B' end kind from (select *, (x1+y1)%5 l from t_box) b""")
def component_type(spark, sf):
    k = G.component_type((c("x2") - c("x1")) * (c("y2") - c("y1")) * 10, c("bright_ratio") * 1.6, c("texture") / 10, c("brightness"), c("brightness") - 190, (c("x1") + c("y1")) % 5)
    return out(S.box(spark, sf), "id", kind=k)


@query("fill_strategy", """
select id, case when x1%50=0 then 'none' when brightness>=220 and texture/4<=18 and x1%30<=18 then 'direct_fill' else 'inpaint' end strategy from t_box""")
def fill_strategy(spark, sf):
    pixels = F.when(c("x1") % 50 == 0, 0).otherwise(1)
    return out(S.box(spark, sf), "id", strategy=G.fill_strategy(pixels, c("brightness"), c("texture") / 4, c("x1") % 30))


@query("residual_filter", """
select id, page from t_box where (x2-x1)*(y2-y1)//2 between 14 and 5000 and x2-x1 between 2 and 140 and y2-y1 between 3 and 140 and brightness>=236 and texture/8<=10 and bright_ratio*1.6>=0.90""")
def residual_filter(spark, sf):
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    ok = G.residual_text(F.floor(w * h / 2), w, h, c("brightness"), c("texture") / 8, c("bright_ratio") * 1.6)
    return out(S.box(spark, sf).filter(ok), "id", "page")


@query("candidate_box_filter", """
select id, page, row_number() over (partition by page order by y1, x1, id) number from t_box where (x2-x1)*6 <= 360 and (y2-y1)*2 <= 180 and (x2-x1)*(y2-y1)*12 <= 45000""")
def candidate_box_filter(spark, sf):
    b = S.box(spark, sf).select("id", "page", c("x1") * 6, c("x2") * 6, c("y1") * 2, c("y2") * 2).toDF("id", "page", "x1", "x2", "y1", "y2")
    return out(X.candidate_boxes(b), "id", "page", "number")


PCT = "x1/6.5::double l, y1/9.5::double t, (x2-x1)/4.0::double w, (y2-y1)/5.0::double h"


def percent(spark, sf):
    return S.box(spark, sf).select("id", (c("x1") / 6.5).alias("l"), (c("y1") / 9.5).alias("t"), ((c("x2") - c("x1")) / 4.0).alias("w"), ((c("y2") - c("y1")) / 5.0).alias("h"))


view("t_pct", f"select id, {PCT} from t_box")


@query("validate_selection_pct", "select id, case when l<0 or t<0 or w<=0 or h<=0 then 'invalid_coordinates' when l+w>100.000001::double or t+h>100.000001::double then 'outside_image' end problem from t_pct")
def validate_selection_pct(spark, sf):
    return out(percent(spark, sf), "id", problem=G.selection_problem(c("l"), c("t"), c("w"), c("h")))


view("t_px", """select id, cast(least(690, greatest(0, floor(l/100.0::double*690))) as bigint) px1, cast(least(1200, greatest(0, floor(t/100.0::double*1200))) as bigint) py1,
 cast(least(690, greatest(0, ceil((l+w)/100.0::double*690))) as bigint) px2, cast(least(1200, greatest(0, ceil((t+h)/100.0::double*1200))) as bigint) py2 from t_pct""")


def pixel_box(spark, sf):
    return percent(spark, sf).withColumns(G.bbox_from_percent(c("l"), c("t"), c("w"), c("h"), 690, 1200))


@query("bbox_from_percent", "select * from t_px")
def bbox_from_percent(spark, sf):
    return out(pixel_box(spark, sf), "id", "px1", "py1", "px2", "py2")


SIDES = ("px1", "py1", "px2", "py2")


def margined(spark, sf):
    p = [c(s) for s in SIDES]
    d = pixel_box(spark, sf).withColumn("margin", G.mask_margin(G.min_side(*p)))
    return d.withColumns(G.grow(*p, c("margin"), 690, 1200))


view("t_mask", """select *, greatest(0,px1-margin) gx1, greatest(0,py1-margin) gy1, least(690,px2+margin) gx2, least(1200,py2+margin) gy2
 from (select *, cast(greatest(16, least(64, round_even(least(px2-px1,py2-py1)*0.15::double,0))) as bigint) margin from t_px) x""")


@query("mask_margin", "select id, margin, gx1, gy1, gx2, gy2 from t_mask")
def mask_margin(spark, sf):
    return out(margined(spark, sf), "id", "margin", "gx1", "gy1", "gx2", "gy2")


@query("crop_window", """select id, greatest(0,gx1-160) cx1, greatest(0,gy1-160) cy1, least(690,gx2+160) cx2, least(1200,gy2+160) cy2, gx1-greatest(0,gx1-160) dx, gy1-greatest(0,gy1-160) dy from t_mask""")
def crop_window(spark, sf):
    m = margined(spark, sf)
    g = G.grow(c("gx1"), c("gy1"), c("gx2"), c("gy2"), G.PAD, 690, 1200)
    m = m.withColumns({k.replace("g", "c"): v for k, v in g.items()})
    return out(m, "id", "cx1", "cy1", "cx2", "cy2", dx=c("gx1") - c("cx1"), dy=c("gy1") - c("cy1"))


@query("protected_box", """select id, x1+m bx1, y1+m by1, x2-m bx2, y2-m by2, x2-m > x1+m and y2-m > y1+m usable from (select *, cast(greatest(4, round_even(least(x2-x1,y2-y1)*0.025::double,0)) as bigint) m from t_box where role_='detection') b""")
def protected_box(spark, sf):
    b = boxes(spark, sf, "detection").withColumn("m", G.protected_margin(G.min_side(c("x1"), c("y1"), c("x2"), c("y2"))))
    m = c("m")
    return out(b, "id", bx1=c("x1") + m, by1=c("y1") + m, bx2=c("x2") - m, by2=c("y2") - m, usable=(c("x2") - m > c("x1") + m) & (c("y2") - m > c("y1") + m))


@query("polygon_center", "select id, (x1+x2+x2+x1)/4 cx, (y1+y1+y2+y2)/4 cy from t_box where role_='ocr'")
def polygon_center(spark, sf):
    p = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    b = boxes(spark, sf, "ocr").withColumn("polygon", F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2")))
    return out(b, "id", **G.polygon_center("polygon"))


view("t_runs", """
with o as (select distinct page, y1 y, x1 x0, x2 x1 from t_box where role_='ocr'), d as (select page, x1 r0, x2 r1, y1, y2 from t_box where role_='detection'),
 r as (select distinct o.page, o.y, d.r0, d.r1 from o join d on o.page=d.page and o.y >= d.y1 and o.y < d.y2)
select o.page, sum(x1-x0)::bigint cleaner_pixels, coalesce(sum(a),0)::bigint authorized_pixels from (select o.*, (select sum(least(o.x1,r1)-greatest(o.x0,r0)) from r where r.page=o.page and r.y=o.y and greatest(o.x0,r0)<least(o.x1,r1)) a from o) o group by page
""")


def page_masks(spark, sf):
    from stripline.operators.blocks import point_join
    o = boxes(spark, sf, "ocr").select("page", c("y1").alias("y"), c("x1").alias("x0"), c("x2").alias("x1")).distinct()
    d = boxes(spark, sf, "detection").select("page", c("x1").alias("r0"), c("x2").alias("r1"), "y1", "y2")
    r = point_join(o.select("page", "y").distinct(), d, ["page"], "y", ("y1", "y2"), 512).select("page", "y", c("r0").alias("x0"), c("r1").alias("x1")).distinct()
    return X.mask_intersection(o, r)


@query("mask_intersection", "select page, cleaner_pixels, authorized_pixels, case when cleaner_pixels>0 then round(authorized_pixels/cleaner_pixels*100,4) else 0 end authorized_percent from t_runs")
def mask_intersection(spark, sf):
    return out(page_masks(spark, sf), "page", "cleaner_pixels", "authorized_pixels", "authorized_percent")


@query("mask_report", """select count(*) pages_total, sum(cleaner_pixels)::bigint cleaner_pixels, sum(authorized_pixels)::bigint authorized_pixels, round(sum(authorized_pixels)/sum(cleaner_pixels)*100,4) authorized_percent from t_runs""")
def mask_report(spark, sf):
    return X.mask_report(page_masks(spark, sf))


@query("merge_boxes", """
with recursive m(it, page, id, lab, x1, y1, x2, y2) as (
 select 0, page, id, id, x1, y1, x2, y2 from t_box where role_='ocr' union all
 select it+1, page, id, lab, min(x1) over g, min(y1) over g, max(x2) over g, max(y2) over g from (
  select a.it, a.page, a.id, min(b.lab) lab, min(b.x1) x1, min(b.y1) y1, max(b.x2) x2, max(b.y2) y2 from m a join m b
   on a.page=b.page and a.x2+18>=b.x1 and b.x2+18>=a.x1 and a.y2+18>=b.y1 and b.y2+18>=a.y1 where a.it<24 group by a.it, a.page, a.id) x window g as (partition by page, lab))
select page, lab id, x1, y1, x2, y2, count(*) n from m where it=24 group by all""")
def merge_boxes(spark, sf):
    return out(X.merge_boxes(boxes(spark, sf, "ocr")), "page", "id", "x1", "y1", "x2", "y2", "n")
