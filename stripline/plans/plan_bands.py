"""Band queries over the row profile."""

from pyspark.sql import functions as F

from stripline.operators import bands as B
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view

WHITE = 0.05
view("t_wrun", """
select ch, min(y) "start", max(y)+1 "end", count(*) height, round(sum(white_px)/(count(*)*50000),8) white_ratio_mean
from (select *, y - row_number() over (partition by ch order by y) g from t_profile where white_ratio >= 0.05) x group by ch, g
""")


@query("bands_white", "select * from t_wrun")
def bands_white(spark, sf):
    b = B.white_bands(S.profile(spark, sf), WHITE, 50000)
    return out(b, "ch", "start", "end", "height", white_ratio_mean=F.round("white_ratio_mean", 8))


view("t_urun", """
select ch, min(y) "start", max(y)+1 "end", count(*) height, round(avg(std),4) std_mean, max(std) std_max, round(avg(delta),4) delta_mean,
 printf('#%02x%02x%02x', cast(round_even(sum(s1%256)/count(*),0) as bigint), cast(round_even(sum(s1*7%256)/count(*),0) as bigint), cast(round_even(sum(edges*80)/count(*),0) as bigint)) color
from (select *, y - row_number() over (partition by ch order by y) g from t_profile where std <= 4 and delta <= 3) x group by ch, g
""")


def colored(spark, sf):
    return S.profile(spark, sf).withColumns({"r": F.col("s1") % 256, "g": F.col("s1") * 7 % 256, "b": F.col("edges") * 80})


@query("bands_uniform", 'select ch, "start", "end", height, std_max from t_urun')
def bands_uniform(spark, sf):
    return out(B.uniform_bands(S.profile(spark, sf)), "ch", "start", "end", "height", "std_max")


@query("band_stats", 'select ch, "start", std_mean, std_max, delta_mean, color from t_urun')
def band_stats(spark, sf):
    b = B.uniform_bands(colored(spark, sf), rgb=("r", "g", "b"))
    return out(b, "ch", "start", "std_max", "color", std_mean=F.round("std_mean", 4), delta_mean=F.round("delta_mean", 4))


@query("moving_band_stats", """
select ch, y, round(sqrt(greatest(s2/n - (s1/n)*(s1/n), 0)),6) band_std, round(e/n,6) edge_density from (
 select ch, y, count(*) over w n, sum(s1) over w s1, sum(s2) over w s2, sum(edges) over w e from t_profile
 window w as (partition by ch order by y range between 8 preceding and 8 following)) x""")
def moving_band_stats(spark, sf):
    m = B.moving_band(S.profile(spark, sf).drop("white_px", "white_ratio", "std", "delta", "page"))
    return out(m, "ch", "y", band_std=F.round("band_std", 6), edge_density=F.round("edge_density", 6))


@query("strip_scan", """
select ch, y, y+9 center, round(sd,6) uniform_std, round(ed,6) edge_mean from (
 select ch, y, n, sqrt(greatest(s2/n-(s1/n)*(s1/n),0)) sd, greatest(x/n, dy/(n-1)) ed from (
  select ch, y, count(*) over f n, sum(s1) over f s1, sum(s2) over f s2, sum(edges) over f x, sum(dy) over (partition by ch order by y range between 1 following and 17 following) dy
  from (select *, abs(s1-lag(s1) over (partition by ch order by y)) dy from t_profile) p window f as (partition by ch order by y range between current row and 17 following)) q) r
where y%9=0 and n=18 and sd<=25 and ed<=30""")
def strip_scan(spark, sf):
    s = B.strip_scan(S.profile(spark, sf).drop("white_px", "white_ratio", "std", "delta", "page"), 25.0, 30.0)
    return out(s, "ch", "y", "center", uniform_std=F.round("uniform_std", 6), edge_mean=F.round("edge_mean", 6))


@query("trimmed_std", """
with b as (select a.ch, a.y, list(b.s1) v from t_profile a join t_profile b on a.ch=b.ch and b.y between a.y-16 and a.y+16 group by all),
 q as (select *, quantile_cont_lo lo, quantile_cont_hi hi from (select *, list_aggregate(v,'quantile_cont',0.1) quantile_cont_lo, list_aggregate(v,'quantile_cont',0.9) quantile_cont_hi from b) z),
 c as (select ch, y, v, list_filter(v, lambda t: t>=lo and t<=hi) core from q),
 d as (select ch, y, case when len(core) < greatest(8, len(v)//4) then v else core end u from c)
select ch, y, len(u) core_size, round(sqrt(greatest(list_sum(list_transform(u, lambda t: t*t))/len(u) - (list_sum(u)/len(u))*(list_sum(u)/len(u)),0)),4) trimmed_std from d""")
def trimmed_std(spark, sf):
    t = B.trimmed_std(S.profile(spark, sf), min_core=8)
    return out(t, "ch", "y", "core_size", trimmed_std=F.round("trimmed_std", 4))


@query("median_ring", """
with p as (select ch, page, s1%256 r, s1*7%256 g, edges*80 b, (s1%256 + s1*7%256 + edges*80)/3.0::double l from t_profile),
 a as (select ch, page, count(*) filter (l>=120) >= 5 and count(*) filter (l>=120) >= count(*)*0.35 from_bright,
  median(r) ar, median(g) ag, median(b) ab, median(l) al, stddev_pop(l) asd, median(r) filter (l>=120) br, median(g) filter (l>=120) bg, median(b) filter (l>=120) bb, median(l) filter (l>=120) bl, stddev_pop(l) filter (l>=120) bsd from p group by ch, page),
 m as (select ch, page, from_bright, case when from_bright then br else ar end med_r, case when from_bright then bg else ag end med_g, case when from_bright then bb else ab end med_b,
  case when from_bright then bl else al end lm, case when from_bright then bsd else asd end ls from a)
select ch, page, from_bright, med_r, med_g, med_b, round(lm,6) lum_median, round(ls,4) lum_std, lm>=220 and ls<=18 and greatest(med_r,med_g,med_b)-least(med_r,med_g,med_b)<=18 usable from m""")
def median_ring(spark, sf):
    m = B.median_ring(colored(spark, sf), ["ch", "page"], bright=120.0, min_bright=5)
    return out(m, "ch", "page", "from_bright", "med_r", "med_g", "med_b", "usable", lum_median=F.round("lum_median", 6), lum_std=F.round("lum_std", 4))
