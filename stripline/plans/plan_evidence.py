"""Decision, ranking and search queries over structural evidence."""

from pyspark.sql import functions as F

from stripline.operators import evidence as E
from stripline.plans import standins as S
from stripline.plans.registry import out, query, view

view("t_decided", """
select *, case when diagonal_crossings>0 or crossing_components>0 or text_like then 'UNSAFE' when clear then 'SAFE' else 'INCONCLUSIVE' end decision,
 case when diagonal_crossings>0 then 'strong_diagonal_crossing' when crossing_components>0 then 'connected_component_crossing' when text_like then 'text_like_region'
  when clear then 'structurally_clear_uniform_band' else 'structural_evidence_inconclusive' end reason
from (select *, text_fx_clusters>=3 and text_fx_background_std<=18 text_like, band_std<=10 and edge_density<=0.015 clear from t_evidence) e
""")


def decided(spark, sf):
    return E.decide(S.evidence(spark, sf))


def on_path(spark, sf):
    """Decisions on the long axis."""
    return decided(spark, sf).withColumn("y", F.col("y_path")).drop("y_path")


@query("cut_decision_table", "select ch, y, decision, reason from t_decided")
def cut_decision_table(spark, sf):
    return out(decided(spark, sf), "ch", "y", "decision", "reason")


@query("text_like_flag", "select ch, y, text_like from t_decided")
def text_like_flag(spark, sf):
    return out(decided(spark, sf), "ch", "y", "text_like")


@query("decision_histogram", """
select 'decision' kind, decision as value, count(*) n from t_decided group by decision union all select 'reason', reason, count(*) from t_decided group by reason""")
def decision_histogram(spark, sf):
    return E.decision_histogram(decided(spark, sf))


@query("top_reasons", "select reason, count(*) n from t_decided group by reason order by n desc, reason limit 3")
def top_reasons(spark, sf):
    return E.top_reasons(decided(spark, sf), 3)


@query("metric_ranges", "\nunion all ".join(
    f"select ch, '{m}' metric, min({m})::double lo, max({m})::double hi from t_decided group by ch" for m in E.METRICS))
def metric_ranges(spark, sf):
    return out(E.metric_ranges(decided(spark, sf)), "ch", "metric", "lo", "hi")


view("t_best", """
select * from (select u.ch, u.y, s.y alt_y, s.edge_density alt_edge, row_number() over (partition by u.ch, u.y order by s.edge_density, s.crossing_components, abs(s.y-u.y), case when s.y<u.y then 0 else 1 end) r
 from t_decided u join t_decided s on u.ch=s.ch and s.y between u.y-200 and u.y+200 and s.y<>u.y where u.decision='UNSAFE' and s.decision='SAFE') x where r=1
""")


@query("safe_rank", "select ch, y, alt_y, alt_edge from t_best")
def safe_rank(spark, sf):
    d = decided(spark, sf)
    return out(E.local_search(d, d.filter("decision = 'UNSAFE'")).filter("alt_y is not null"), "ch", "y", "alt_y", "alt_edge")


@query("local_search", """
select d.ch, d.y, d.decision, d.reason, b.alt_y, case when d.decision='SAFE' then d.y else b.alt_y end chosen from t_decided d left join t_best b on d.ch=b.ch and d.y=b.y""")
def local_search(spark, sf):
    d = decided(spark, sf)
    return out(E.local_search(d, d), "ch", "y", "decision", "reason", "alt_y", "chosen")


view("t_extent", "select ch, max(y_path)+500 total from t_decided group by ch")
view("t_seed", """
select ch, bin, y, seed_rank, round(score,6) score, lower, upper from (select *, row_number() over (partition by ch, bin order by score, edge_density, band_std, y) seed_rank from (
 select d.ch, y_path y, (y_path-3000)//3000 bin, band_std, edge_density, band_std/10.0::double+edge_density/0.015::double score, 3000 lower, total-3000 upper
 from t_decided d join t_extent t on d.ch=t.ch where y_path between 3000 and total-3000) x) z where seed_rank<=3
""")


def extent(spark, sf):
    return on_path(spark, sf).groupBy("ch").agg((F.max("y") + 500).alias("total"))


def seeds(spark, sf):
    e = S.evidence(spark, sf).withColumn("y", F.col("y_path")).drop("y_path")
    return seeds_of(e.join(e.groupBy("ch").agg((F.max("y") + 500).alias("total")), "ch"))


def seeds_of(c):
    return E.seeds_per_bin(c, F.lit(3000).cast("long"), F.col("total") - 3000)


@query("seeds_per_bin", "select ch, bin, y, seed_rank, score from t_seed")
def seeds_per_bin(spark, sf):
    return out(seeds(spark, sf), "ch", "bin", "y", "seed_rank", score=F.round("score", 6))


@query("refine_candidates", """
select distinct ch, y from (select ch, unnest(generate_series(greatest(lower,y-128), least(upper,y+128), 8)) y from t_seed union all select ch, y from t_seed) x""")
def refine_candidates(spark, sf):
    return out(E.refine(seeds(spark, sf)), "ch", "y")


view("t_region", "select ch, seg, g_start s, g_end e from t_piece where g_end > g_start")


def regions(spark, sf):
    return S.piece(spark, sf).filter("g_end > g_start").select("ch", "seg", F.col("g_start").alias("s"), F.col("g_end").alias("e"))


@query("window_sweep", """
with g as (select *, unnest(generate_series(s+200, e-200, 400)) c from t_region),
 a as (select ch, seg, s, e, c from g union all select ch, seg, s, e, c+1 from g where c+1 <= e-200
  union all select ch, seg, s, e, e-200 from t_region where s+200 <= e-200 union all select ch, seg, s, e, e-201 from t_region where s+200 <= e-201
  union all select ch, seg, s, e, (s+e)//2 from t_region where s+200 > e-200
  union all select ch, seg, s, e, cast(s+round((e-s)/3.0::double*i) as bigint) from t_region cross join (select 1 i union all select 2) k)
select distinct ch, seg, c center from a where c > s and c < e""")
def window_sweep(spark, sf):
    return out(E.window_sweep(regions(spark, sf), ["ch", "seg"], "s", "e", 3), "ch", "seg", "center")


@query("estimate_validations", """
select ch, seg, cast(case when e-s-6000+1 < 1 then 0 else greatest(1, (e-s-6000+1+2999)//3000)*3*34 end as bigint) validations from t_region""")
def estimate_validations(spark, sf):
    return out(regions(spark, sf), "ch", "seg", validations=E.estimate_validations(F.col("e") - F.col("s")))


@query("parity_positions", """
select ch, seg, y%2 parity, count(*) n, min(y) first_y, max(y) last_y from (select ch, seg, unnest(generate_series(s+3000, e-3000)) y from t_region) x group by all""")
def parity_positions(spark, sf):
    p = E.axis_grid(regions(spark, sf), F.col("s") + 3000, F.col("e") - 3000, 1, "y").withColumn("parity", F.col("y") % 2)
    return p.groupBy("ch", "seg", "parity").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("first_y"), F.max("y").alias("last_y"))


view("t_zone", """
with s as (select ch, y, edge_density, crossing_components, sum(n) over (partition by ch order by y) g from (
  select *, case when y - lag(y) over (partition by ch order by y) <= 2 then 0 else 1 end n from t_decided where decision='SAFE') a),
 z as (select ch, g, min(y) zone_start, max(y)+1 zone_end, count(*) n from s group by ch, g)
select ch, zone_start, zone_end, n, y from (select z.*, y, row_number() over (partition by z.ch, z.g order by abs(y-(zone_start+zone_end-1)/2.0), edge_density, crossing_components, y) r
 from z join s on z.ch=s.ch and z.g=s.g) q where r=1
""")


@query("safe_zones", "select * from t_zone")
def safe_zones(spark, sf):
    return out(E.safe_zones(E.safe_only(S.evidence(spark, sf))), "ch", "zone_start", "zone_end", "n", "y")


view("t_anchor", "select ch, total*k//5 anchor_y, total*(k-1)//5 lft, total*(k+1)//5 rgt from t_extent cross join (select unnest(range(1,5)) k) q")
view("t_acand", """
select ch, anchor_y, y, distance, row_number() over (partition by ch, anchor_y order by distance, edge_density, crossing_components, y) rank from (
 select a.ch, anchor_y, y_path y, edge_density, crossing_components, abs(y_path-anchor_y) distance, row_number() over (partition by a.ch, anchor_y order by abs(y_path-anchor_y), y_path) near
 from (select *, cast(floor(least(1800, greatest(240, 0.35::double*least(anchor_y-lft, rgt-anchor_y)))) as bigint) radius from t_anchor) a
 join t_decided d on a.ch=d.ch and decision='SAFE' and y_path between greatest(lft+1, anchor_y-radius) and least(rgt-1, anchor_y+radius)) x where near<=64
""")


def anchors(spark, sf):
    k = extent(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    at = lambda n: F.floor(F.col("total") * n / 5)
    return k.select("ch", at(F.col("k")).alias("anchor_y"), at(F.col("k") - 1).alias("left"), at(F.col("k") + 1).alias("right"))


@query("anchor_candidates", "select ch, anchor_y, y, distance, rank from t_acand")
def anchor_candidates(spark, sf):
    safe = on_path(spark, sf).filter("decision = 'SAFE'")
    return out(E.anchor_candidates(anchors(spark, sf), safe), "ch", "anchor_y", "y", "distance", "rank")


@query("anchor_snap", """
with s as (select a.ch, a.anchor_y, b.y_path is not null onb, c.y safe_y from t_anchor a left join t_decided b on a.ch=b.ch and a.anchor_y=b.y_path and b.edge_density=0
  left join t_acand c on a.ch=c.ch and a.anchor_y=c.anchor_y and c.rank=1),
 t as (select ch, anchor_y, case when onb then anchor_y else safe_y end snapped_y, case when onb then 'source_boundary' when safe_y is not null then 'safe_candidate' else 'none' end snap_source from s)
select *, snapped_y is not null and coalesce(snapped_y > lag(snapped_y) over (partition by ch order by anchor_y), true) order_ok from t""")
def anchor_snap(spark, sf):
    d = on_path(spark, sf)
    s = E.anchor_snap(anchors(spark, sf), d.filter("edge_density = 0"), d.filter("decision = 'SAFE'"))
    return out(s, "ch", "anchor_y", "snapped_y", "snap_source", "order_ok")
