"""Severity tiers, gates, agreement statistics and the inference summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.functions import masks as K
from boxloom.operators import metrics as X
from boxloom.operators import ranks as R
from boxloom.operators import tiers as T
from boxloom.plans import fixtures as V
from boxloom.plans.registry import query

c, lit = F.col, F.lit

V.CTES["meas"] = """select l_orderkey stem, sum(l_quantity)::double dbs, stddev_pop(l_quantity)::double sd, count(*) n, count(*) filter (l_returnflag='N') n_in from lineitem group by 1"""


def _measured(spark, d):
    rows = V.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "stem")
    return T.spread_of(rows, ["stem"], "l_quantity", X.count_if(c("l_returnflag") == "N").alias("n_in"))


_CUTS = "(select quantile_cont(o_totalprice, 1/3::double) low, quantile_cont(o_totalprice, 2/3::double) high from orders{w})"
_TIER = "case when o_totalprice<=low then 'low' when o_totalprice<=high then 'medium' else 'high' end"


@query("tertile_tiers", f"select {_TIER} tier, count(*) n, round(min(o_totalprice),4) least, round(max(o_totalprice),4) most from orders, {_CUTS.format(w='')} k group by 1")
def tertile_tiers(spark, d):
    o = V.table(spark, d, "orders").select("o_totalprice")
    t = T.with_tiers(o, "o_totalprice", T.tertile_cuts(o, "o_totalprice"))
    return t.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 4).alias("least"), F.round(F.max("o_totalprice"), 4).alias("most"))


def _frozen(spark, d):
    o = V.table(spark, d, "orders").join(V.splits(spark, d), c("o_orderkey") == c("image_id"))
    return T.with_tiers(o, "o_totalprice", T.tertile_cuts(o, "o_totalprice", c("split") == "train"))


_FROZEN = f"select o.*, split, {_TIER} tier from orders o join spl on image_id=o_orderkey, {_CUTS.format(w=' join spl on image_id=o_orderkey where split=' + chr(39) + 'train' + chr(39))} k"


@query("frozen_cuts", V.sql("spl", f"select split, tier, count(*) n from ({_FROZEN}) f group by 1, 2"))
def frozen_cuts(spark, d):
    """Cuts learned on the training split, applied to all."""
    return _frozen(spark, d).groupBy("split", "tier").agg(F.count("*").alias("n"))


@query("tier_contingency", V.sql("spl", f"""select split, (count(*) filter (tier='low')) n_low, (count(*) filter (tier='medium')) n_medium, (count(*) filter (tier='high')) n_high, (count(*) filter (o_orderkey%13=0)) n_unlabeled, count(distinct o_custkey) n_groups,
 count(*)=count(distinct o_orderkey) unique_keys, (select max(n) from (select count(*) n from orders join spl s on s.image_id=o_orderkey where s.split=f.split group by o_custkey)) largest_group from ({_FROZEN}) f group by split"""))
def tier_contingency(spark, d):
    f = _frozen(spark, d)
    n = lambda t: X.count_if(c("tier") == t).alias(f"n_{t}")
    largest = f.groupBy("split", "o_custkey").agg(F.count("*").alias("n")).groupBy("split").agg(F.max("n").alias("largest_group"), F.count("*").alias("n_groups"))
    s = f.groupBy("split").agg(n("low"), n("medium"), n("high"), X.count_if(c("o_orderkey") % 13 == 0).alias("n_unlabeled"), (F.count("*") == F.countDistinct("o_orderkey")).alias("unique_keys"))
    return s.join(largest, "split")


@query("percentile_profile", "select l_returnflag grp, list_transform(quantile_cont(l_extendedprice, [0.05,0.1,0.25,0.5,0.75,0.9,0.95]), lambda x: round(x,4))::varchar p from lineitem group by 1".replace("list_transform(quantile_cont(l_extendedprice, [0.05,0.1,0.25,0.5,0.75,0.9,0.95]), lambda x: round(x,4))::varchar p", ", ".join(f"round(quantile_cont(l_extendedprice, {q}::double),4) p{int(q * 100):02d}" for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))))
def percentile_profile(spark, d):
    qs = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    rows = V.table(spark, d, "lineitem").select(c("l_returnflag").alias("grp"), "l_extendedprice")
    p = R.quantiles(rows, ["grp"], "l_extendedprice", qs)
    return p.select("grp", *[F.round(f"q{i}", 4).alias(f"p{int(q * 100):02d}") for i, q in enumerate(qs)])


@query("snr_gate", V.sql("meas", """select case when sd is null or sd=0 then 'excluded' when dbs/sd/10>2 then 'clean' when dbs/sd/10>=1 then 'marginal' else 'noise' end band, count(*) n, round(avg(sd),6) mean_sd from meas group by 1"""))
def snr_gate(spark, d):
    m = _measured(spark, d).withColumn("r", c("snr") / 10)
    return m.groupBy(F.coalesce(T.snr_band(c("r")), lit("excluded")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("sd"), 6).alias("mean_sd"))


@query("clean_filter", V.sql("meas", "select count(*) n, count(*) filter (stem%9<>0 and sd>0 and dbs/sd>20) n_clean from meas"))
def clean_filter(spark, d):
    """Ratios written as text, some unreadable, as are those of rows without a key."""
    text = F.when(c("stem") % 9 != 0, (c("snr") / 10).cast("string")).otherwise(lit("n/a"))
    finite = c("sd") > 0
    m = _measured(spark, d)
    return m.agg(F.count("*").alias("n"), X.count_if(T.is_clean(text) & F.coalesce(finite, lit(False))).alias("n_clean"))


@query("measurement_flags", V.sql("meas", """with f as (select n, case when n*10<20 then 'mask_fail' when n*80<200 then 'ring_fail' when stem%17=0 then 'ransac_fail' when n_in/n::double<0.5 then 'low_inlier' else '' end flag, n_in/n::double share from meas)
 select flag, count(*) n, round(avg(share),6) mean_inlier, round(min(share),6) least_inlier from f group by 1"""))
def measurement_flags(spark, d):
    share = F.try_divide(c("n_in"), c("n"))
    m = _measured(spark, d).select(T.measurement_flag(c("n") * 10, c("n") * 80, c("stem") % 17 != 0, share).alias("flag"), share.alias("share"))
    return m.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("mean_inlier"), F.round(F.min("share"), 6).alias("least_inlier"))


_SHARE = "(x2-x1)*(y2-y1)/518400"


@query("calibration_gate", V.sql("gt dom", f"""select "domain", count(*) n, count(*) filter ({_SHARE}>=0.05) n_calibrated, round(median({_SHARE}),6) median_share, case when avg({_SHARE})<0.02 then 'far/dashcam' when avg({_SHARE})<0.08 then 'mid' else 'close-up' end label from gt join dom using (image_id) group by 1"""))
def calibration_gate(spark, d):
    s = G.area_share(c("x1"), c("y1"), c("x2"), c("y2"), 720.0, 720.0)
    b = V.gt_boxes(spark, d).select("image_id", s.alias("s")).join(V.domains(spark, d), "image_id")
    median = R.quantiles(b, ["domain"], "s", [0.5]).select("domain", F.round("q0", 6).alias("median_share"))
    counts = b.groupBy("domain").agg(F.count("*").alias("n"), X.count_if(G.calibrated("s", 0.05)).alias("n_calibrated"), G.domain_label(F.avg("s")).alias("label"))
    return counts.join(median, "domain", "left")


@query("gate_shares", V.sql("gt dom", f"""select "domain", t threshold, round(avg(case when {_SHARE}>=t then 1.0::double else 0 end)*100,6) pct from gt join dom using (image_id), (select unnest([0.01::double,0.02,0.05,0.123]) t) k group by 1, 2"""))
def gate_shares(spark, d):
    s = G.area_share(c("x1"), c("y1"), c("x2"), c("y2"), 720.0, 720.0)
    b = V.gt_boxes(spark, d).select("image_id", s.alias("s")).join(V.domains(spark, d), "image_id")
    return T.shares_above(b, "domain", "s", [0.01, 0.02, 0.05, 0.123]).withColumn("pct", F.round("pct", 6))


@query("inference_summary", """with b as (select l_returnflag cls, case when l_extendedprice<20000 then 'low' when l_extendedprice<50000 then 'medium' else 'high' end tier, l_quantity>25 cal, l_quantity>2 crop from lineitem),
 k as (select unnest(['low','medium','high']) tier, unnest([true,true,true]) x), g as (select tier, cal from k, (select unnest([true,false]) cal) z)
 select 'class' part, cls name, null::boolean calibrated, count(*) n from b group by 2 union all select 'tier', g.tier, g.cal, count(b.tier) from g left join b on b.tier=g.tier and b.cal=g.cal and b.crop group by 2, 3""")
def inference_summary(spark, d):
    """Counts by class, and by tier and calibration, zero-filled; an empty crop counts for its class only."""
    p, q = c("l_extendedprice"), c("l_quantity")
    tier = F.when(p < 20000, "low").when(p < 50000, "medium").otherwise("high")
    b = V.table(spark, d, "lineitem").select(c("l_returnflag").alias("cls"), tier.alias("tier"), (q > 25).alias("calibrated"), (q > 2).alias("crop"))
    from boxloom.pipeline import summary

    return summary(b)


@query("display_category", """select case when l_quantity<=25 then 'uncalibrated' when l_extendedprice<20000 then 'low' when l_extendedprice<50000 then 'medium' else 'high' end colour, count(*) n from lineitem group by 1""")
def display_category(spark, d):
    from boxloom.pipeline import display_category as shown

    tier = F.when(c("l_extendedprice") < 20000, "low").when(c("l_extendedprice") < 50000, "medium").otherwise("high")
    return V.table(spark, d, "lineitem").groupBy(shown(tier, c("l_quantity") > 25).alias("colour")).agg(F.count("*").alias("n"))


_CONF = """with j as (select case quality when 1 then 'good' else 'bad' end t, case when n_chars<500 then 'bad' when n_chars<3000 then 'good' else 'long' end g from labels join documents using (doc_id)),
 l as (select unnest(['bad','good','long']) x), m as (select a.x truth, b.x guess, count(j.t) n from l a cross join l b left join j on j.t=a.x and j.g=b.x group by 1, 2)"""


def _matrix(spark, d):
    g = F.when(c("n_chars") < 500, "bad").when(c("n_chars") < 3000, "good").otherwise("long")
    j = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", g.alias("g")), "doc_id")
    return X.confusion(j.select(F.when(c("quality") == 1, "good").otherwise("bad").alias("t"), "g"), "t", "g", ["bad", "good", "long"])


@query("confusion_matrix", _CONF + " select truth, guess, n from m")
def confusion_matrix(spark, d):
    return _matrix(spark, d)


@query("confusion_f1", _CONF + """, s as (select x label, coalesce(sum(n) filter (truth=x and guess=x),0) tp, coalesce(sum(n) filter (truth=x),0) nt, coalesce(sum(n) filter (guess=x),0) ng from m, l group by 1)
 select label, round(coalesce(tp/nullif(ng,0)::double,0),6) "precision", round(coalesce(tp/nullif(nt,0)::double,0),6) recall, round(coalesce(2*tp/nullif(nt+ng,0)::double,0),6) f1 from s
 union all select 'macro', round(avg(coalesce(tp/nullif(ng,0)::double,0)),6), round(avg(coalesce(tp/nullif(nt,0)::double,0)),6), round(avg(coalesce(2*tp/nullif(nt+ng,0)::double,0)),6) from s""")
def confusion_f1(spark, d):
    """Scores over a fixed list of labels, whether or not they occur."""
    s = X.class_scores(_matrix(spark, d))
    s = s.unionByName(s.agg(lit("macro").alias("label"), *[F.avg(x).alias(x) for x in ("precision", "recall", "f1")]))
    return s.select("label", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("spearman_area_tier", """with r as (select rank() over (order by l_quantity)+(count(*) over (partition by l_quantity)-1)/2 a, rank() over (order by l_extendedprice)+(count(*) over (partition by l_extendedprice)-1)/2 b from lineitem) select round(corr(a,b),6) rho, count(*) n from r""")
def spearman_area_tier(spark, d):
    return R.spearman(V.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"), "n")


# Twice the tail of Student's t, by Simpson's rule over the density in 4000 steps.
_TAIL = """with r as (select rank() over (order by {a})+(count(*) over (partition by {a})-1)/2 a, rank() over (order by {b})+(count(*) over (partition by {b})-1)/2 b from {t}),
 k as (select corr(a,b) rho, count(*) n, count(*)-2 d from r), h as (select *, abs(rho)*sqrt(d/(1-rho*rho)) t, exp(lgamma((d+1)/2.0::double)-lgamma(d/2.0::double))/sqrt(d*pi()) k0 from k),
 i as (select sum((case when j=0 or j=4000 then 1 when j%2=1 then 4 else 2 end)*k0*pow(1+pow(t*j/4000.0::double,2)/d, -(d+1)/2.0::double))*any_value(t)/12000.0::double s from h, (select unnest(range(4001)) j))
 select round(rho,6) rho, round(1-2*s,6) p, n from h, i"""


@query("spearman_p_value", _TAIL.format(a="l.quality", b="d.n_chars", t="labels l join documents d using (doc_id)"))
def spearman_p_value(spark, d):
    """Whether longer documents are labelled better: rank correlation and its significance."""
    rows = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return R.spearman(rows, "quality", "n_chars").select(F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"), "n")


@query("confusion_f1_present", _CONF + """, o as (select distinct unnest([truth, guess]) x from m where n>0), q as (select m.* from m join o a on a.x=truth join o b on b.x=guess),
 s as (select x label, coalesce(sum(n) filter (truth=x and guess=x),0) tp, coalesce(sum(n) filter (truth=x),0) nt, coalesce(sum(n) filter (guess=x),0) ng from q, o group by 1)
 select count(*) n_labels, round(avg(coalesce(2*tp/nullif(nt+ng,0)::double,0)),6) macro_f1 from s""")
def confusion_f1_present(spark, d):
    """The mean over the labels that occur only."""
    s = X.class_scores(X.present(_matrix(spark, d)))
    return s.agg(F.count("*").alias("n_labels"), F.round(F.avg("f1"), 6).alias("macro_f1"))


_UNCAL = """select l_orderkey image_id, l_linenumber pred_idx, case when l_quantity>25 then l_returnflag||' '||printf('%.2f',l_discount::double)||' | '||l_linestatus||' '||printf('%.2f',l_tax::double)
 else l_returnflag||' '||printf('%.2f',l_discount::double)||' | '||l_linestatus||'* uncal' end label from lineitem"""


@query("box_labels", f"select label, count(*) n from ({_UNCAL}) u group by 1")
def box_labels(spark, d):
    """The texts beside boxes, counted."""
    from boxloom.pipeline import box_label

    text = box_label(c("l_returnflag"), c("l_discount").cast("double"), c("l_linestatus"), c("l_tax").cast("double"), c("l_quantity") > 25)
    return V.table(spark, d, "lineitem").groupBy(text.alias("label")).agg(F.count("*").alias("n"))


_PIXELS = "(select image_id, x, y from (select image_id, unnest(range(floor(x1/16)::bigint,floor(x2/16)::bigint)) x, y1, y2 from gt), lateral (select unnest(range(floor(y1/16)::bigint,floor(y2/16)::bigint)) y) t)"


@query("mask_coverage", V.sql("gt dom", f"""select "domain", count(*) n_images, round(avg(n),6) mean_instances, round(avg(coalesce(k,0)*100/2025.0::double),6) mean_coverage from
 (select image_id, count(*) n from gt group by 1) g join dom using (image_id) left join (select image_id, count(distinct x*45+y) k from {_PIXELS} p group by 1) z using (image_id) group by 1"""))
def mask_coverage(spark, d):
    """Mean number of instances of an image, and how much of it their masks cover together, in tiles of 16 pixels."""
    at = lambda x: F.floor(c(x) / 16)
    runs = K.box_runs(at("x1"), at("y1"), at("x2"), at("y2"), 45)
    masks = V.gt_boxes(spark, d).groupBy("image_id").agg(F.count("*").alias("n"), F.flatten(F.collect_list(runs)).alias("runs"))
    rows = masks.select("image_id", "n", K.coverage(c("runs"), 45, 45).alias("covered")).join(V.domains(spark, d), "image_id")
    return rows.groupBy("domain").agg(F.count("*").alias("n_images"), F.round(F.avg("n"), 6).alias("mean_instances"), F.round(F.avg("covered"), 6).alias("mean_coverage"))
