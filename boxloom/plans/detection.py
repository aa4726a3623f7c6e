"""Detection quality: matching, per-domain metrics, sweeps, precision-recall and misses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import geometry as G
from boxloom.operators import matching as M
from boxloom.operators import metrics as X
from boxloom.operators.duplicates import checkpointed, tolerant_boxes
from boxloom.plans import fixtures as V
from boxloom.plans.registry import query

_PRF = """round(tp/nullif(tp+fp,0)::double,6) "precision", round(tp/nullif(n_gt,0)::double,6) recall,
 round(2*(tp/nullif(tp+fp,0)::double)*(tp/nullif(n_gt,0)::double)/nullif(tp/nullif(tp+fp,0)::double+tp/nullif(n_gt,0)::double,0),6) f1"""


def _per_domain(ev: str) -> str:
    return f"""select coalesce(domain,'OVERALL') "domain", sum(g)::bigint n_gt, sum(p)::bigint n_pred, sum(t)::bigint tp, (sum(p)-sum(t))::bigint fp, (sum(g)-sum(t))::bigint fn
 from (select "domain", 1 g, 0 t, 0 p from gt join dom using (image_id) union all
 select "domain", 0, is_tp::int, 1 from {ev} join dom using (image_id) where conf>=0.2::double) u group by rollup("domain")"""


@query("eval_per_domain", V.sql("ev dom", f"select *, {_PRF} from ({_per_domain('ev')}) q"))
def eval_per_domain(spark, d):
    gt = V.shared_boxes(spark, d)
    return X.with_ratios(X.by_domain(V.events(spark, d, gt=gt), gt, V.domains(spark, d), 0.2))


@query(
    "model_comparison",
    V.sql("ev ev2 dom", f"""select "domain", a.n_gt, a.tp tp_a, b.tp tp_b, a.fp fp_a, b.fp fp_b, round((b.tp-a.tp)/nullif(a.n_gt,0)::double,6) recall_gain
 from ({_per_domain('ev')}) a join ({_per_domain('ev2')}) b using ("domain")"""),
)
def model_comparison(spark, d):
    gt, dom = V.gt_boxes(spark, d), V.domains(spark, d)
    a, b = (X.by_domain(V.events(spark, d, j), gt, dom, 0.2).select("domain", F.col("n_gt").alias(f"n{j}"), F.col("tp").alias(f"tp{j}"), F.col("fp").alias(f"fp{j}")) for j in (1, 2))
    return a.join(b, "domain").select(
        "domain", F.col("n1").alias("n_gt"), F.col("tp1").alias("tp_a"), F.col("tp2").alias("tp_b"), F.col("fp1").alias("fp_a"), F.col("fp2").alias("fp_b"),
        F.round(F.try_divide(F.col("tp2") - F.col("tp1"), F.col("n1")), 6).alias("recall_gain"),
    )


_SCALE = (640.0 / 720.0) ** 2
_BUCKET = "case when {a}<1024 then 'small' when {a}<=9216 then 'medium' else 'large' end"
_AREA = f"(x2-x1)*(y2-y1)*{_SCALE!r}::double"


@query(
    "eval_size_stratified",
    V.sql("ev", f"""with g as (select image_id, box_index, {_BUCKET.format(a=_AREA)} bucket from gt), p as (select image_id, pred_idx, {_BUCKET.format(a=_AREA)} bucket from det),
 u as (select bucket, 1 n, 0 t0, 0 t1, 0 f1 from g union all
 select case when is_tp then g.bucket else p.bucket end, 0, is_tp::int, (is_tp and conf>=0.25::double)::int, (not is_tp and conf>=0.25::double)::int
 from ev join p using (image_id, pred_idx) left join g on g.image_id=ev.image_id and g.box_index=ev.gt_idx)
 select bucket, sum(n)::bigint n_gt, round(sum(t0)/nullif(sum(n),0)::double,6) recall_low, round(sum(t1)/nullif(sum(n),0)::double,6) recall_op,
 round(sum(t1)/nullif(sum(t1)+sum(f1),0)::double,6) precision_op from u group by bucket"""),
)
def eval_size_stratified(spark, d):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * F.lit(_SCALE)
    gt, det = V.gt_boxes(spark, d), V.detections(spark, d)
    g = gt.select("image_id", F.col("box_index").alias("gt_idx"), G.size_bucket(area).alias("g_bucket"))
    p = det.select("image_id", "pred_idx", G.size_bucket(area).alias("p_bucket"))
    ev = M.greedy_match(gt, gt, det, crowded=V.crowded(spark, d)).where("conf >= 0.001").join(p, ["image_id", "pred_idx"]).join(g, ["image_id", "gt_idx"], "left")
    op = F.col("conf") >= 0.25
    one = lambda c: F.when(c, 1).otherwise(0)
    # A true one counts for its box's size, a false one for its own.
    e = ev.select(F.when(F.col("is_tp"), F.col("g_bucket")).otherwise(F.col("p_bucket")).alias("bucket"), F.lit(0).alias("n"), one(F.col("is_tp")).alias("t0"), one(F.col("is_tp") & op).alias("t1"), one(~F.col("is_tp") & op).alias("f1"))
    u = e.unionByName(g.select(F.col("g_bucket").alias("bucket"), F.lit(1).alias("n"), *[F.lit(0).alias(c) for c in ("t0", "t1", "f1")]))
    s = u.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "t0", "t1", "f1")])
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    return s.select("bucket", F.col("n").alias("n_gt"), r(F.col("t0"), F.col("n")).alias("recall_low"), r(F.col("t1"), F.col("n")).alias("recall_op"), r(F.col("t1"), F.col("t1") + F.col("f1")).alias("precision_op"))


_SWEEP = """select split, i*0.05::double conf, (count(*) filter (is_tp and e.conf>=i*0.05::double))::bigint tp, (count(*) filter (not is_tp and e.conf>=i*0.05::double))::bigint fp, any_value(n_gt)::bigint n_gt
 from (select split, n_gt, i from (select split, count(*) n_gt from gt join spl using (image_id) where split<>'train' group by 1) n, (select unnest(range(1,11))::double i) t) g
 left join (select split, ev.conf, is_tp from ev join spl using (image_id)) e using (split) group by 1, i"""


def _sweep(spark, d):
    spl = V.splits(spark, d).where("split <> 'train'")
    ev = V.events(spark, d).join(spl, "image_id")
    totals = V.gt_boxes(spark, d).join(spl, "image_id").groupBy("split").agg(F.count("*").alias("n_gt"))
    return X.with_ratios(X.sweep(ev, totals, ["split"]))


@query("threshold_sweep", V.sql("ev spl", f"select split, round(conf,6) conf, tp, fp, n_gt, {_PRF} from ({_SWEEP}) s"))
def threshold_sweep(spark, d):
    return _sweep(spark, d).withColumn("conf", F.round("conf", 6))


@query(
    "operating_point",
    V.sql("ev spl", f"""with s as (select split, conf, tp, fp, n_gt, {_PRF} from ({_SWEEP}) s),
 c as (select 'best_f1' rule, conf, row_number() over (order by f1 desc nulls last, conf) k from s where split='val' union all
 select 'precision_floor', conf, row_number() over (order by recall desc nulls last, conf) from s where split='val' and "precision">=0.5)
 select rule, round(c.conf,6) conf, t.tp, t.fp, t.n_gt, t."precision", t.recall, t.f1 from c join s t on t.conf=c.conf and t.split='test' where k=1"""),
)
def operating_point(spark, d):
    """Chosen on the validation split, reported on the test split."""
    s = checkpointed(_sweep(spark, d))  # twenty rows, read three times
    val = s.where("split = 'val'")
    f1 = X.best_row(val.withColumn("rule", F.lit("best_f1")), ["rule"], [F.col("f1").desc_nulls_last(), F.col("conf")])
    floor = X.best_row(val.where("precision >= 0.5").withColumn("rule", F.lit("precision_floor")), ["rule"], [F.col("recall").desc_nulls_last(), F.col("conf")])
    chosen = f1.unionByName(floor).select("rule", F.col("conf").alias("at"))
    t = s.where("split = 'test'")
    return t.join(F.broadcast(chosen), t.conf == chosen["at"]).select("rule", F.round("conf", 6).alias("conf"), "tp", "fp", "n_gt", "precision", "recall", "f1")


_AP = """with e as (select "domain", ev.* from ev join dom using (image_id) union all select 'OVERALL', ev.* from ev join dom using (image_id)),
 n as (select "domain", count(*) n_gt from gt join dom using (image_id) group by 1 union all select 'OVERALL', count(*) from gt join dom using (image_id)),
 c as (select "domain", n_gt, sum(is_tp::int) over w tp, row_number() over w k from e join n using ("domain") window w as (partition by "domain" order by conf desc, image_id, pred_idx)),
 q as (select "domain", tp/n_gt::double r, max(tp/k::double) over (partition by "domain" order by k rows between current row and unbounded following) p from c)
 select "domain", round(sum(coalesce(m,0))/101,6) ap from (select n."domain", i, (select max(p) from q where q."domain"=n."domain" and r>=i*0.01::double) m
 from n, (select unnest(range(0,101))::double i) t) z group by 1"""


def _by_domain_and_all(df, dom):
    own = df.join(dom, "image_id")
    return own.unionByName(own.withColumn("domain", F.lit("OVERALL")))


@query("average_precision_by_domain", V.sql("ev dom", _AP))
def average_precision_by_domain(spark, d):
    dom, gt = V.domains(spark, d), V.shared_boxes(spark, d)
    totals = _by_domain_and_all(gt.select("image_id"), dom).groupBy("domain").agg(F.count("*").alias("n_gt"))
    # Ranks, ties and totals each read the events.
    own = checkpointed(V.events(spark, d, gt=gt).join(dom, "image_id"))
    ap = X.average_precision(own.unionByName(own.withColumn("domain", F.lit("OVERALL"))), totals, ["domain"])
    return ap.select("domain", F.round("ap", 6).alias("ap"))


@query("ap50_101pt", V.sql("ev dom", _AP).replace('select "domain", round(sum', "select count(*)::bigint n_thresholds, round(sum").replace(") z group by 1", ") z where \"domain\"='OVERALL'"))
def ap50_101pt(spark, d):
    dom = V.domains(spark, d).select("image_id")
    boxes = V.shared_boxes(spark, d)
    gt, ev = boxes.join(dom, "image_id", "left_semi"), checkpointed(V.events(spark, d, gt=boxes).join(dom, "image_id", "left_semi"))
    one = lambda df: df.withColumn("all", F.lit(1))
    ap = X.average_precision(one(ev), one(gt).groupBy("all").agg(F.count("*").alias("n_gt")), ["all"])
    return ap.select(F.lit(101).cast("long").alias("n_thresholds"), F.round("ap", 6).alias("ap"))


@query(
    "pr_curve",
    V.sql("ev spl", """select split, row_number() over w n, round(ev.conf,6) conf, round(sum(is_tp::int) over w/(row_number() over w)::double,6) "precision", round(sum(is_tp::int) over w/n_gt::double,6) recall
 from ev join spl using (image_id) join (select split, count(*) n_gt from gt join spl using (image_id) group by 1) t using (split) where split='val'
 window w as (partition by split order by ev.conf desc, image_id, pred_idx rows unbounded preceding)"""),
)
def pr_curve(spark, d):
    val = V.splits(spark, d).where("split = 'val'")
    totals = V.gt_boxes(spark, d).join(val, "image_id").groupBy("split").agg(F.count("*").alias("n_gt"))
    r = X.ranked(V.events(spark, d).join(val, "image_id"), ["split"]).join(F.broadcast(totals), "split")
    return r.select("split", "n", F.round("conf", 6).alias("conf"), F.round(F.col("cum_tp") / F.col("n"), 6).alias("precision"), F.round(F.col("cum_tp") / F.col("n_gt"), 6).alias("recall"))


@query(
    "iou_pairs",
    V.sql("pairs", "select image_id, gt_idx, pred_idx, round(iou,6) iou from pairs where iou>=0.5"),
)
def iou_pairs(spark, d):
    gt, det = V.gt_boxes(spark, d), V.detections(spark, d)
    crowded = checkpointed(V.crowded(spark, d))
    p = M.candidate_pairs(gt, det, crowded=None if crowded.isEmpty() else crowded)
    return p.select("image_id", "gt_idx", "pred_idx", F.round("iou", 6).alias("iou"))


@query("match_events", V.sql("ev", "select image_id, pred_idx, round(conf,6) conf, is_tp, gt_idx from ev"))
def match_events(spark, d):
    return V.events(spark, d).withColumn("conf", F.round("conf", 6))


_BEST = """select g.image_id, g.box_index gt_idx, (g.x2-g.x1)*(g.y2-g.y1) area, max(p.conf) filter (p.iou>=0.5) best_conf, max(p.conf) overlap_conf
 from gt g left join pairs p on p.image_id=g.image_id and p.gt_idx=g.box_index group by all"""


def _best(spark, d):
    gt = V.gt_boxes(spark, d)
    area = gt.select("image_id", F.col("box_index").alias("gt_idx"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    return M.best_per_box(gt, V.detections(spark, d)).join(area, ["image_id", "gt_idx"])


@query(
    "miss_taxonomy",
    V.sql("pairs", f"""with k as (select *, case when best_conf is null then 'localization' when best_conf<0.25::double then 'confidence' else 'found' end kind from ({_BEST}) b),
 e as (select *, row_number() over (partition by kind order by image_id, gt_idx) nth, count(*) over (partition by kind) n from k)
 select kind, n, image_id, gt_idx, round(overlap_conf,6) overlap_conf from e where nth<=4"""),
)
def miss_taxonomy(spark, d):
    """Count of each kind and its first four boxes."""
    k = _best(spark, d).withColumn("kind", M.miss_kind(F.col("best_conf")))
    counts = k.groupBy("kind").agg(F.count("*").alias("n"))
    first = k.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("image_id", "gt_idx"))).where("nth <= 4")
    return first.join(F.broadcast(counts), "kind").select("kind", "n", "image_id", "gt_idx", F.round("overlap_conf", 6).alias("overlap_conf"))


@query(
    "recall_by_side",
    V.sql("pairs", f"""select case when sqrt(area)<16 then '<16' when sqrt(area)<32 then '16-32' else '>=32' end side, count(*) n_gt,
 round(avg((coalesce(best_conf,-1)>=0.001::double)::int),6) recall_low, round(avg((coalesce(best_conf,-1)>=0.25::double)::int),6) recall_op from ({_BEST}) b group by 1"""),
)
def recall_by_side(spark, d):
    b = _best(spark, d).withColumn("side", G.side_bucket("area"))
    hit = lambda t: F.round(F.avg(F.when(F.col("best_conf") >= t, 1).otherwise(0)), 6)
    return b.groupBy("side").agg(F.count("*").alias("n_gt"), hit(0.001).alias("recall_low"), hit(0.25).alias("recall_op"))


@query(
    "gt_tolerance_dedup",
    V.sql("dom", """with r as (select l_orderkey image_id, l_partkey p, l_suppkey s, 8+4*cast(l_quantity as int) w, 8+3*cast(l_quantity as int) h from lineitem),
 b as (select image_id, count(*) n, count(distinct ((p*37)%(720-w), (s*53)%(720-h), w, h)) k from r group by 1)
 select coalesce("domain",'OVERALL') "domain", sum(n)::bigint n_before, sum(k)::bigint n_after from b join dom using (image_id) group by rollup("domain")"""),
)
def gt_tolerance_dedup(spark, d):
    raw = V.raw_boxes(spark, d)
    boxes = raw.select("image_id", "box_index", "p", "s", "x1", "y1", "x2", "y2")
    kept = tolerant_boxes(boxes, ["image_id"], ["box_index", "p", "s"], ["x1", "y1", "x2", "y2"]).groupBy("image_id").agg(F.count("*").alias("k"))
    n = raw.groupBy("image_id").agg(F.count("*").alias("n")).join(kept, "image_id").join(V.domains(spark, d), "image_id")
    r = n.rollup("domain").agg(F.grouping("domain").alias("g"), F.sum("n").alias("n_before"), F.sum("k").alias("n_after"))
    return r.select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("domain")).alias("domain"), "n_before", "n_after")
