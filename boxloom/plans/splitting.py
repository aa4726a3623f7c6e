"""Group splits, folds, samples, caps and their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.operators import splits as S
from boxloom.operators.metrics import count_if
from boxloom.plans import fixtures as V
from boxloom.plans.registry import query

c, lit = F.col, F.lit
SPLIT = {"train": 0.7, "val": 0.15, "test": 0.15}
FOLDS = {f"fold{i}": 0.2 for i in range(5)}


def _fill(targets: dict[str, float]) -> str:
    """The same fold in SQL, a step a group."""
    names = list(targets)
    level = lambda n: f"f.c_{n}/{targets[n]}::double"
    least = f"least({', '.join(level(n) for n in names)})"
    pick = "case " + " ".join(f"when {level(n)}={least} then '{n}'" for n in names) + " end"
    return f"""with recursive gr as (select p_partkey//10 unit, max(p_size)%3 stratum, count(*) n from part group by 1), od as materialized (select unit, stratum, n, row_number() over (order by stratum::varchar, md5('1337:'||unit), unit::varchar) k from gr),
 fl(k, unit, bucket, {', '.join(f'c_{n}' for n in names)}) as (select 0::bigint, null::bigint, null::varchar, {', '.join('0::bigint' for _ in names)}
 union all select o.k, o.unit, {pick}, {', '.join(f"f.c_{n}+case when {pick}='{n}' then o.n else 0 end" for n in names)} from fl f join od o on o.k=f.k+1)"""


def _groups(spark, d):
    g = V.table(spark, d, "part").groupBy((c("p_partkey") / 10).cast("long").alias("unit"))
    return g.agg((F.max("p_size") % 3).alias("stratum"), F.count("*").alias("size"))


def _filled(spark, d, targets):
    return S.water_fill(_groups(spark, d), targets, 1337).withColumn("unit", c("unit").cast("long"))


@query("waterfill_split", V.sql("", _fill(SPLIT) + " select unit, bucket from fl where k>0"))
def waterfill_split(spark, d):
    return _filled(spark, d, SPLIT)


@query("fold_assign", V.sql("", _fill(FOLDS) + " select unit, bucket from fl where k>0"))
def fold_assign(spark, d):
    return _filled(spark, d, FOLDS)


@query("split_contingency", V.sql("", _fill(SPLIT) + """ select bucket, count(*) n_groups, sum(n)::bigint n_rows, (count(*) filter (stratum=0)) s0, (count(*) filter (stratum=1)) s1, (count(*) filter (stratum=2)) s2, max(least(n,3))::bigint most_counted from fl join od using (unit) where fl.k>0 group by 1"""))
def split_contingency(spark, d):
    j = _filled(spark, d, SPLIT).join(_groups(spark, d), "unit")
    s = lambda i: count_if(c("stratum") == i).alias(f"s{i}")
    return j.groupBy("bucket").agg(F.count("*").alias("n_groups"), F.sum("size").alias("n_rows"), s(0), s(1), s(2), F.max(F.least("size", lit(3))).cast("long").alias("most_counted"))


@query("split_invariants", V.sql("", _fill(SPLIT) + """, r as (select p_partkey, bucket, unit, p_size%3 st from part join fl on fl.unit=p_partkey//10 and fl.k>0) select count(*) n_rows, count(distinct p_partkey) n_keys, count(*)-count(distinct p_partkey) n_twice,
 (select count(*) from (select unit from r group by 1 having count(distinct bucket)>1)) n_spanning, (select min(n) from (select count(*) filter (bucket='test') n from r group by st))>0 every_stratum_tested from r"""))
def split_invariants(spark, d):
    """No group spans splits, each row is placed once, and every stratum is tested."""
    p = V.table(spark, d, "part").select("p_partkey", (c("p_partkey") / 10).cast("long").alias("unit"), (c("p_size") % 3).alias("st"))
    r = p.join(_filled(spark, d, SPLIT), "unit")
    spans = S.spanning_groups(r, "unit", "bucket").agg(F.count("*").alias("n_spanning"))
    tested = r.groupBy("st").agg(count_if(c("bucket") == "test").alias("n")).agg((F.min("n") > 0).alias("every_stratum_tested"))
    return S.coverage(r, "p_partkey").crossJoin(F.broadcast(spans)).crossJoin(F.broadcast(tested))


@query("background_cap", """with e as (select event_id, event_type='error' bg from events), n as (select cast(trunc(0.30::double/(1-0.30::double)*count(*) filter (not bg)) as bigint) m from e),
 k as (select *, row_number() over (partition by bg order by md5('0:'||event_id), event_id) r from e) select event_id, bg background from k, n where not bg or r<=m""")
def background_cap(spark, d):
    e = V.table(spark, d, "events").select("event_id", (c("event_type") == "error").alias("background"))
    return S.cap_backgrounds(e, c("background"), "event_id", 0)


@query("background_drop_report", """with e as (select event_id, user_id%4 source, event_type<>'click' bg from events), n as (select cast(trunc(0.30::double/(1-0.30::double)*count(*) filter (not bg)) as bigint) m from e),
 k as (select *, row_number() over (partition by bg order by md5('0:'||event_id), event_id) r from e) select source, count(*) n_background, count(*) filter (r<=m) n_kept, count(*) filter (r>m) n_dropped from k, n where bg group by 1""")
def background_drop_report(spark, d):
    """Backgrounds kept and dropped by source."""
    e = V.table(spark, d, "events").select("event_id", (c("user_id") % 4).alias("source"), (c("event_type") != "click").alias("bg"))
    kept = S.cap_backgrounds(e, c("bg"), "event_id", 0).where("bg").select("event_id", lit(1).alias("k"))
    j = e.where("bg").join(kept, "event_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n_background"), count_if(c("k") == 1).alias("n_kept"), count_if(c("k").isNull()).alias("n_dropped"))


@query("oversample_x3", "select event_id, unnest(range(1, case when event_type='error' then 4 else 2 end)) copy from events")
def oversample_x3(spark, d):
    e = V.table(spark, d, "events").select("event_id", (c("event_type") == "error").alias("pos"))
    return S.oversample(e, c("pos")).select("event_id", c("copy").cast("long").alias("copy"))


@query("sample_per_cell", "select event_type, user_id%5 cell, event_id from (select *, row_number() over (partition by event_type, user_id%5 order by md5('42:'||event_id), event_id) k from events) where k<=2")
def sample_per_cell(spark, d):
    e = V.table(spark, d, "events").select("event_type", (c("user_id") % 5).alias("cell"), "event_id")
    w = Window.partitionBy("event_type", "cell").orderBy(S.seeded(42, c("event_id")), "event_id")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 2").drop("k")


@query("first_positives", "select event_type, event_id from (select *, row_number() over (partition by event_type order by event_id) k from events where value>50) where k<=3")
def first_positives(spark, d):
    e = V.table(spark, d, "events").where("value > 50").select("event_type", "event_id")
    return e.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).where("k <= 3").drop("k")


@query("timestamp_group_split", """with k as (select distinct strftime(ts,'%Y%m%d_%H') g from events), n as (select g, row_number() over (order by md5('7:'||g), g)-1 i, count(*) over () n from k),
 s as (select g, case when i<cast(trunc(n*0.7::double) as bigint) then 'train' when i<cast(trunc(n*0.7::double) as bigint)+cast(trunc(n*0.15::double) as bigint) then 'val' else 'test' end split from n)
 select split, count(distinct g) n_groups, count(*) n_rows from s join events on strftime(ts,'%Y%m%d_%H')=g group by 1""")
def timestamp_group_split(spark, d):
    e = V.table(spark, d, "events").select(F.date_format("ts", "yyyyMMdd_HH").alias("g"))
    s = S.cut_by_order(e, "g", 7)
    return e.join(s, "g").groupBy("split").agg(F.countDistinct("g").alias("n_groups"), F.count("*").alias("n_rows"))
