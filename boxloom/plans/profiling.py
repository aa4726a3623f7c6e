"""Dataset profiles: sources, trees, resolutions and cross-dataset checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import geometry as G
from boxloom.functions.text import base_name, suffix
from boxloom.operators.metrics import count_if
from boxloom.plans import fixtures as V
from boxloom.plans.registry import query

c, lit = F.col, F.lit


@query("source_profile", """select coalesce(source,'TOTAL') source, count(*) n_images, count(*) filter (n_chars>=1000) n_positive, count(*) filter (n_chars<1000) n_background, sum(n_chars)::bigint n_boxes, round(coalesce(avg(n_chars/20011.0::double),0),6) mean_share,
 case when avg(n_chars/20011.0::double)<0.02 then 'far/dashcam' when avg(n_chars/20011.0::double)<0.08 then 'mid' else 'close-up' end label from documents group by rollup(source)""")
def source_profile(spark, d):
    t = V.table(spark, d, "documents").select("source", "n_chars")
    share = F.avg(c("n_chars") / lit(20011.0))
    r = t.rollup("source").agg(F.grouping("source").alias("g"), F.count("*").alias("n_images"), count_if(c("n_chars") >= 1000).alias("n_positive"), count_if(c("n_chars") < 1000).alias("n_background"), F.sum("n_chars").alias("n_boxes"), F.coalesce(share, lit(0.0)).alias("m"))
    return r.select(F.when(c("g") == 1, "TOTAL").otherwise(c("source")).alias("source"), "n_images", "n_positive", "n_background", "n_boxes", F.round("m", 6).alias("mean_share"), G.domain_label("m").alias("label"))


@query("resolution_topk", "select p_size, count(*) n from part group by 1 order by n desc, p_size limit 3")
def resolution_topk(spark, d):
    return V.table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "p_size").limit(3)


@query("unique_resolutions", "select p_brand, count(distinct p_size) n_sizes, (select p_size from part q where q.p_brand=p.p_brand group by 1 order by count(*) desc, p_size limit 1) top_size from part p group by 1")
def unique_resolutions(spark, d):
    n = V.table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(c("n").desc(), "p_size")))
    return top.groupBy("p_brand").agg(F.count("*").alias("n_sizes"), F.max(F.when(c("k") == 1, c("p_size"))).alias("top_size"))


@query("tree_counts", r"""select dir, ext, count(*) n from (select regexp_extract(url,'^[a-z]+://([^/]+)',1) dir, lower(regexp_extract(regexp_replace(regexp_replace(url,'[?#].*$',''),'^.*/',''),'.(\.[^.]+)$',1)) ext from pages) group by 1, 2""")
def tree_counts(spark, d):
    p = V.table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("dir"), suffix(base_name(F.regexp_replace("url", r"[?#].*$", ""))).alias("ext"))
    return p.groupBy("dir", "ext").agg(F.count("*").alias("n"))


@query("split_domain_pivot", V.sql("spl dom", """select split, (count(*) filter ("domain"='AFRICA')) africa, (count(*) filter ("domain"='AMERICA')) america, (count(*) filter ("domain"='ASIA')) asia, (count(*) filter ("domain"='EUROPE')) europe, (count(*) filter ("domain"='MIDDLE EAST')) middle_east from spl join dom using (image_id) group by 1"""))
def split_domain_pivot(spark, d):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    p = V.splits(spark, d).join(V.domains(spark, d), "image_id").groupBy("split").pivot("domain", names).count()
    return p.select("split", *[F.coalesce(c(f"`{n}`"), lit(0)).alias(n.lower().replace(" ", "_")) for n in names])


@query("groups_per_domain", V.sql("dom", """select "domain", count(*) n_groups, max(n) largest_group from (select "domain", o_custkey, count(*) n from orders join dom on image_id=o_orderkey group by 1, 2) group by 1"""))
def groups_per_domain(spark, d):
    g = V.table(spark, d, "orders").join(V.domains(spark, d), c("image_id") == c("o_orderkey")).groupBy("domain", "o_custkey").agg(F.count("*").alias("n"))
    return g.groupBy("domain").agg(F.count("*").alias("n_groups"), F.max("n").alias("largest_group"))


@query("empty_label_count", "select o_orderstatus source, count(*) n_images, count(*) filter (not exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='R')) n_empty from orders group by 1")
def empty_label_count(spark, d):
    has = V.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"), lit(1).alias("has")).distinct()
    j = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(has, "o_orderkey", "left")
    return j.groupBy(c("o_orderstatus").alias("source")).agg(F.count("*").alias("n_images"), count_if(c("has").isNull()).alias("n_empty"))


@query("cross_dataset_mismatch", """with s as (select case when value>50 then 'LARGER' else 'SMALLER' end sign, event_type ds, value from events), g as (select ds, string_agg(distinct sign, ',' order by sign) signs, count(distinct cast(value as bigint))<=2 is_binary from s group by 1)
 select ds, signs, is_binary, signs=(select signs from g order by ds limit 1) like_first from g""")
def cross_dataset_mismatch(spark, d):
    """Sign conventions and mask kinds of data sets, compared with the first."""
    s = V.table(spark, d, "events").select(c("event_type").alias("ds"), F.when(c("value") > 50, "LARGER").otherwise("SMALLER").alias("sign"), "value")
    g = s.groupBy("ds").agg(F.array_join(F.sort_array(F.collect_set("sign")), ",").alias("signs"), (F.countDistinct(F.floor(c("value") + 0.5).cast("bigint")) <= 2).alias("is_binary"))
    first = g.agg(F.min(F.struct("ds", "signs")).alias("f")).select(c("f.signs").alias("f"))
    return g.crossJoin(F.broadcast(first)).select("ds", "signs", "is_binary", (c("signs") == c("f")).alias("like_first"))


@query("pair_running_min", "select least(l_partkey%20,l_suppkey%20) a, greatest(l_partkey%20,l_suppkey%20) b, round(min(l_extendedprice),4) least_value from lineitem where l_partkey%20<>l_suppkey%20 group by 1, 2")
def pair_running_min(spark, d):
    x, y = c("l_partkey") % 20, c("l_suppkey") % 20
    return V.table(spark, d, "lineitem").where(x != y).groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.round(F.min("l_extendedprice"), 4).alias("least_value"))
