"""Near duplicates: Hamming joins, clusters, greedy and seed dedup, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions.vectors import packed_bits
from boxloom.operators import duplicates as D
from boxloom.plans import fixtures as V
from boxloom.plans.registry import query

c, lit = F.col, F.lit


def _pairs(t: str) -> str:
    return f"(select a.id a, b.id b, bit_count(xor(a.hash,b.hash))::bigint distance from {t} a join {t} b on a.id<b.id and bit_count(xor(a.hash,b.hash))<=3)"


def _reach(t: str) -> str:
    return f"""with recursive pr as materialized {_pairs(t)}, ed as (select a, b from pr union all select b, a from pr), rc(id, m) as (select id, id from {t} union select ed.b, rc.m from rc join ed on ed.a=rc.id),
 co as materialized (select id, min(m) component from rc group by 1)"""


_KEEP = """, od as (select co.id, component, row_number() over (partition by component order by co.id) k, coalesce(nb, []) nb from co left join (select b id, list(a) nb from pr group by 1) n on n.id=co.id),
 gk(component, k, kept, id, ok) as (select distinct component, 0::bigint, []::bigint[], null::bigint, null::boolean from co
 union all select o.component, o.k, case when list_has_any(g.kept, o.nb) then g.kept else list_append(g.kept, o.id) end, o.id, not list_has_any(g.kept, o.nb) from gk g join od o on o.component=g.component and o.k=g.k+1)"""


@query("hamming_pairs", V.sql("near", f"select * from {_pairs('near')}"))
def hamming_pairs(spark, d):
    return D.hamming_pairs(V.planted_hashes(spark, d)).withColumn("distance", c("distance").cast("long"))


@query("hamming_antijoin", V.sql("chain", "select id, source from chain x where source='src0' and not exists (select 1 from chain y where y.source='src1' and bit_count(xor(x.hash,y.hash))<=3)"))
def hamming_antijoin(spark, d):
    """Rows of one source unlike any of another, which is taken before its own dedup."""
    h = V.planted_hashes(spark, d, chain=True)
    return D.hamming_anti(h.where("source = 'src0'"), h.where("source = 'src1'")).select("id", "source")


@query("single_linkage", V.sql("chain", _reach("chain") + " select id, component from co"))
def single_linkage(spark, d):
    h = V.planted_hashes(spark, d, chain=True)
    return D.linked_hashes(h)


@query("greedy_keep", V.sql("chain", _reach("chain") + _KEEP + " select id, ok kept from gk where k>0"))
def greedy_keep(spark, d):
    h = V.planted_hashes(spark, d, chain=True)
    return D.keep_hashes(h)


@query(
    "seed_clusters",
    V.sql("chain", _reach("chain") + _KEEP + """ select id, seed from (select g.id, p.a seed, row_number() over (partition by g.id order by p.distance, p.a) n from gk g join pr p on p.b=g.id join gk s on s.id=p.a and s.ok where g.ok=false)
 where n=1 union all select id, id from gk where ok"""),
)
def seed_clusters(spark, d):
    h = V.planted_hashes(spark, d, chain=True)
    return D.seed_hashes(h)


@query(
    "cross_source_clusters",
    V.sql("near", _reach("near") + """, so as (select distinct component, source from co join near using (id)) select a.source source_a, b.source source_b, count(*) n_clusters, min(component) first_cluster from so a join so b using (component) where a.source<b.source group by 1, 2"""),
)
def cross_source_clusters(spark, d):
    """For each pair of sources how many clusters hold both; a cluster's distinct sources are a handful."""
    h = V.planted_hashes(spark, d)
    s = D.linked_hashes(h).join(h, "id").groupBy("component").agg(F.sort_array(F.collect_set("source")).alias("s"))
    both = s.where(F.size("s") > 1).select("component", "s", F.explode("s").alias("source_a"))
    both = both.select("component", "source_a", F.explode("s").alias("source_b")).where("source_a < source_b")
    return both.groupBy("source_a", "source_b").agg(F.count("*").alias("n_clusters"), F.min("component").alias("first_cluster"))


@query(
    "phash_embedding_bits",
    """with m as (select vec_id, embedding::double[] v, list_sort(embedding::double[]) s from embeddings), b as (select vec_id, list_transform(v, lambda x: (x > (s[32]+s[33])/2)::bigint) b from m)
 select vec_id, (case when b[1]=1 then (-9223372036854775808)::bigint else 0::bigint end + list_sum(list_transform(range(2,65), lambda i: b[i] << (64-i)))::bigint)::bigint hash from b""",
)
def phash_embedding_bits(spark, d):
    """Values above a vector's median as one 64-bit word, first value in the highest bit."""
    e = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("s", F.sort_array("v")).withColumn("m", (F.get("s", lit(31)) + F.get("s", lit(32))) / 2)
    return e.select("vec_id", packed_bits(F.transform("v", lambda x: x > c("m"))).alias("hash"))


_NN = """with p as (select a.vec_id a, b.vec_id b, list_distance(a.embedding::double[], b.embedding::double[]) d, a.label la, b.label lb from embeddings a join embeddings b on a.vec_id<>b.vec_id),
 n as (select *, row_number() over (partition by a order by d, b) k from p)"""


def _nearest(spark, d):
    e = V.table(spark, d, "embeddings")
    return e, D.nearest(e.select(c("vec_id").alias("id"), c("embedding").alias("v")))


@query("knn_pairs_top10", _NN + """ select a, b, distance, straddles from (select least(a,b) a, greatest(a,b) b, round(min(d),6) distance, any_value(la<>lb) straddles from n where k=1 group by 1, 2) order by distance, a, b limit 10""")
def knn_pairs_top10(spark, d):
    """The ten closest pairs of nearest neighbours, and whether their groups differ."""
    e, n = _nearest(spark, d)
    pairs = n.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.round(F.min("distance"), 6).alias("distance"))
    top = pairs.orderBy("distance", "x", "y").limit(10)
    g = e.select("vec_id", "label")
    top = top.join(g.toDF("x", "lx"), "x").join(g.toDF("y", "ly"), "y")
    return top.select(c("x").alias("a"), c("y").alias("b"), "distance", (c("lx") != c("ly")).alias("straddles"))


@query("nn_histogram", _NN + " select count(*) n, count(*) filter (d<1.0) n_100, count(*) filter (d<1.05) n_105, count(*) filter (d<1.1) n_110, count(*) filter (d<1.15) n_115, round(min(d),6) least from n where k=1")
def nn_histogram(spark, d):
    n = _nearest(spark, d)[1]
    under = lambda t: F.count_if(c("distance") < t)
    return n.agg(F.count("*").alias("n"), under(1.0).alias("n_100"), under(1.05).alias("n_105"), under(1.1).alias("n_110"), under(1.15).alias("n_115"), F.round(F.min("distance"), 6).alias("least"))
