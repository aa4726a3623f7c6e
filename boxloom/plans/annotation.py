"""Annotation records: clipping, normalising, label lines, classes, reject reasons, paths and source unions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxloom.functions import geometry as G
from boxloom.functions import text as X
from boxloom.functions import vectors as W
from boxloom.operators.duplicates import first_seen_numbers, keep_first
from boxloom.operators.metrics import count_if
from boxloom.plans import fixtures as V
from boxloom.plans.registry import query
from boxloom.sinks.package import package_status, package_totals

c, lit = F.col, F.lit


def _off(spark, d):
    """Boxes shifted so that some leave their 700 x 700 image, some wholly."""
    b = V.gt_boxes(spark, d)
    dx, dy = (c("p") % 5 - 2) * 60, (c("s") % 5 - 2) * 60
    return b.select("image_id", "box_index", (c("x1") + dx).alias("x0"), (c("y1") + dy).alias("y0"), (c("x2") + dx).alias("x1"), (c("y2") + dy).alias("y1"), lit(700.0).alias("width"), lit(700.0).alias("height"))


V.CTES["off"] = """select image_id, box_index, x1+(p%5-2)*60 x0, y1+(s%5-2)*60 y0, x2+(p%5-2)*60 x1, y2+(s%5-2)*60 y1 from gt"""
V.NEEDS["off"] = ["gt"]
V.CTES["clipped"] = """select image_id, box_index, least(greatest(x0,0),700) a0, least(greatest(y0,0),700) b0, least(greatest(x1,0),700) a1, least(greatest(y1,0),700) b1,
 (x0<0 or y0<0 or x1<0 or y1<0 or x0>700 or y0>700 or x1>700 or y1>700) clipped from off"""
V.NEEDS["clipped"] = ["off"]


@query(
    "voc_clip_normalize",
    V.sql("clipped", "select image_id, box_index, clipped, round((a0+a1)/2/700,6) cx, round((b0+b1)/2/700,6) cy, round((a1-a0)/700,6) w, round((b1-b0)/700,6) h from clipped where a1>a0 and b1>b0"),
)
def voc_clip_normalize(spark, d):
    b = _off(spark, d)
    k = G.clipped_corners(*[c(x) for x in ("x0", "y0", "x1", "y1", "width", "height")])
    b = b.select("image_id", "box_index", "width", "height", *[v.alias(f"_{n}") for n, v in k.items()]).where(~c("_degenerate"))
    y = G.to_yolo(*[c(x) for x in ("_x0", "_y0", "_x1", "_y1", "width", "height")])
    return b.select("image_id", "box_index", c("_clipped").alias("clipped"), *[F.round(v, 6).alias(n) for n, v in y.items()])


@query(
    "box_quality",
    V.sql("clipped", """select count(*) n_boxes, count(*) filter (clipped) n_clipped, count(*) filter (a1<=a0 or b1<=b0) n_skipped, count(*) filter (clipped and (a1<=a0 or b1<=b0)) n_both,
 count(*) filter (a1>a0 and b1>b0) n_written from clipped"""),
)
def box_quality(spark, d):
    b = _off(spark, d)
    k = G.clipped_corners(*[c(x) for x in ("x0", "y0", "x1", "y1", "width", "height")])
    b = b.select(k["clipped"].alias("m"), k["degenerate"].alias("z"))
    return b.agg(F.count("*").alias("n_boxes"), count_if(c("m")).alias("n_clipped"), count_if(c("z")).alias("n_skipped"), count_if(c("m") & c("z")).alias("n_both"), count_if(~c("z")).alias("n_written"))


@query(
    "yolo_remap",
    V.sql("gt", """with r as (select image_id, box_index, case p%4 when 0 then 0 when 1 then 1 when 3 then 2 end cls, (x1+x2)/2/360-0.5::double cx, (y1+y2)/2/360-0.5::double cy, (x2-x1)/360 w, (y2-y1)/360-0.1::double h from gt)
 select image_id, box_index, cls, round(least(greatest(cx,0),1),6) cx, round(least(greatest(cy,0),1),6) cy, round(least(greatest(w,0),1),6) w, round(least(greatest(h,0),1),6) h from r where cls is not null and w>0 and h>0"""),
)
def yolo_remap(spark, d):
    """Classes renumbered or left out; each of centre and size clipped by itself."""
    b = V.gt_boxes(spark, d)
    new = F.create_map(*[lit(x) for x in (0, 0, 1, 1, 3, 2)])
    cls = F.try_element_at(new, X.class_number(F.concat((c("p") % 4).cast("string"), lit(".0"))))
    b = b.select("image_id", "box_index", cls.alias("cls"), ((c("x1") + c("x2")) / 2 / 360 - 0.5).alias("cx"), ((c("y1") + c("y2")) / 2 / 360 - 0.5).alias("cy"), ((c("x2") - c("x1")) / 360).alias("w"), ((c("y2") - c("y1")) / 360 - 0.1).alias("h"))
    u = G.clip_unit(c("cx"), c("cy"), c("w"), c("h"))
    b = b.where("cls is not null").select("image_id", "box_index", "cls", *[v.alias(k) for k, v in u.items()]).where("w > 0 and h > 0")
    return b.select("image_id", "box_index", "cls", *[F.round(k, 6).alias(k) for k in u])


@query("class_map", "select event_type class_name, row_number() over (order by event_type)-1 class_id from (select distinct event_type from events)")
def class_map(spark, d):
    names = V.table(spark, d, "events").select(c("event_type").alias("class_name")).distinct()
    return names.withColumn("class_id", (F.row_number().over(Window.orderBy("class_name")) - 1).cast("long"))


@query("class_counts", """select coalesce(event_type,'TOTAL') class_name, count(*) n_before, count(*) filter (event_type<>'error') n_after, count(distinct user_id) n_images from events group by rollup(event_type)""")
def class_counts(spark, d):
    e = V.table(spark, d, "events")
    r = e.rollup("event_type").agg(F.grouping("event_type").alias("g"), F.count("*").alias("n_before"), count_if(c("event_type") != "error").alias("n_after"), F.countDistinct("user_id").alias("n_images"))
    return r.select(F.when(c("g") == 1, "TOTAL").otherwise(c("event_type")).alias("class_name"), "n_before", "n_after", "n_images")


@query(
    "yolo_to_corners",
    V.sql("gt", """select image_id, box_index, round(((x1+x2)/2/720-(x2-x1)/720/2)*720,6) x1, round(((y1+y2)/2/720-(y2-y1)/720/2)*720,6) y1, round(((x1+x2)/2/720+(x2-x1)/720/2)*720,6) x2,
 round(((y1+y2)/2/720+(y2-y1)/720/2)*720,6) y2, case when sqrt((x2-x1)*(y2-y1))<16 then '<16' when sqrt((x2-x1)*(y2-y1))<32 then '16-32' else '>=32' end side, round((x2-x1)*(y2-y1)/518400,6) share from gt"""),
)
def yolo_to_corners(spark, d):
    """Box to polygon, polygon to bounds, bounds to centre and size, and back to corners."""
    b = V.gt_boxes(spark, d)
    ring = F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    b = b.select("image_id", "box_index", *[v.alias(f"_{k}") for k, v in G.polygon_box(ring).items()])
    y = G.to_yolo(c("_x1"), c("_y1"), c("_x2"), c("_y2"), lit(720.0), lit(720.0))
    b = b.select("*", *[v.alias(k) for k, v in y.items()])
    k = G.to_corners(c("cx"), c("cy"), c("w"), c("h"), lit(720.0), lit(720.0))
    area = (c("_x2") - c("_x1")) * (c("_y2") - c("_y1"))
    share = G.area_share(c("_x1"), c("_y1"), c("_x2"), c("_y2"), 720.0, 720.0)
    return b.select("image_id", "box_index", *[F.round(v, 6).alias(n) for n, v in k.items()], G.side_bucket(area).alias("side"), F.round(share, 6).alias("share"))


@query(
    "letterbox_buckets",
    V.sql("gt", f"""with a as (select (x2-x1)/720*720*(640/greatest(720,1280)::double)*((y2-y1)/1280)*1280*(640/greatest(720,1280)::double) a from gt)
 select case when a<1024 then 'small' when a<=9216 then 'medium' else 'large' end bucket, count(*) n, round(min(a),6) least, round(max(a),6) most from a group by 1"""),
)
def letterbox_buckets(spark, d):
    a = G.letterbox_area((c("x2") - c("x1")) / 720, (c("y2") - c("y1")) / 1280, lit(720.0), lit(1280.0))
    b = V.gt_boxes(spark, d).select(a.alias("a"))
    return b.groupBy(G.size_bucket("a").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.min("a"), 6).alias("least"), F.round(F.max("a"), 6).alias("most"))


@query(
    "expand_and_crop_filter",
    V.sql("gt", """with e as (select image_id, box_index, greatest(x1-dx,0)::int x1, greatest(y1-dy,0)::int y1, least(x2+dx,720)::int x2, least(y2+dy,720)::int y2 from
 (select *, trunc(0.15::double*(x2-x1)) dx, trunc(0.15::double*(y2-y1)) dy from (select image_id, box_index, x1::int x1, y1::int y1, case p%6 when 0 then x1+2 else x2 end::int x2, y2::int y2 from gt)))
 select image_id, box_index, x1, y1, x2, y2 from e where x2-x1>=4 and y2-y1>=4"""),
)
def expand_and_crop_filter(spark, d):
    b = V.gt_boxes(spark, d)
    x2 = F.when(c("p") % 6 == 0, c("x1") + 2).otherwise(c("x2"))
    k = G.expand_clip(c("x1").cast("int"), c("y1").cast("int"), x2.cast("int"), c("y2").cast("int"), lit(720), lit(720))
    return b.select("image_id", "box_index", *[v.alias(n) for n, v in k.items()]).where("x2 - x1 >= 4 and y2 - y1 >= 4")


_LINES = """with l as (select image_id, string_agg(case when box_index%7=0 then ' ' when box_index%5=0 then (p%3)||' x' else (p%3)||'.0  '||x1||' '||y1||' '||(x2-x1)||' '||(y2-y1) end, chr(10) order by box_index) t from gt where image_id%4<>0 group by 1),
 i as (select distinct image_id from gt), k as (select image_id, n-1 line_no, trim(v) v from l, lateral (select unnest(string_split(t, chr(10))) v, generate_subscripts(string_split(t, chr(10)),1) n) z)"""


@query(
    "label_line_parse",
    V.sql("gt", _LINES + """ select i.image_id, count(v) filter (v<>'' and regexp_matches(v,' .* .* .* ')) n_boxes, count(v) filter (v<>'' and not regexp_matches(v,' .* .* .* ')) n_malformed,
 count(v) filter (v<>'' and regexp_matches(v,' .* .* .* ') and v[1]='0') n_class0, count(v) is not null and count(v) filter (v<>'' and regexp_matches(v,' .* .* .* '))=0 background from i left join k on k.image_id=i.image_id group by 1"""),
)
def label_line_parse(spark, d):
    """Label texts to boxes: blank lines are skipped, broken ones counted, images without boxes are backgrounds."""
    b = V.gt_boxes(spark, d)
    num = lambda x: x.cast("string")
    line = F.when(c("box_index") % 7 == 0, " ").when(c("box_index") % 5 == 0, F.concat(num(c("p") % 3), lit(" x"))).otherwise(F.concat_ws(" ", F.concat(num(c("p") % 3), lit(".0 ")), num(c("x1")), num(c("y1")), num(c("x2") - c("x1")), num(c("y2") - c("y1"))))
    texts = b.where("image_id % 4 <> 0").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_index", line.alias("line")))).alias("l"))
    texts = texts.select("image_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    from boxloom.sources.annotations import label_boxes

    boxes = label_boxes(texts, "image_id")
    return b.select("image_id").distinct().join(boxes, "image_id", "left").groupBy("image_id").agg(
        count_if(c("ok")).alias("n_boxes"), count_if(~c("ok")).alias("n_malformed"), count_if(c("ok") & (c("cls") == 0)).alias("n_class0"), (count_if(c("ok")) == 0).alias("background")
    )


@query(
    "path_functions",
    r"""select page_id, regexp_replace(p,'^.*/','') base, regexp_replace(regexp_replace(p,'^.*/',''),'(.)\.[^.]*$','\1') stem, lower(regexp_extract(regexp_replace(p,'^.*/',''),'.(\.[^.]+)$',1)) suffix, nullif(regexp_extract(p,'([0-9]+)',1),'')::bigint number,
 'web_'||regexp_replace(regexp_replace(p,'^.*/',''),'(.)\.[^.]*$','\1')||'.txt' output from (select page_id, regexp_replace(url,'[?#].*$','') p from pages)""",
)
def path_functions(spark, d):
    p = V.table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("p"))
    return p.select("page_id", X.base_name(c("p")).alias("base"), X.stem(c("p")).alias("stem"), X.suffix(c("p")).alias("suffix"), X.first_number(c("p")).alias("number"), X.output_name(lit("web"), X.stem(c("p")), lit(".txt")).alias("output"))


@query("image_order", "select c_custkey id, row_number() over (order by nullif(regexp_extract(c_name,'([0-9]+)',1),'')::bigint nulls last, c_name) - 1 place from customer")
def image_order(spark, d):
    """Images by the first number in their name."""
    t = V.table(spark, d, "customer").select(c("c_custkey").alias("id"), X.first_number(c("c_name")).alias("n"), "c_name")
    return t.select("id", (F.row_number().over(Window.orderBy(c("n").asc_nulls_last(), "c_name")) - 1).cast("long").alias("place"))


@query("vector_normalize_argmax", """select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x*x)))+1e-8::double,6) norm, list_position(embedding, list_max(embedding))-1 best, round(list_max(embedding),6) confidence from embeddings""")
def vector_normalize_argmax(spark, d):
    e = V.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(W.l2_norm(c("embedding")) + 1e-8, 6).alias("norm"), W.argmax(c("embedding")).cast("long").alias("best"), F.round(F.array_max("embedding").cast("double"), 6).alias("confidence"))


@query("near_equal_boxes", ("""with r as (select l_orderkey image_id, l_linenumber box_index, (l_partkey*37)%(712-4*cast(l_quantity as int)) x, (l_suppkey*53)%(712-3*cast(l_quantity as int)) y, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) k from lineitem)
 select a.image_id, count(*) n_pairs from r a join r b on a.image_id=b.image_id and a.k<b.k and abs(a.x-b.x)<=20 and abs(a.y-b.y)<=20 group by 1"""))
def near_equal_boxes(spark, d):
    """Pairs of boxes in an image whose corners are within a tolerance."""
    w = Window.partitionBy("image_id").orderBy("box_index", "p", "s", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    r = V.raw_boxes(spark, d).select("image_id", "x1", "y1", F.row_number().over(w).alias("k"))
    a, b = r.select("image_id", *[c(x).alias(f"{x}_a") for x in ("x1", "y1", "k")]), r.select("image_id", *[c(x).alias(f"{x}_b") for x in ("x1", "y1", "k")])
    near = G.near_equal({"x": c("x1_a"), "y": c("y1_a")}, {"x": c("x1_b"), "y": c("y1_b")}, 20.0)
    return a.join(b, "image_id").where((c("k_a") < c("k_b")) & near).groupBy("image_id").agg(F.count("*").alias("n_pairs"))


@query(
    "reject_reasons",
    """with l as (select l_orderkey k, count(*) n from lineitem group by 1) select case when o_totalprice is null or o_orderkey%11=0 then 'parse_error' when n is null or o_orderkey%7=0 then 'xml_without_image' when o_totalprice<30000 then 'skipped_size' else 'kept' end reason,
 count(*) n, sum(coalesce(n,0))::bigint n_boxes from orders left join l on k=o_orderkey group by 1""",
)
def reject_reasons(spark, d):
    """Annotations without image or size; a parse error is tested first, then the image, then the size."""
    n = V.table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    o = V.table(spark, d, "orders").join(n, c("k") == c("o_orderkey"), "left")
    why = F.when(c("o_totalprice").isNull() | (c("o_orderkey") % 11 == 0), "parse_error").when(c("n").isNull() | (c("o_orderkey") % 7 == 0), "xml_without_image").when(c("o_totalprice") < 30000, "skipped_size").otherwise("kept")
    return o.select(why.alias("reason"), F.coalesce("n", lit(0)).alias("b")).groupBy("reason").agg(F.count("*").alias("n"), F.sum("b").alias("n_boxes"))


@query(
    "box_reject_status",
    """select case when trim(coalesce(l_linestatus,''))='' then 'skipped' when l_returnflag='N' then 'dropped' when l_tax>0.07 then 'skipped' else 'written' end status, count(*) n, count(*) filter (l_quantity>40) n_clipped from lineitem group by 1""",
)
def box_reject_status(spark, d):
    """A box without a name is skipped, of an unmapped class dropped, then skipped if unreadable."""
    t = V.table(spark, d, "lineitem")
    s = F.when(X.tidy(c("l_linestatus")) == "", "skipped").when(c("l_returnflag") == "N", "dropped").when(c("l_tax") > 0.07, "skipped").otherwise("written")
    return t.groupBy(s.alias("status")).agg(F.count("*").alias("n"), count_if(c("l_quantity") > 40).alias("n_clipped"))


@query(
    "exported_equals_discovered",
    """select l_returnflag class_name, count(*) n_discovered, count(*) filter (l_tax<=0.07 and exists (select 1 from orders where o_orderkey=l_orderkey)) n_exported,
 count(*) = count(*) filter (l_tax<=0.07 and exists (select 1 from orders where o_orderkey=l_orderkey)) same from lineitem group by 1""",
)
def exported_equals_discovered(spark, d):
    """Breaks where a box is malformed or its image missing."""
    o = V.table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), lit(True).alias("there")).distinct()
    t = V.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_tax").join(o, "l_orderkey", "left")
    out = count_if((c("l_tax") <= 0.07) & c("there").isNotNull())
    return t.groupBy(c("l_returnflag").alias("class_name")).agg(F.count("*").alias("n_discovered"), out.alias("n_exported"), (F.count("*") == out).alias("same"))


@query(
    "keep_first_by_key",
    """select md5(coalesce(text,'')) content, min(doc_id) kept, count(*) n, dense_rank() over (order by min(doc_id))-1 cluster from documents group by 1""",
)
def keep_first_by_key(spark, d):
    """The first document of equal content, and clusters numbered as first seen."""
    t = V.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", lit(""))).alias("content"))
    numbered = first_seen_numbers(t, "content", "doc_id", "cluster")
    return numbered.groupBy("content", "cluster").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).select("content", "kept", "n", "cluster")


@query("content_dedup", "select doc_id, md5(text) content from (select *, row_number() over (partition by md5(text) order by doc_id) k from documents) where k=1")
def content_dedup(spark, d):
    t = V.table(spark, d, "documents").select("doc_id", F.md5("text").alias("content"))
    return keep_first(t, ["content"], ["doc_id"])


@query(
    "image_index_by_stem",
    r"""select stem, ext from (select *, row_number() over (partition by stem order by list_position(['.html','/',''],ext), url) k from (select regexp_extract(url,'^[a-z]+://[^/]*\.([a-z-]+)\.example',1) stem, case when regexp_matches(url,'\.html') then '.html' when regexp_matches(url,'/$') then '/' else '' end ext, url from pages)) where k=1""",
)
def image_index_by_stem(spark, d):
    """For each stem the file whose extension comes first in a list."""
    p = V.table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]*\.([a-z-]+)\.example", 1).alias("stem"), F.when(c("url").rlike(r"\.html"), ".html").when(c("url").rlike("/$"), "/").otherwise("").alias("ext"), "url")
    rank = F.array_position(F.array(lit(".html"), lit("/"), lit("")), c("ext"))
    return keep_first(p, ["stem"], [rank, "url"]).select("stem", "ext")


@query(
    "multi_source_union",
    """with u as (select 'customer' source, c_nationkey cls, c_custkey id from customer union all select 'supplier', s_nationkey, s_suppkey from supplier) select source, count(*) n, count(distinct cls) n_classes, min(id) first_id, max(id) last_id from u group by 1""",
)
def multi_source_union(spark, d):
    """A registry of sources, each read its own way, as one table."""
    registry = (("customer", "c_nationkey", "c_custkey"), ("supplier", "s_nationkey", "s_suppkey"))
    parts = [V.table(spark, d, t).select(lit(t).alias("source"), c(k).alias("cls"), c(i).alias("id")) for t, k, i in registry]
    return parts[0].unionByName(parts[1]).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("cls").alias("n_classes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(
    "three_way_pairing",
    """select lang split, count(*) n_images, count(*) filter (exists (select 1 from labels l where l.doc_id=d.doc_id)) n_labels, count(*) filter (exists (select 1 from embeddings e where e.vec_id=d.doc_id)) n_depth,
 count(*) filter (exists (select 1 from labels l where l.doc_id=d.doc_id) and exists (select 1 from embeddings e where e.vec_id=d.doc_id)) n_matched from documents d group by 1""",
)
def three_way_pairing(spark, d):
    """Images with label, with depth, and with both, by split."""
    key = lambda t, n, k="doc_id": V.table(spark, d, t).select(c(k).alias("doc_id")).distinct().withColumn(n, lit(True))
    j = V.table(spark, d, "documents").select("doc_id", c("lang").alias("split")).join(key("labels", "l"), "doc_id", "left").join(key("embeddings", "e", "vec_id"), "doc_id", "left")
    has = lambda x: c(x).isNotNull()
    return j.groupBy("split").agg(F.count("*").alias("n_images"), count_if(has("l")).alias("n_labels"), count_if(has("e")).alias("n_depth"), count_if(has("l") & has("e")).alias("n_matched"))


@query("triple_semi_join", "select doc_id, lang from documents where doc_id in (select doc_id from labels) and doc_id in (select vec_id from embeddings)")
def triple_semi_join(spark, d):
    t = V.table(spark, d, "documents").select("doc_id", "lang")
    return t.join(V.table(spark, d, "labels"), "doc_id", "left_semi").join(V.table(spark, d, "embeddings").select(c("vec_id").alias("doc_id")), "doc_id", "left_semi")


@query("source_split_filter", "select o_orderkey image_id, o_orderstatus source, round(o_totalprice,6) price from orders where o_orderpriority='2-HIGH' and o_orderstatus='F'")
def source_split_filter(spark, d):
    t = V.table(spark, d, "orders").where("o_orderpriority = '2-HIGH' and o_orderstatus = 'F'")
    return t.select(c("o_orderkey").alias("image_id"), c("o_orderstatus").alias("source"), F.round(c("o_totalprice").cast("double"), 6).alias("price"))


@query("orphans", """select 'order_without_line' kind, count(*) n from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'line_without_order', count(*) from (select distinct l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders))
 union all select 'document_without_label', count(*) from documents where doc_id not in (select doc_id from labels) union all select 'label_without_document', count(*) from labels where doc_id not in (select doc_id from documents)""")
def orphans(spark, d):
    def missing(kind, a, ka, b, kb):
        left = V.table(spark, d, a).select(c(ka).alias("k")).distinct()
        return left.join(V.table(spark, d, b).select(c(kb).alias("k")), "k", "left_anti").agg(lit(kind).alias("kind"), F.count("*").alias("n"))

    out = missing("order_without_line", "orders", "o_orderkey", "lineitem", "l_orderkey")
    for more in (("line_without_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("document_without_label", "documents", "doc_id", "labels", "doc_id"), ("label_without_document", "labels", "doc_id", "documents", "doc_id")):
        out = out.unionByName(missing(*more))
    return out


@query(
    "package_validation",
    """with l as (select l_orderkey k, count(*) n from lineitem where l_returnflag<>'R' group by 1), m as (select o_orderkey k, o_orderkey%3=0 bg from orders)
 select count(*) n_listed, count(*) filter (n is null) n_without_label, count(*) filter (n is null and not bg) n_positive_but_empty, coalesce(sum(n),0)::bigint n_boxes, (select count(*) from l where k not in (select k from m)) n_unlisted from m left join l using (k)""",
)
def package_validation(spark, d):
    """What would keep a package from being written: missing labels, positives without boxes, files not listed."""
    listed = V.table(spark, d, "orders").select(c("o_orderkey").alias("stem"), (c("o_orderkey") % 3 == 0).alias("is_background"))
    boxes = V.table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(c("l_orderkey").alias("stem"), lit(0).alias("cls"), lit(True).alias("ok"))
    return package_totals(package_status(listed, listed, boxes, boxes))
