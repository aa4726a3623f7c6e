"""Readers and array kernels over columns made from the driver tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from boxloom.functions import kernels as K
from boxloom.plans import fixtures as V
from boxloom.plans.registry import query
from boxloom.sources.annotations import voc_annotations, voc_boxes

c, lit = F.col, F.lit


@query(
    "voc_parse",
    """select l_orderkey stem, count(*) n_boxes, min(8+4*cast(l_quantity as int))::double least_width, count(*) filter (l_returnflag='R') n_class from lineitem where l_orderkey%10<>3 group by 1
 union all select distinct l_orderkey, 0, null, 0 from lineitem where l_orderkey%10=3""",
)
def voc_parse(spark, d):
    """XML texts, one in ten of them broken, back to boxes."""
    b = V.table(spark, d, "lineitem").select("l_orderkey", (8 + 4 * c("l_quantity").cast("int")).alias("w"), "l_returnflag")
    one = F.format_string("<object><name>%s</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>%d</xmax><ymax>5</ymax></bndbox></object>", c("l_returnflag"), c("w"))
    body = F.concat(lit("<annotation><size><width>720</width><height>720</height></size>"), F.array_join(F.collect_list(one), ""), F.when(c("l_orderkey") % 10 == 3, "<object>").otherwise("</annotation>"))
    a = voc_annotations(b.groupBy("l_orderkey").agg(body.alias("text")).select(c("l_orderkey").alias("stem"), "text"))
    # Broken texts keep a row, so that texts are made and parsed once and no join is needed.
    n = voc_boxes(a, outer=True).groupBy("stem").agg(F.count("box_index").alias("n_boxes"), F.min(c("x1") - c("x0")).alias("least_width"), F.count_if(c("name") == "R").alias("n_class"))
    return n.select("stem", "n_boxes", "least_width", "n_class")


@query("phash_kernel")
def phash_kernel(spark, d):
    """Hashes of 32 x 32 matrices, outer products of the halves of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "hash": [K.phash_bits(np.outer(v[:32], v[32:64])) for v in b["embedding"]]})

    return V.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, hash long")


#: Parts whose scenes one task makes, and those that it hands on at once.
SCENES, AT_ONCE = 1000, 64
#: The outline of each scene's hole, somewhat smaller than it.
RING = [{"x": 0.375, "y": 0.375}, {"x": 0.62, "y": 0.375}, {"x": 0.62, "y": 0.62}, {"x": 0.375, "y": 0.62}]


def _parts(spark, d):
    """Parts, dealt by number: they are few bytes, so that Spark reads a large table of them in one task, but their scenes are not."""
    parts = V.table(spark, d, "part").select(c("p_partkey").cast("string").alias("stem"), "p_size")
    return parts.repartition(max(1, -(-parts.count() // SCENES)))


def _made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A tilted plane with noise for each part, with a square hole as deep as the part is large."""
    y, x = np.mgrid[:120, :120]
    plane = 900 + 0.3 * x - 0.2 * y
    for b in batches:
        for at in range(0, len(b), AT_ONCE):
            rows = []
            for stem, size in zip(b["stem"][at : at + AT_ONCE], b["p_size"][at : at + AT_ONCE], strict=True):
                depth = np.random.default_rng(int(stem)).standard_normal(x.shape)
                depth += plane
                depth[45:75, 45:75] += float(size)
                out = io.BytesIO()
                np.save(out, depth)
                rows.append((stem, out.getvalue(), float(size)))
            yield pd.DataFrame(rows, columns=["stem", "depth", "truth"])


def _scenes(spark, d):
    ring = F.array(*[F.struct(*[lit(p[k]).alias(k) for k in p]) for p in RING])
    return _parts(spark, d).mapInPandas(_made, "stem string, depth binary, truth double").withColumn("points", ring)


@query("depth_measurements")
def depth_measurements(spark, d):
    """Polygon fill, dilation, plane fit and residuals; the measured depth is near the one put in.

    Scenes are measured by the worker that makes them: over 100 KB each, they would cost more to hand on than to measure.
    """
    outlined = lambda batches: (b.assign(points=[RING] * len(b)) for b in _made(batches))
    rows = _parts(spark, d).mapInPandas(lambda batches: K.measured(outlined(batches)), K.MEASURED)
    return rows.select("stem", F.round("dbs_scalar", 3).alias("dbs_scalar"), F.round("road_std", 3).alias("road_std"), "inlier_frac", "flag")


@query("depth_profile")
def depth_profile(spark, d):
    return K.depth_profile(_scenes(spark, d))
