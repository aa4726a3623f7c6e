"""Readers of annotation files: VOC XML, label texts, split lists, manifests, metadata and file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from boxloom.functions.text import base_name, class_number, label_tokens, polygon, stem, suffix
from boxloom.sources.trees import listing

BOX = "struct<xmin:string,ymin:string,xmax:string,ymax:string>"
VOC = f"size struct<width:string,height:string>, object array<struct<name:string,bndbox:{BOX}>>, _corrupt_record string"
#: Extensions of images, the preferred first.
IMAGES = (".jpg", ".jpeg", ".png", ".bmp")
POOL = "filename string, source string, domain string, n_boxes int, is_background int"
SPLIT = "filename string, source string, domain string, split string, n_boxes int, is_background int, group_id bigint"
CROPS = "stem string, split string, tier string, bx0 int, by0 int, bx1 int, by1 int, img_w int, img_h int, dbs_scalar double, snr_ratio double"
SEVERITY = "stem string, dbs_scalar double, road_std double, snr_ratio double, tier string, split string, inlier_frac double, flag string"


def file_texts(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """``path, stem, text`` of every file under ``path``. Spark skips empty files: ``label_texts`` has them too."""
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(paths, wholetext=True)
    # The address is encoded, but for plus signs.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select(name.alias("path"), F.col("value").alias("text")).select("path", stem(F.col("path")).alias("stem"), "text")


def label_texts(spark: SparkSession, path: str | list[str], glob: str = "*.txt") -> DataFrame:
    """``path, stem, text`` of every file under ``path``, empty ones, which stand for backgrounds, too."""
    empty = listing(spark, path, glob).where("length = 0")
    return file_texts(spark, path, glob).unionByName(empty.select("path", "stem", F.lit("").alias("text")))


def voc_annotations(texts: DataFrame) -> DataFrame:
    """``path, stem, parsed, width, height, objects`` of XML texts; a broken one has ``parsed`` false."""
    x = texts.withColumn("x", F.from_xml("text", VOC, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    number = lambda c: F.trim(c).try_cast("double")
    keep = [c for c in texts.columns if c != "text"]
    return x.select(*keep, (F.col("x").isNotNull() & F.col("x._corrupt_record").isNull()).alias("parsed"), number(F.col("x.size.width")).alias("width"), number(F.col("x.size.height")).alias("height"), F.col("x.object").alias("objects"))


def voc_boxes(annotations: DataFrame, outer: bool = False) -> DataFrame:
    """One row for each object, in file order, with its trimmed name and corners (null if unreadable).

    With ``outer`` an annotation without objects, or a broken one, has a row too, without a ``box_index``.
    """
    spread = F.posexplode_outer(F.when(F.col("parsed"), F.col("objects"))) if outer else F.posexplode("objects")
    rows = annotations.select(*[c for c in annotations.columns if c != "objects"], spread.alias("box_index", "o"))
    number = lambda c: F.trim(c).try_cast("double")
    corners = [number(F.col(f"o.bndbox.{a}")).alias(b) for a, b in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))]
    return rows.select(*[c for c in rows.columns if c != "o"], F.trim(F.coalesce("o.name", F.lit(""))).alias("name"), *corners)


def annotation_status(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``reason``: parse_error, then xml_without_image, then skipped_size, else kept."""
    j = annotations.join(images.select("stem", F.lit(True).alias("_image")).distinct(), "stem", "left")
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    why = F.when(~F.col("parsed"), "parse_error").when(F.col("_image").isNull(), "xml_without_image").when(~F.coalesce(sized, F.lit(False)), "skipped_size").otherwise("kept")
    return j.withColumn("reason", why).drop("_image")


def label_boxes(texts: DataFrame, key: str = "stem") -> DataFrame:
    """``key, box_index, cls, cx, cy, w, h, ok`` of label texts; blank lines are skipped, others keep their place.

    ``ok`` is false for a line that has not five tokens at least or can't be read.
    """
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("_n", "line")).where(F.trim("line") != "")
    place = F.row_number().over(Window.partitionBy(key).orderBy("_n")) - 1
    t = lines.select(key, place.alias("box_index"), label_tokens(F.col("line")).alias("t"))
    out = t.select(key, "box_index", class_number(F.get("t", F.lit(0))).alias("cls"), *[F.get("t", F.lit(i)).try_cast("double").alias(n) for i, n in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))])
    ok = F.lit(True)
    for c in ("cls", "cx", "cy", "w", "h"):
        ok = ok & F.col(c).isNotNull()
    return out.withColumn("ok", ok)


def label_polygons(texts: DataFrame, key: str = "stem", least_points: int = 3) -> DataFrame:
    """``key, cls, points`` of segmentation labels with so many points."""
    lines = texts.select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    rows = lines.select(key, label_tokens(F.col("line")).alias("t")).where(F.size("t") >= 1 + 2 * least_points)
    return rows.select(key, class_number(F.get("t", F.lit(0))).alias("cls"), polygon(F.col("t")).alias("points"))


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """``path, stem`` of a list with one path a line."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.trim("value").alias("path"), stem(F.trim("value")).alias("stem"))


def manifest(spark: SparkSession, path: str, schema: str = POOL) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def metadata(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of a JSON object of numbers."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return rows.select(F.explode("m"))


def image_index(files: DataFrame, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """For each stem the image whose extension comes first."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    rows = files.where(rank > 0)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("stem").orderBy(rank, "path"))).where("_n = 1").drop("_n")


def class_of_directory(path: Column) -> Column:
    """Class of an image stored in a folder of its class."""
    return F.element_at(F.split(path, "/"), -2)


def tree_counts(files: DataFrame, root: str) -> DataFrame:
    """``dir, ext, n``: files by folder below the root and lower-case extension."""
    folder = F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), "^.*" + root.rstrip("/") + "/?", "")
    return files.groupBy(folder.alias("dir"), suffix(base_name(F.col("path"))).alias("ext")).agg(F.count("*").alias("n"))


def sources(spark: SparkSession, registry: dict[str, dict], exists) -> DataFrame | None:
    """One table of label boxes from several sources: ``{name: {path, glob, cls, kind}}``; a missing folder is skipped.

    ``kind`` is ``box`` or ``seg``; polygons become their bounds.
    """
    parts = []
    for name, s in registry.items():
        if not exists(s["path"]):
            continue
        texts = file_texts(spark, s["path"], s.get("glob", "*.txt"))
        if s.get("kind") == "seg":
            p = label_polygons(texts)
            x, y = F.transform("points", lambda q: q["x"]), F.transform("points", lambda q: q["y"])
            low, high = (F.array_min(x), F.array_min(y)), (F.array_max(x), F.array_max(y))
            b = p.select("stem", "cls", ((low[0] + high[0]) / 2).alias("cx"), ((low[1] + high[1]) / 2).alias("cy"), (high[0] - low[0]).alias("w"), (high[1] - low[1]).alias("h"))
        else:
            b = label_boxes(texts).where("ok").select("stem", "cls", "cx", "cy", "w", "h")
        parts.append(b.where(F.col("cls") == s["cls"]).select(F.lit(name).alias("source"), "*"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
