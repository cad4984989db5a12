"""Readers of annotation documents into frame and detection tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.ArrayType(T.DoubleType())
DETECTION = T.StructType([
    T.StructField("bbox_xyxy", T.ArrayType(T.DoubleType())), T.StructField("entity_id", T.StringType()), T.StructField("track_id", T.LongType()), T.StructField("class_id", T.IntegerType()),
    T.StructField("class_name", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("det_confidence", T.DoubleType()), T.StructField("conf", T.DoubleType()),
    T.StructField("label_status", T.StringType()), T.StructField("keypoints", T.MapType(T.StringType(), POINT)),
])
COLLECTIONS = ["detections", "temporarily_hidden_detections", "ignore_regions"]
FRAME = T.StructType([
    T.StructField("video", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("group", T.StringType()), T.StructField("split", T.StringType()), T.StructField("frame", T.StringType()),
    T.StructField("fps", T.DoubleType()), T.StructField("image_size", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.ArrayType(DETECTION)) for c in COLLECTIONS),
])
LABELME = T.StructType([
    T.StructField("imagePath", T.StringType()), T.StructField("imageWidth", T.IntegerType()), T.StructField("imageHeight", T.IntegerType()),
    T.StructField("shapes", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("shape_type", T.StringType()), T.StructField("group_id", T.LongType()), T.StructField("points", T.ArrayType(POINT))]))),
])
#: Domains, and names of the rear point.
DOMAINS = ["IR_in", "RGB_out"]
REAR = ["tail", "abdomen", "abdomen_tip"]


def read_frames(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Frames as JSON lines (gzip by suffix), or one JSON document per file; a malformed record is an error."""
    return spark.read.schema(FRAME).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def normalize(frames: DataFrame) -> DataFrame:
    """Defaults and derived keys: frame number from the digits at the name's end, sample_id, group, split, fps, image size."""
    number = F.regexp_extract("frame", r"(\d+)(?:\.[^.]+)?$", 1).cast("long")
    out = frames.withColumns({
        "frame": number, "group": F.coalesce("group", F.lit("unknown")), "split": F.coalesce("split", F.lit("unassigned")), "fps": F.coalesce("fps", F.lit(30.0)), "image_size": F.coalesce("image_size", F.array(F.lit(1920), F.lit(1080))),
    })
    return out.withColumn("sample_id", F.concat_ws("/", "domain", "group", "video", F.lpad(F.col("frame").cast("string"), 8, "0")))


def detections_of(frames: DataFrame) -> DataFrame:
    """One row per box of the three collections, with the collection's name and the box's position."""
    def named(c: str):
        return F.transform(F.coalesce(F.col(c), F.array().cast(T.ArrayType(DETECTION))), lambda d, i: F.struct(F.lit(c).alias("collection"), i.alias("pos"), d.alias("d")))

    each = [named(c) for c in COLLECTIONS]
    rows = frames.select("sample_id", "domain", "video", "group", "split", "frame", F.explode(F.concat(*each)).alias("e")).select("*", "e.*").drop("e")
    d = F.col("d")
    return rows.select(
        "sample_id", "domain", "video", "group", "split", "frame", "collection", "pos",
        F.coalesce(d["entity_id"], F.concat_ws("/", "sample_id", "collection", F.col("pos").cast("string"))).alias("entity_id"), d["track_id"].alias("track_id"),
        F.coalesce(d["class_id"], F.lit(0)).alias("class_id"), *(d["bbox_xyxy"][i].alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])),
        F.coalesce(d["confidence"], d["det_confidence"], d["conf"]).alias("confidence"), F.coalesce(d["origin"], F.lit("observed")).alias("origin"), d["label_status"].alias("label_status"), d["keypoints"].alias("keypoints"),
    )


def violations(frames: DataFrame) -> DataFrame:
    """What normalised frames may not have: rule, sample_id, detail."""
    dets = detections_of(frames)
    twice = dets.where("track_id is not null and coalesce(label_status, '') <> 'invalid'").groupBy("sample_id", "track_id").count().where("count > 1")
    return (
        frames.where("video is null").select(F.lit("missing_video").alias("rule"), "sample_id", F.lit(None).cast("string").alias("detail"))
        .unionByName(frames.where(~F.coalesce(F.col("domain"), F.lit("")).isin(DOMAINS)).select(F.lit("bad_domain").alias("rule"), "sample_id", F.col("domain").alias("detail")))
        .unionByName(dets.where("x2 <= x1 or y2 <= y1").select(F.lit("degenerate_box").alias("rule"), "sample_id", F.col("entity_id").alias("detail")))
        .unionByName(twice.select(F.lit("duplicate_track").alias("rule"), "sample_id", F.col("track_id").cast("string").alias("detail")))
        .unionByName(frames.groupBy("sample_id").count().where("count > 1").select(F.lit("duplicate_sample").alias("rule"), "sample_id", F.col("count").cast("string").alias("detail")))
    )


def checked(frames: DataFrame) -> DataFrame:
    """Normalised frames, once none of ``violations`` was found; else an error that names the first few."""
    found = violations(frames).orderBy("rule", "sample_id", "detail").limit(5).collect()
    if found:
        raise ValueError("frames refused: " + "; ".join(f"{r['rule']} {r['sample_id']} ({r['detail']})" for r in found))
    return frames


def labelme_detections(docs: DataFrame, name: str = "imagePath") -> DataFrame:
    """Rectangles of LabelMe documents as boxes, with the points of the same group: name, label, group_id, x1..y2, head, abdomen_tip."""
    shapes = docs.select(name, F.posexplode("shapes").alias("pos", "s"))
    p = F.col("s.points")
    low = lambda i: F.array_min(F.transform(p, lambda q: q[i]))
    high = lambda i: F.array_max(F.transform(p, lambda q: q[i]))
    boxes = shapes.where("s.shape_type = 'rectangle'").select(name, "pos", F.col("s.label").alias("label"), F.col("s.group_id").alias("group_id"), low(0).alias("x1"), low(1).alias("y1"), high(0).alias("x2"), high(1).alias("y2"))
    role = F.when(F.col("s.label").isin(REAR), "abdomen_tip").otherwise(F.col("s.label"))
    points = shapes.where("s.shape_type = 'point' and s.group_id is not null").groupBy(name, F.col("s.group_id").alias("group_id")).agg(F.max_by(p[0], F.when(role == "head", F.col("pos"))).alias("head"), F.max_by(p[0], F.when(role == "abdomen_tip", F.col("pos"))).alias("abdomen_tip"))
    # a shadow shares its group with the original but owns no points
    own = F.col("label") != "bee_shadow"
    joined = boxes.join(points, [name, "group_id"], "left")
    return joined.select(name, "pos", "label", "group_id", "x1", "y1", "x2", "y2", F.when(own, F.col("head")).alias("head"), F.when(own, F.col("abdomen_tip")).alias("abdomen_tip"))


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """MOT text rows: 1-based frames and corners become 0-based; unmarked and degenerate boxes are left out."""
    schema = "frame long, track_id long, left double, top double, width double, height double, mark double, class_id int, visibility double"
    rows = spark.read.schema(schema).csv(path)
    return rows.where("mark <> 0 and width > 1 and height > 1").select((F.col("frame") - 1).alias("frame"), "track_id", (F.col("left") - 1).alias("x1"), (F.col("top") - 1).alias("y1"), (F.col("left") - 1 + F.col("width")).alias("x2"), (F.col("top") - 1 + F.col("height")).alias("y2"))


def read_yolo(spark: SparkSession, path: str, width: int, height: int, least: float = 0.0) -> DataFrame:
    """YOLO rows (class cx cy w h [conf]) to boxes in pixels, with the file they are from."""
    parts = F.split(F.trim("value"), r"\s+")
    v = lambda i: parts[i].cast("double")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), parts[0].cast("int").alias("class_id"), *(((v(c) + s * v(n) / 2) * size).alias(name) for name, c, n, s, size in (("x1", 1, 3, -1, width), ("y1", 2, 4, -1, height), ("x2", 1, 3, 1, width), ("y2", 2, 4, 1, height))), F.when(F.size(parts) == 6, F.try_element_at(parts, F.lit(6)).cast("double")).otherwise(1.0).alias("conf"))
    return rows.where(F.col("conf") >= least)
