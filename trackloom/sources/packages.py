"""Readers of archives, COCO documents and manifests, and what trackers start from."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import matching
from .frames import COLLECTIONS, DETECTION, FRAME, LABELME, REAR

MEMBERS = "source string, name string, content binary"

COCO = T.StructType([
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("category_id", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("keypoints", T.ArrayType(T.DoubleType())), T.StructField("track_id", T.LongType()), T.StructField("iscrowd", T.IntegerType()),
    ]))),
])
MANIFEST = "sample_id string, split string, image_path string, annotations array<struct<bbox:array<double>,track_id:long,det_mask:boolean,track_mask:boolean>>"


TARS = (".tar", ".tar.gz", ".tgz", ".tar.zst")


def _opened(url: str):
    """A seekable stream of a file on any file system that Arrow knows; Hadoop writes local paths as ``file:/...``."""
    from pyarrow import fs

    scheme, _, rest = url.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, path = fs.FileSystem.from_uri(quote(url, safe=":/@?=&+,;$!~*'()[]"))
    return system.open_input_file(path)


def _members(source: str, stream, fits):
    """Name and bytes of the members that fit, one at a time; tar archives are read in their own order, without going back."""
    short = source.rpartition("/")[2]
    if short.endswith(".zip"):
        with zipfile.ZipFile(stream) as z:
            for i in sorted(z.infolist(), key=lambda i: i.filename):
                if not i.is_dir() and fits(i.filename):
                    yield i.filename, z.read(i)
    elif short.endswith(TARS):
        if short.endswith(".zst"):
            import zstandard

            stream = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
        with tarfile.open(fileobj=stream, mode="r|*") as t:
            for m in t:
                if m.isfile() and fits(m.name):
                    yield m.name, t.extractfile(m).read()
    elif fits(short):
        yield short, stream.read()


def read_members(spark: SparkSession, path: str, pattern: str = ".*", unpack: bool = False, direct: bool = False) -> DataFrame:
    """Files of a folder, and members of .zip, .tar, .tar.gz, .tgz and .tar.zst files in it, whose whole name fits ``pattern``: source, name, content.

    Each file is read by one task, an archive member by member; a broken archive is an error.
    With ``direct`` a task opens its files itself, through Arrow's file systems, and never holds more than a member, whatever the archive's size; else
    Spark hands it each file as a whole.  ``unpack`` unpacks members named .gz.  Row order is by source and name only after a sort.
    """

    def run(batches):
        fits = re.compile(pattern).fullmatch
        for b in batches:
            for k, source in enumerate(b["path"]):
                with _opened(source) if direct else io.BytesIO(b["content"][k]) as stream:
                    for name, content in _members(source, stream, fits):
                        if unpack and name.endswith(".gz"):
                            content = gzip.decompress(content)
                        yield pd.DataFrame({"source": [source], "name": [name], "content": [content]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", *([] if direct else ["content"])).mapInPandas(run, MEMBERS)


def frames_of_members(members: DataFrame) -> DataFrame:
    """Frames (as ``frames.read_frames`` gives them, with replayed, fps and image_size) of JSON documents (name, content) of any of the known kinds.

    Kinds: a document of ``shapes`` (its number from the digits at its name's end), one of ``frames`` by number (of a track id that is
    emitted again in a frame the last counts; ``replayed`` says how many did not), a list of frames, or one frame.  A leading byte-order mark
    is skipped; text that is no such document is an error, and so is a rectangle that is neither bee nor bee_shadow.
    """
    text = F.regexp_replace(F.col("content").cast("string"), "^[\\x{FEFF}\\s]+", "")
    strict = {"mode": "FAILFAST"}
    docs = members.select("name", text.alias("text")).withColumn("kind", F.when(F.col("text").startswith("["), "list").when(F.get_json_object("text", "$.shapes").isNotNull(), "shapes").when(F.get_json_object("text", "$.frames").startswith("{"), "map").otherwise("frame"))
    empty = F.array().cast(T.ArrayType(DETECTION))

    one = docs.where("kind = 'frame'").select(F.from_json("text", FRAME, strict).alias("f")).select("f.*")
    many = docs.where("kind = 'list'").select(F.explode(F.from_json("text", T.ArrayType(FRAME), strict)).alias("f")).select("f.*")
    sam = T.StructType([T.StructField("frames", T.MapType(T.StringType(), T.ArrayType(DETECTION))), T.StructField("metadata", T.StructType([T.StructField("fps", T.DoubleType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))])
    each = docs.where("kind = 'map'").select(F.from_json("text", sam, strict).alias("d")).select("d.metadata", F.explode("d.frames").alias("number", "boxes"))
    later = lambda d, i: F.exists(F.slice("boxes", i + 2, F.greatest(F.size("boxes") - i - 1, F.lit(0))), lambda e: e["track_id"] == d["track_id"])
    kept = F.filter(F.coalesce("boxes", empty), lambda d, i: ~F.coalesce(later(d, i), F.lit(False)))
    none = lambda t: F.lit(None).cast(t)
    maps = each.select(
        *(none("string").alias(c) for c in ("video", "domain", "group", "split")), F.col("number").alias("frame"), F.coalesce("metadata.fps", F.lit(30.0)).alias("fps"),
        F.array(F.coalesce("metadata.width", F.lit(1920)), F.coalesce("metadata.height", F.lit(1080))).alias("image_size"), kept.alias("detections"), none(T.ArrayType(DETECTION)).alias(COLLECTIONS[1]), none(T.ArrayType(DETECTION)).alias(COLLECTIONS[2]),
        (F.size(F.coalesce("boxes", empty)) - F.size(kept)).alias("replayed"),
    )
    drawn = docs.where("kind = 'shapes'").select("name", F.from_json("text", LABELME, strict).alias("d")).select("name", "d.*")
    role = lambda s: F.when(s["label"].isin(REAR), "abdomen_tip").otherwise(s["label"])
    side = lambda r, f, i: f(F.transform(r["points"], lambda q: q[i]))

    def boxed(r):
        """A rectangle with the last head and rear point of its group; a shadow owns none."""
        own = lambda s: (s["shape_type"] == "point") & (s["group_id"] == r["group_id"]) & (r["label"] != "bee_shadow")
        last = lambda c: F.try_element_at(F.filter("shapes", lambda s: F.coalesce(own(s) & (role(s) == c), F.lit(False))), F.lit(-1))["points"][0]
        entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), last(c).alias("value")) for c in ("head", "abdomen_tip"))), lambda e: e["value"].isNotNull())
        made = {
            "bbox_xyxy": F.array(side(r, F.array_min, 0), side(r, F.array_min, 1), side(r, F.array_max, 0), side(r, F.array_max, 1)), "track_id": r["group_id"], "class_id": F.when(r["label"] == "bee", 0).when(r["label"] == "bee_shadow", 1).otherwise(F.raise_error(F.concat(F.lit("undeclared label "), F.coalesce(r["label"], F.lit("null")))).cast("int")),
            "class_name": r["label"], "origin": F.lit("observed"), "keypoints": F.map_from_entries(entries),
        }
        return F.struct(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DETECTION.fields))

    boxes = F.transform(F.filter("shapes", lambda s: F.coalesce(s["shape_type"] == "rectangle", F.lit(False))), boxed)
    shapes = drawn.select(
        *(none("string").alias(c) for c in ("video", "domain", "group", "split")), F.regexp_extract("name", r"(\d+)\.json(?:\.gz)?$", 1).alias("frame"), none("double").alias("fps"), F.array("imageWidth", "imageHeight").alias("image_size"),
        F.coalesce(boxes, empty).alias("detections"), none(T.ArrayType(DETECTION)).alias(COLLECTIONS[1]), none(T.ArrayType(DETECTION)).alias(COLLECTIONS[2]),
    )
    return maps.unionByName(one.unionByName(many).unionByName(shapes), allowMissingColumns=True)


def labelme_members(members: DataFrame) -> DataFrame:
    """Every rectangle of LabelMe documents (name, content) for itself, repeated group ids included; a shape of another kind is an error."""
    shape = "struct<label:string,shape_type:string,group_id:long,points:array<array<double>>>"
    doc = F.from_json(F.col("content").cast("string"), f"struct<imagePath:string,imageWidth:int,imageHeight:int,shapes:array<{shape}>>", {"mode": "FAILFAST"})
    rows = members.select("name", doc.alias("d")).select("name", F.posexplode("d.shapes").alias("pos", "s"))
    p = F.col("s.points")
    known = F.when(F.col("s.shape_type") == "rectangle", p).otherwise(F.raise_error(F.concat(F.lit("not a rectangle: "), F.coalesce("s.shape_type", F.lit("null")))).cast("array<array<double>>"))
    rows = rows.select("name", "pos", "s.label", "s.group_id", known.alias("p"))
    side = lambda f, i: f(F.transform("p", lambda q: q[i]))
    return rows.select("name", "pos", "label", "group_id", side(F.array_min, 0).alias("x1"), side(F.array_min, 1).alias("y1"), side(F.array_max, 0).alias("x2"), side(F.array_max, 1).alias("y2"))


def frames_between(frames: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Frames from ``first`` to ``last``, both included; a plain filter, which reaches the scan."""
    out = frames if first is None else frames.where(F.col("frame") >= first)
    return out if last is None else out.where(F.col("frame") <= last)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of COCO documents with their image: file_name, width, height, image_id, ann_id, category_id, x1..y2, keypoints, track_id.

    Crowd annotations are left out; images without annotations give no row; an annotation
    without its image keeps null image columns.
    """
    docs = spark.read.schema(COCO).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())
    images = docs.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    anns = docs.select("file", F.explode("annotations").alias("a")).where(F.coalesce(F.col("a.iscrowd"), F.lit(0)) == 0)
    b = F.col("a.bbox")
    anns = anns.select("file", F.col("a.image_id").alias("image_id"), F.col("a.id").alias("ann_id"), "a.category_id", b[0].alias("x1"), b[1].alias("y1"), (b[0] + b[2]).alias("x2"), (b[1] + b[3]).alias("y2"), "a.keypoints", "a.track_id")
    return anns.join(images, ["file", "image_id"], "left").drop("file")


def read_manifest(spark: SparkSession, path: str, split: str, mask: str = "det_mask") -> DataFrame:
    """Instances of one split of a JSON-lines manifest whose ``mask`` is not false: sample_id, image_path, pos, x1..y2, track_id."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path).where(F.col("split") == split)
    rows = rows.select("sample_id", "image_path", F.posexplode("annotations").alias("pos", "a")).where(F.coalesce(F.col(f"a.{mask}"), F.lit(True)))
    return rows.select("sample_id", "image_path", "pos", *(F.col("a.bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), F.when(F.coalesce(F.col("a.track_mask"), F.lit(True)), F.col("a.track_id")).alias("track_id"))


def tracker_seeds(dets: DataFrame, class_id: int = 0, least_conf: float = 0.3, least_side: float = 6.0, iou: float = 0.5) -> DataFrame:
    """Boxes to start tracks from, in each frame: of the class, sure and large enough, greedily without doubles, numbered from 1 by confidence."""
    from pyspark.sql import Window

    large = (F.col("x2") - F.col("x1") >= least_side) & (F.col("y2") - F.col("y1") >= least_side)
    ok = dets.where((F.col("class_id") == class_id) & (F.col("conf") >= least_conf) & large)
    kept = matching.suppress(ok, iou, [F.desc("conf"), F.col("det")]).where("kept").select("frame", "det")
    seeds = ok.join(kept, ["frame", "det"], "left_semi")
    return seeds.withColumn("seed_id", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("conf"), "det")))
