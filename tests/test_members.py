"""Archives that stream, and frames of every kind of document."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest
import zstandard

from trackloom.sources import frames, packages


def tarred(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


@pytest.mark.parametrize("direct", [False, True])
def test_archives(spark, tmp_path, direct):
    folder = tmp_path / "in it"
    folder.mkdir()
    files = {"d/2.json": b"2", "d/1.json.gz": gzip.compress(b"1"), "note.txt": b"no"}
    packed = zstandard.ZstdCompressor().compress
    (folder / "a.tar.zst").write_bytes(packed(tarred(files)[:700]) + packed(tarred(files)[700:]))  # two frames in a row
    (folder / "b.tgz").write_bytes(gzip.compress(tarred(files)))
    with zipfile.ZipFile(folder / "c.zip", "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    (folder / "9.json").write_bytes(b"9")
    found = packages.read_members(spark, f"file://{folder}", r".*\.json(\.gz)?", unpack=True, direct=direct).collect()
    assert sorted((r.source.rpartition("/")[2], r.name, bytes(r.content)) for r in found) == [("9.json", "9.json", b"9")] + [(a, n, c) for a in ("a.tar.zst", "b.tgz", "c.zip") for n, c in (("d/1.json.gz", b"1"), ("d/2.json", b"2"))]
    (folder / "z.tar.zst").write_bytes(b"no archive")
    with pytest.raises(Exception, match="(?i)zstd|frame"):
        packages.read_members(spark, f"file://{folder}", direct=direct).collect()


def test_kinds(spark):
    box = lambda t, x: {"bbox_xyxy": [x, 0, x + 5, 5], "track_id": t}
    plain = {"video": "v", "domain": "IR_in", "frame": "f_12.jpg", "detections": [box(1, 0)]}
    drawn = {"imageWidth": 40, "imageHeight": 30, "shapes": [{"label": "bee", "shape_type": "rectangle", "group_id": 7, "points": [[5, 6], [1, 2]]}, {"label": "tail", "shape_type": "point", "group_id": 7, "points": [[3, 4]]}, {"label": "bee_shadow", "shape_type": "rectangle", "group_id": 7, "points": [[1, 1], [9, 9]]}]}
    sam = {"frames": {"3": [box(1, 0), box(None, 1), box(2, 2), box(1, 3), box(None, 4), box(1, 5)], "4": []}, "metadata": {"fps": 25, "width": 64, "height": 48}}
    docs = {"one.json": plain, "many.json": [plain, {**plain, "frame": "13"}], "x/f_0007.json": drawn, "x/f_0008.json": {**drawn, "shapes": []}, "sam.json": sam}
    members = spark.createDataFrame([(n, ("﻿" if n < "o" else "").encode() + json.dumps(d).encode()) for n, d in docs.items()], "name string, content binary")
    rows = frames.normalize(packages.frames_of_members(members)).collect()
    assert sorted((r.frame, len(r.detections), r.fps, tuple(r.image_size), r.replayed) for r in rows if r.replayed is not None) == [(3, 4, 25, (64, 48), 2), (4, 0, 25, (64, 48), 0)]
    assert sorted((r.frame, len(r.detections), tuple(r.image_size)) for r in rows if r.replayed is None) == [(7, 2, (40, 30)), (8, 0, (40, 30)), (12, 1, (1920, 1080)), (12, 1, (1920, 1080)), (13, 1, (1920, 1080))]
    kept = next(r for r in rows if r.frame == 3).detections
    assert [(d.track_id, d.bbox_xyxy[0]) for d in kept] == [(None, 1), (2, 2), (None, 4), (1, 5)]
    first, second = next(r for r in rows if r.frame == 7).detections
    assert first.bbox_xyxy == [1, 2, 5, 6] and first.keypoints == {"abdomen_tip": [3, 4]} and (first.class_id, second.class_id, second.keypoints) == (0, 1, {})
    with pytest.raises(Exception, match="(?i)malformed"):
        packages.frames_of_members(spark.createDataFrame([("a.json", b'{"frame": "1", "detections": [{]}')], "name string, content binary")).collect()
