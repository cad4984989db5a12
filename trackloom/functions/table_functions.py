"""Table functions for SQL: suppression, matching and tracking with ``TABLE(...) PARTITION BY``.

    register(spark)
    spark.sql('''SELECT * FROM suppress_boxes(TABLE(SELECT video, frame, det, x1, y1, x2, y2 FROM boxes)
                 PARTITION BY (video, frame) ORDER BY conf DESC, det, 0.5)''')

Each partition is one frame (a video for tracking), whose rows come in the order that the query
names.  The folds are those of the DataFrame operators.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

BOX = ["x1", "y1", "x2", "y2"]


def _boxes(rows: list) -> np.ndarray:
    return np.array([[float(r[c]) for c in BOX] for r in rows]).reshape(-1, 4)


class SuppressBoxes:
    """det, kept, blocker of the boxes of one frame (det, x1..y2), taken in the order given: a box goes if it overlaps a kept one by ``least`` or more."""

    def __init__(self):
        self.rows, self.least = [], 0.5

    def eval(self, row, least: float):
        self.rows.append(row)
        self.least = float(least)

    def terminate(self):
        from trackloom.operators.matching import overlaps

        boxes = _boxes(self.rows)
        iou = overlaps(boxes, boxes)[2]
        kept: list[int] = []
        for k, row in enumerate(self.rows):
            hit = [o for o in kept if iou[k, o] >= self.least]
            if not hit:
                kept.append(k)
            yield row["det"], not hit, self.rows[max(hit, key=lambda o: (iou[k, o], -o))]["det"] if hit else None  # noqa: B023


class MatchBoxes:
    """pred_det, gt_det, iou of one frame's rows (side 0 for predictions and 1 for truth, det, x1..y2): the assignment with the least summed 1 - IoU."""

    def __init__(self):
        self.rows, self.least = [], 0.5

    def eval(self, row, least: float):
        self.rows.append(row)
        self.least = float(least)

    def terminate(self):
        from trackloom.operators.matching import assign, overlaps

        pred, truth = ([r for r in self.rows if r["side"] == s] for s in (0, 1))
        if pred and truth:
            iou = overlaps(_boxes(pred), _boxes(truth))[2]
            for i, j in assign(np.where(iou >= self.least, 1 - iou, 1e6)):
                if iou[i, j] >= self.least:
                    yield pred[i]["det"], truth[j]["det"], float(iou[i, j])


class TrackBoxes:
    """frame, det, track (null if none) of the boxes of one video (frame, det, conf, x1..y2), which must come in order of frame and det."""

    def __init__(self):
        from trackloom.operators.trackers import Tracker

        self.tracker, self.held = Tracker(), []

    def _flush(self):
        rows = self.held
        ids = self.tracker.update(int(rows[0]["frame"]), _boxes(rows), np.array([float(r["conf"]) for r in rows]))
        for r, k in zip(rows, ids.tolist(), strict=True):
            yield r["frame"], r["det"], k or None

    def eval(self, row):
        if self.held and self.held[0]["frame"] != row["frame"]:
            yield from self._flush()
            self.held = []
        self.held.append(row)

    def terminate(self):
        if self.held:
            yield from self._flush()


def register(spark: SparkSession) -> None:
    """Makes suppress_boxes, match_boxes and track_boxes known to SQL."""
    spark.udtf.register("suppress_boxes", udtf(SuppressBoxes, returnType="det long, kept boolean, blocker long"))
    spark.udtf.register("match_boxes", udtf(MatchBoxes, returnType="pred_det long, gt_det long, iou double"))
    spark.udtf.register("track_boxes", udtf(TrackBoxes, returnType="frame long, det long, track long"))
