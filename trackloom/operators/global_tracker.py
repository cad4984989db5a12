"""A global tracker with momentum and a gated radius, in batch and as a stream that goes on after a restart.

Boxes continue the open track whose predicted place they are near to; the radius grows slowly
with the gap, so that long gaps do not reach far.  What is kept of a video is its open tracks:
seven observations each.  The stream keeps just that as its state, so that a query that was
stopped goes on from its checkpoint with the same numbers.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = 7


@dataclass(frozen=True)
class Limits:
    """Image size, frames that a track is looked for in the middle and in the outer tenth, and the largest distance a root of frames."""

    width: int = 1920
    height: int = 1080
    middle: int = 150
    edge: int = 75
    reach: float = 55.0
    unit: float = 50.0


_WEIGHTS = {n: np.exp(np.linspace(-1.5, 0, n)).tolist() for n in range(2, HISTORY)}
_STILL = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def _middle(values: list[float]) -> float:
    values, n = sorted(values), len(values)
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


def _motion(seen: list[tuple[int, float, float]]) -> tuple[float, float, float, float, float, float]:
    """Smoothed velocity (x, y) with its trust, and median velocity (x, y) with its scatter, of a track's last observations.

    Plain floats: with seven observations arrays would cost more than the arithmetic.
    """
    if len(seen) < 3:
        return _STILL
    steps = [b[0] - a[0] for a, b in itertools.pairwise(seen)]
    each = [((b[1] - a[1]) / d, (b[2] - a[2]) / d) for (a, b), d in zip(itertools.pairwise(seen), steps, strict=True)]
    weights = _WEIGHTS[len(each)]
    whole = vx = vy = mean = 0.0
    for w, (x, y) in zip(weights, each, strict=True):
        whole, vx, vy, mean = whole + w, vx + x * w, vy + y * w, mean + math.sqrt(x * x + y * y) * w
    vx, vy = vx / whole, vy / whole
    speed = math.sqrt(vx * vx + vy * vy)
    trust = 0.75 * min(1.0, speed / (mean / whole + 1e-6))
    least = min(1.0, 15.0 / max(speed, 1e-6))
    short = [e for e, d in zip(each, steps, strict=True) if d <= 3]
    mx = my = scatter = 0.0
    if len(short) >= 2:
        mx, my = _middle([x for x, _ in short]), _middle([y for _, y in short])
        scatter = _middle([math.sqrt((x - mx) ** 2 + (y - my) ** 2) for x, y in short])
        most = min(1.0, 12.0 / max(math.sqrt(mx * mx + my * my), 1e-6))
        mx, my = mx * most, my * most
    return vx * least, vy * least, trust, mx, my, scatter


class GlobalTracker:
    """The open tracks of one video: number, observations so far, last observations and their motion."""

    def __init__(self, limits: Limits = Limits()):
        self.limits, self.count, self.frame = limits, 0, -1
        self.number, self.seen, self.at, self.until = np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
        self.history: list[list[tuple[int, float, float]]] = []
        #: last place, velocity, trust, median velocity, scatter
        self.state = np.zeros((0, 8))

    def dump(self) -> bytes:
        return pickle.dumps({k: v for k, v in vars(self).items() if k != "limits"})

    @classmethod
    def load(cls, state: bytes, limits: Limits) -> GlobalTracker:
        own = cls(limits)
        vars(own).update(pickle.loads(state))  # noqa: S301  written by ``dump`` into the query's own state
        return own

    def _until(self, frame: int, x: float, y: float) -> int:
        """The last frame in which a track that was seen here is looked for."""
        lim = self.limits
        outer = x < 0.1 * lim.width or x > 0.9 * lim.width or y < 0.1 * lim.height or y > 0.9 * lim.height
        return frame + (lim.edge if outer else lim.middle)

    def update(self, frame: int, xy: np.ndarray) -> np.ndarray:
        """Track numbers of one frame's centres."""
        lim = self.limits
        near = self.until >= frame
        if not near.all():
            for name in ("number", "seen", "at", "until", "state"):
                setattr(self, name, getattr(self, name)[near])
            self.history = list(itertools.compress(self.history, near.tolist()))
        found, places = [0] * len(xy), xy.tolist()
        if len(self.at) and len(xy):
            gap, s = frame - self.at, self.state
            root = np.sqrt(gap)
            whole, x, y = np.floor(root)[:, None], xy[None, :, 0], xy[None, :, 1]
            far = lambda px, py: np.sqrt((x - px[:, None]) ** 2 + (y - py[:, None]) ** 2)
            way = far(s[:, 0], s[:, 1]) / whole
            slow = (1 - 0.9**gap) / 0.1
            radius = np.minimum(55.0, 16.0 + 2.0 * root + np.minimum(s[:, 7], 2.5) * root)
            i, j = np.nonzero((way <= lim.reach) & (far(s[:, 0] + s[:, 5] * slow, s[:, 1] + s[:, 6] * slow) <= radius[:, None]))
            if len(i):
                # the cost of those alone that may go on
                g, t = gap[i], s[i]
                ahead = (1 - 0.85**g) / 0.15
                trust = t[:, 4] * 0.97 ** (g - 1)
                off = np.sqrt((xy[j, 0] - (t[:, 0] + t[:, 2] * ahead)) ** 2 + (xy[j, 1] - (t[:, 1] + t[:, 3] * ahead)) ** 2) / whole[i, 0]
                total = ((1 - trust) * way[i, j] + trust * off) / lim.unit + (1 - self.seen[i] / self.seen.max())
                order = np.argsort(total, kind="stable")
                used = set()
                for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                    if a not in used and not found[b]:
                        used.add(a)
                        found[b] = int(self.number[a])
                        px, py = places[b]
                        h = self.history[a] = [*self.history[a], (frame, px, py)][-HISTORY:]
                        self.seen[a] += 1
                        self.at[a], self.until[a], self.state[a] = frame, self._until(frame, px, py), (px, py, *_motion(h))
        fresh = [k for k, t in enumerate(found) if not t]
        n, self.frame = len(fresh), frame
        if n:
            for number, k in enumerate(fresh, self.count + 1):
                found[k] = number
            self.count += n
            self.number, self.seen, self.at = np.append(self.number, [found[k] for k in fresh]), np.append(self.seen, np.ones(n, int)), np.append(self.at, np.full(n, frame))
            self.until = np.append(self.until, [self._until(frame, *places[k]) for k in fresh])
            self.history += [[(frame, *places[k])] for k in fresh]
            self.state = np.concatenate([self.state, [(*places[k], *_STILL) for k in fresh]])
        return np.array(found, int)


def _walk(tracker: GlobalTracker, rows: pd.DataFrame) -> np.ndarray:
    """Track numbers of rows in order of frame and det; 0 for frames that the tracker has passed."""
    frames, xy = rows["frame"].to_numpy(), rows[["x", "y"]].to_numpy(float)
    edges = [0, *(np.flatnonzero(frames[1:] != frames[:-1]) + 1).tolist(), len(frames)]
    ids = np.zeros(len(frames), int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a and frames[a] > tracker.frame:
            ids[a:b] = tracker.update(int(frames[a]), xy[a:b])
    return ids


ROWS = "video string, frame long, det long, track long"


def _placed(dets: DataFrame) -> DataFrame:
    """video, frame, det and the centre; rows without a video, frame or box belong to no track and are left out."""
    rows = dets.select("video", "frame", "det", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return rows.where("video is not null and frame is not null and x is not null and y is not null")


def global_tracks(dets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Batch: video, frame, det, track; a video is walked through by one worker, which holds its open tracks only.

    The number of partitions is given, so that adaptive execution does not put several videos into one task.
    """

    def run(batches):
        video, tracker, held = None, GlobalTracker(limits), None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                b = b if held is None else pd.concat([held, b], ignore_index=True)
                # the last frame may go on in the next batch
                tail = ((b["video"] == b["video"].iloc[-1]) & (b["frame"] == b["frame"].iloc[-1])).to_numpy() if len(b) else np.zeros(0, bool)
                held, b = b[tail], b[~tail]
            else:
                b = held
            if b is None or not len(b):
                continue
            for name, own in b.groupby("video", sort=False):
                if name != video:
                    video, tracker = name, GlobalTracker(limits)
                out = own[["video", "frame", "det"]].copy()
                out["track"] = _walk(tracker, own)
                yield out

    parts = max(200, int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _placed(dets).repartition(parts, "video").sortWithinPartitions("video", "frame", "det").mapInPandas(run, ROWS)


def stream_global_tracks(dets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Stream: the same rows; a frame must come whole in one trigger and frames in order, earlier ones are left out.

    The tracker is the query's state: a query that is started again on its checkpoint goes on.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = GlobalTracker.load(state.get[0], limits) if state.exists else GlobalTracker(limits)
        rows = pd.concat(list(batches)).sort_values(["frame", "det"], ignore_index=True)  # one video's rows of one trigger
        out = rows[["frame", "det"]].copy()
        out.insert(0, "video", key[0])
        out["track"] = _walk(tracker, rows)
        state.update((tracker.dump(),))
        yield out[out["track"] > 0]

    return _placed(dets).groupBy("video").applyInPandasWithState(step, ROWS, "tracker binary", "append", GroupStateTimeout.NoTimeout)


def kept_tracks(rows: DataFrame, least: int = 30) -> DataFrame:
    """Tracks of at least ``least`` boxes, numbered from 1 in each video by their first frame, the longer first: video, track, track_id, first_frame, last_frame, boxes."""
    from .ranks import numbered

    spans = rows.groupBy("video", "track").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("boxes")).where(F.col("boxes") >= least)
    return numbered(spans, ["video"], ["first_frame", F.desc("last_frame"), "track"], "track_id").select("video", "track", "track_id", "first_frame", "last_frame", "boxes")
