"""Entrance gate: confirmed crossings of a directed segment, in batch and on streams.

The same small state machine runs over sorted partitions (batch) and behind
``applyInPandasWithState`` (stream), one state per track.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Gate:
    """The segment from (ax, ay) to (bx, by); its left side is inside where ``inside`` is 1."""

    ax: float
    ay: float
    bx: float
    by: float
    inside: int = 1
    fps: float = 30.0
    deadband: float = 5.0
    confirm_seconds: float = 0.1
    max_gap_seconds: float = 0.15
    max_speed: float = 20.0
    cooldown_seconds: float = 0.5


@dataclass
class Memory:
    """What is kept of a track: its last point, the side last confirmed and where, and how long a side has been seen."""

    frame: int = -1
    x: float = 0.0
    y: float = 0.0
    side: int = 0
    anchor_x: float = 0.0
    anchor_y: float = 0.0
    pending: int = 0
    seen: int = 0
    last_event: int = -(10**12)


def advance(gate: Gate, m: Memory, frame: int, x: float, y: float, body: float) -> tuple[Memory, tuple[str, float, float] | None]:
    """The memory after one observation, and the crossing (direction, x, y) that it confirms.

    A gap or a jump forgets everything, the cool-down included; bodies count as one pixel long
    at least.  The dead band ends a side's run.  ``confirm_seconds`` of observations in a row
    confirm a side; where it differs from the side confirmed before, the straight way from the
    point of that confirmation must meet the segment itself.
    """
    dx, dy = gate.bx - gate.ax, gate.by - gate.ay
    length = math.hypot(dx, dy)
    off = lambda px, py: (dx * (py - gate.ay) - dy * (px - gate.ax)) / length
    distance = off(x, y)
    side = 0 if abs(distance) <= gate.deadband else 1 if distance > 0 else -1
    dt = (frame - m.frame) / gate.fps
    if m.frame < 0 or dt > gate.max_gap_seconds or math.hypot(x - m.x, y - m.y) / max(body, 1.0) > gate.max_speed * dt:
        m = Memory()
    seen = 0 if side == 0 else m.seen + 1 if m.pending == side else 1
    out = Memory(frame, x, y, m.side, m.anchor_x, m.anchor_y, side, seen, m.last_event)
    if not seen or seen < math.ceil(gate.confirm_seconds * gate.fps):
        return out, None
    event = None
    if m.side and side != m.side:
        was = off(m.anchor_x, m.anchor_y)
        t = was / (was - distance)
        cx, cy = m.anchor_x + t * (x - m.anchor_x), m.anchor_y + t * (y - m.anchor_y)
        along = ((cx - gate.ax) * dx + (cy - gate.ay) * dy) / (length * length)
        if 0 <= along <= 1 and (frame - m.last_event) / gate.fps >= gate.cooldown_seconds:
            event, out.last_event = ("in" if side == gate.inside else "out", cx, cy), frame
    out.side, out.anchor_x, out.anchor_y = side, x, y
    return out, event


EVENTS = "track_id long, frame long, direction string, cross_x double, cross_y double"
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
STATE = "frame long, x double, y double, side int, anchor_x double, anchor_y double, pending int, seen int, last_event long"


def gate_crossings(obs: DataFrame, gate: Gate) -> DataFrame:
    """Batch: rows (track_id, frame, x, y, body) in any order; partitions hold whole tracks, sorted, and are walked through once."""

    def run(batches):
        track, m = None, Memory()
        for b in batches:
            out = []
            for t, frame, x, y, body in b[["track_id", "frame", "x", "y", "body"]].itertuples(index=False):
                if t != track:
                    track, m = t, Memory()
                m, event = advance(gate, m, frame, x, y, body)
                if event:
                    out.append((t, frame, *event))
            yield pd.DataFrame(out, columns=_NAMES)

    return obs.select("track_id", "frame", "x", "y", "body").repartition("track_id").sortWithinPartitions("track_id", "frame").mapInPandas(run, EVENTS)


def stream_crossings(obs: DataFrame, gate: Gate) -> DataFrame:
    """Stream: the same crossings; frames of a track must arrive in order from batch to batch, older ones are left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Memory(*state.get) if state.exists else Memory()
        rows = pd.concat(list(batches)).sort_values("frame")  # one track's rows of one trigger
        out = []
        for frame, x, y, body in rows[["frame", "x", "y", "body"]].itertuples(index=False):
            if frame > m.frame:
                m, event = advance(gate, m, int(frame), x, y, body)
                if event:
                    out.append((key[0], frame, *event))
        state.update(tuple(asdict(m).values()))
        yield pd.DataFrame(out, columns=_NAMES)

    return obs.select("track_id", "frame", "x", "y", "body").groupBy("track_id").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
