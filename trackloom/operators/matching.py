"""Order-dependent operators inside a frame: assignment, suppression, average precision, trackers' state.

Each works on one frame or one track at a time; frames hold some hundred boxes at most.  Candidates are found and results are summed relationally.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import FRAME, per_group, typed
from .nullsafe import join_same

BOX = ["x1", "y1", "x2", "y2"]
#: Rows of a large frame that are compared at a time, and kept boxes that they are compared with.
ROWS, OTHERS = 256, 2048
#: Cells of a cost matrix up to which an assignment is solved on lists.
CELLS = 400
#: Cells up to which a matrix is laid out at all; larger parts are solved along their pairs.
MATRIX = 250_000


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of two box arrays: intersection, over the smaller area, over the union."""
    wide = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    high = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    both = np.clip(wide, 0, None) * np.clip(high, 0, None)
    size = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    sa, sb = size(a)[:, None], size(b)[None, :]
    return both, both / np.maximum(np.minimum(sa, sb), 1e-9), both / np.maximum(sa + sb - both, 1e-9)


def _assign_few(c: list[list[float]], n: int, m: int) -> list[tuple[int, int]]:
    """The steps of `assign` on lists, which for few cells take less time than calls on arrays."""
    inf, columns = float("inf"), range(1, m + 1)
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        dist, way, seen, open_ = [inf] * (m + 1), [0] * (m + 1), [], list(columns)
        while True:
            seen.append(j0)
            i0 = owner[j0]
            row, ui, delta, j1 = c[i0 - 1], u[i0], inf, 0
            for j in open_:
                slack = row[j - 1] - ui - v[j]
                if slack < dist[j]:
                    dist[j], way[j] = slack, j0
                if dist[j] < delta:
                    delta, j1 = dist[j], j
            for j in seen:
                u[owner[j]] += delta
                v[j] -= delta
            open_.remove(j1)
            for j in open_:
                dist[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return [(owner[j] - 1, j - 1) for j in columns if owner[j]]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment by shortest augmenting paths; every row of the smaller side is assigned."""
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    if c.size <= CELLS and np.isfinite(c).all():
        pairs = _assign_few(c.tolist(), n, m)
        return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        dist, seen, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            seen[j0] = True
            i0 = owner[j0]
            slack = c[i0 - 1] - u[i0] - v[1:]
            better = ~seen[1:] & (slack < dist[1:])
            dist[1:][better] = slack[better]
            way[1:][better] = j0
            open_ = np.where(seen[1:], np.inf, dist[1:])
            j1 = int(open_.argmin()) + 1
            delta = open_[j1 - 1]
            u[owner[seen]] += delta
            v[seen] -= delta
            dist[~seen] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def assign_pairs(a: np.ndarray, b: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one-to-one choice of pairs with the greatest summed gain: which pairs (an index into them), and the prices of all rows and columns.

    ``a`` and ``b`` number rows and columns from 0; a pair comes once.  Shortest augmenting paths along the pairs there
    are, so that memory grows with the pairs and not with rows times columns; a row may stay alone.  No pair gains more
    than its row's and its column's price together, and chosen pairs gain as much: that makes the choice the best.
    """
    order = np.lexsort((b, a))
    n, m = (int(x.max()) + 1 if len(x) else 0 for x in (a, b))
    first = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    to, worth = b[order].tolist(), np.asarray(gain, float)[order].tolist()
    u, v = [0.0] * n, [0.0] * m
    of_row, of_col = [-1] * n, [-1] * m  # a row's pair, a column's row
    for i in range(n):
        best = max(range(first[i], first[i + 1]), key=worth.__getitem__, default=-1)
        if best >= 0 and worth[best] > 0:
            u[i] = worth[best]
            if of_col[to[best]] < 0:
                of_row[i], of_col[to[best]] = best, i
    for i in range(n):
        if of_row[i] >= 0 or u[i] <= 0:
            continue
        rows, dist, way, done, heap = [(i, 0.0)], {}, {}, {}, []
        least, last_row, last_col, r, at = u[i], i, -1, i, 0.0
        while True:
            base = at + u[r]
            for k in range(first[r], first[r + 1]):
                j = to[k]
                d = base + v[j] - worth[k]
                if d < dist.get(j, least) and j not in done:
                    dist[j], way[j] = d, k
                    heappush(heap, (d, j, r))
            while heap and heap[0][1] in done:
                heappop(heap)
            if not heap or heap[0][0] >= least:
                break
            at, j, r = heappop(heap)
            done[j] = (at, r)
            if of_col[j] < 0:
                least, last_col = at, j
                break
            r = of_col[j]
            rows.append((r, at))
            if at + u[r] < least:
                least, last_row = at + u[r], r
        for r, d in rows:
            if d < least:
                u[r] -= least - d
        for j, (d, _) in done.items():
            if d < least:
                v[j] += least - d
        j = last_col
        if j < 0:
            u[last_row] = 0.0
            j = to[of_row[last_row]] if last_row != i else -1
            of_row[last_row] = -1
        while j >= 0:
            r, k = done[j][1], way[j]
            j_next = to[of_row[r]] if of_row[r] >= 0 else -1
            of_row[r], of_col[j] = k, r
            j = j_next
    chosen = np.array(sorted(k for k in of_row if k >= 0), int)
    return order[chosen], np.array(u), np.array(v)


def _boxes(g: dict[str, np.ndarray], rows) -> np.ndarray:
    return np.stack([g[c][rows] for c in BOX], axis=1).astype(float)


def _both_sides(pred: DataFrame, gt: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Predictions (side 0, with conf) and truth (side 1) in one table."""
    p = pred.select(*keys, F.lit(0).alias("side"), "det", F.col("conf").cast("double").alias("conf"), *(F.col(c).cast("double").alias(c) for c in BOX))
    return p.unionByName(gt.select(*keys, F.lit(1).alias("side"), "det", F.lit(0.0).alias("conf"), *(F.col(c).cast("double").alias(c) for c in BOX)))


def hungarian(pred: DataFrame, gt: DataFrame, least_iou: float = 0.5, keys: Sequence[str] = FRAME) -> DataFrame:
    """One-to-one matches per frame with the least summed 1 - IoU; pairs below ``least_iou`` do not match.

    Returns keys (frame, or for example domain, video and frame), pred_det, gt_det, iou.
    """

    def match(g):
        p, t = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        out = []
        if len(p) and len(t):
            iou = overlaps(_boxes(g, p), _boxes(g, t))[2]
            out = [(i, j) for i, j in assign(np.where(iou >= least_iou, 1 - iou, 1e6)) if iou[i, j] >= least_iou]
        i, j = (np.array([x[k] for x in out], int) for k in (0, 1))
        return {**{k: np.repeat(g[k][:1], len(out)) for k in keys}, "pred_det": g["det"][p[i]] if len(out) else i, "gt_det": g["det"][t[j]] if len(out) else j, "iou": iou[i, j] if len(out) else np.zeros(0)}

    return per_group(_both_sides(pred.withColumn("conf", F.lit(0.0)), gt, keys), keys, ["side", "det"], match, f"{typed(pred, keys)}, pred_det long, gt_det long, iou double")


def greedy_matches(pred: DataFrame, gt: DataFrame, thresholds: list[float], keys: Sequence[str] = FRAME) -> DataFrame:
    """Predictions by falling confidence take the best free truth of their frame: keys, det, conf, and bits, of which bit k is set where the prediction hits at threshold k."""

    def match(g):
        p, t = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        iou = overlaps(_boxes(g, p), _boxes(g, t))[2] if len(p) and len(t) else np.zeros((len(p), len(t)))
        hits = np.zeros((len(thresholds), len(p)), bool)
        for k, least in enumerate(thresholds):
            free = np.ones(len(t), bool)
            for i in np.flatnonzero((iou >= least).any(axis=1)) if len(t) else []:
                open_ = np.where(free, iou[i], -1.0)
                j = int(open_.argmax())
                if open_[j] >= least:
                    free[j], hits[k, i] = False, True
        bits = (hits.astype(np.int64) << np.arange(len(thresholds))[:, None]).sum(axis=0)
        return {**{k: g[k][p] for k in keys}, "det": g["det"][p], "conf": g["conf"][p], "bits": bits}

    return per_group(_both_sides(pred, gt, keys), keys, ["side", F.desc("conf"), "det"], match, f"{typed(pred, keys)}, det long, conf double, bits long")


def average_precision(hits: DataFrame, truth: DataFrame, thresholds: list[float], keys: Sequence[str] = FRAME) -> DataFrame:
    """101-point interpolated AP per threshold from greedy matches, with recall and false positives.

    ``truth`` (keys) has a row for each true box; predictions of frames without one do not
    count.  Confidences are summed first, one row for all thresholds.  Equal confidences are one point of the curve, the confidences themselves stay exact.
    The running sums are taken inside ranges of confidence and joined with the totals of the
    ranges above, so that no task holds the whole curve.
    """
    frames = truth.groupBy(*keys).agg(F.count("*").alias("boxes"))
    # a cell per leading bits of the confidence: order holds from cell to cell
    cell = F.floor(F.col("conf") * 512).cast("long")
    judged = join_same(hits, frames.select(*keys), keys, "left_semi")
    summed = judged.groupBy(cell.alias("cell"), "conf").agg(F.count("*").alias("n"), *(F.sum(F.getbit("bits", F.lit(k)).cast("long")).alias(f"tp{k}") for k in range(len(thresholds))))
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{k}").alias("tp")) for k, t in enumerate(thresholds)))).alias("e")
    levels = summed.select("cell", "conf", "n", each).select("e.threshold", "cell", "conf", "e.tp", "n")
    cells = levels.groupBy("threshold", "cell").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    above = Window.partitionBy("threshold").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    base = cells.select("threshold", "cell", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    w = Window.partitionBy("threshold", "cell").orderBy(F.desc("conf"))
    curve = levels.select("threshold", "cell", F.sum("tp").over(w).alias("tp"), F.sum("n").over(w).alias("n")).join(base, ["threshold", "cell"])
    curve = curve.crossJoin(frames.agg(F.coalesce(F.sum("boxes"), F.lit(0)).alias("total")))  # one row
    curve = curve.select("threshold", (F.col("tp") + F.col("tp0")).alias("tp"), (F.col("n") + F.col("n0")).alias("n"), F.greatest("total", F.lit(1)).alias("total"))
    curve = curve.select("threshold", "tp", "n", (F.col("tp") / F.col("total")).alias("recall"), (F.col("tp") / F.col("n")).alias("precision"))
    # the best precision at each recall point or beyond it: first within the points that a level reaches last
    reach = F.floor(F.col("recall") * 100 + 1e-9).cast("int")
    at = curve.groupBy("threshold", reach.alias("r")).agg(F.max("precision").alias("p"))
    points = at.select("threshold", F.explode(F.sequence(F.lit(0), "r")).alias("r"), "p").groupBy("threshold", "r").agg(F.max("p").alias("p"))
    ends = curve.groupBy("threshold").agg(F.max("recall").alias("recall"), F.max(F.col("n") - F.col("tp")).alias("false_positives"))
    return points.groupBy("threshold").agg((F.sum("p") / 101).alias("ap")).join(ends, "threshold")


def unhidden(boxes: np.ndarray, sure: np.ndarray, blocks: np.ndarray, least: float, measure: str = "iou", min_common: float = 0.0, named: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Which boxes a greedy pass in their order keeps, and with ``named`` the row of the worst kept one that hides each other box (else -1).

    ``sure`` boxes come first.  Rows are compared with kept ones a tile at a time, so that memory
    does not grow with the square of a frame; without names a row that is hidden is not looked at again.
    """
    n = len(boxes)
    kept, blocker, worst = sure.copy(), np.full(n, -1), np.full(n, -np.inf)

    def compare(rows, others):
        both, small, union = overlaps(boxes[rows], boxes[others])
        score = union if measure == "iou" else small
        return np.where((score >= least) & (both >= min_common) & blocks[others][None, :], score, -np.inf)

    def note(rows, others, score):
        first = score.argmax(axis=1)
        value = score[np.arange(len(rows)), first]
        more = value > worst[rows]
        worst[rows[more]], blocker[rows[more]] = value[more], others[first[more]]

    open_ = np.flatnonzero(~sure)
    for a in range(0, len(open_), ROWS):
        rows = open_[a : a + ROWS]
        before = np.flatnonzero(kept[: rows[0]])
        b, step = 0, OTHERS if named else 32  # most rows of a crowd are hidden by one of a few boxes
        while b < len(before):
            left = rows if named else rows[blocker[rows] < 0]
            if not len(left):
                break
            note(left, before[b : b + step], compare(left, before[b : b + step]))
            b, step = b + step, min(2 * step, OTHERS)
        rows = rows if named else rows[blocker[rows] < 0]
        score = compare(rows, rows)
        for k, i in enumerate(rows):
            if k:
                note(rows[k : k + 1], rows[:k], np.where(kept[rows[:k]], score[k : k + 1, :k], -np.inf))
            kept[i] = blocker[i] < 0
    return kept, blocker


def suppress(dets: DataFrame, least: float, order: list[Column], measure: str = "iou", min_common: float = 0.0, protected: Column | None = None, blocks: Column | None = None, keys: Sequence[str] = FRAME) -> DataFrame:
    """Greedy suppression per frame in a total order: a box goes if it overlaps a kept one by ``least`` or more.

    ``measure`` is ``iou`` or ``io_min``; ``protected`` rows are kept from the start, and block
    others; rows where ``blocks`` is not true never hide another box.  Adds kept and blocker
    (the worst kept box).  Nulls in the order come first.
    """
    ranked = dets.withColumns({
        "rank_": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)),
        "sure_": F.coalesce(protected, F.lit(False)) if protected is not None else F.lit(False),
        "blocks_": F.coalesce(blocks, F.lit(False)) if blocks is not None else F.lit(True),
    })

    def fold(g):
        boxes = _boxes(g, slice(None))
        if len(boxes) > ROWS:
            kept, by = unhidden(boxes, g["sure_"].astype(bool), g["blocks_"].astype(bool), least, measure, min_common)
            return {**{k: g[k] for k in keys}, "det": g["det"], "kept": kept, "blocker": np.where(by < 0, -1, g["det"][by])}
        both, small, union = overlaps(boxes, boxes)
        score = union if measure == "iou" else small
        clash = (score >= least) & (both >= min_common) & g["blocks_"].astype(bool)[None, :]
        np.fill_diagonal(clash, False)
        n = len(boxes)
        kept, blocker = g["sure_"].astype(bool).copy(), np.full(n, -1)
        # sure boxes come first; a box without any clash is kept without looking at the others
        kept |= ~clash.any(axis=1)
        for i in np.flatnonzero(~kept):
            hit = np.flatnonzero(kept[:i] & clash[i, :i]) if i else []
            kept[i] = not len(hit)
            if len(hit):
                blocker[i] = g["det"][hit[score[i][hit].argmax()]]
        return {**{k: g[k] for k in keys}, "det": g["det"], "kept": kept, "blocker": blocker}

    rows = ranked.select(*keys, "det", "rank_", "sure_", "blocks_", *(F.col(c).cast("double").alias(c) for c in BOX))
    return per_group(rows, keys, [F.desc("sure_"), "rank_"], fold, f"{typed(dets, keys)}, det long, kept boolean, blocker long")


def soft_nms(dets: DataFrame, sigma: float = 0.5, least: float = 1e-4, keys: Sequence[str] = FRAME) -> DataFrame:
    """Gaussian decay of scores by overlap with better boxes; drops boxes below ``least``: keys, det, score."""

    def fold(g):
        boxes = _boxes(g, slice(None))
        iou = overlaps(boxes, boxes)[2]
        score, open_, out = g["conf"].astype(float).copy(), np.ones(len(boxes), bool), []
        while open_.any():
            i = int(np.where(open_, score, -1).argmax())
            if score[i] <= least:
                break
            open_[i] = False
            out.append(i)
            near = open_ & (iou[i] > 0)
            score[near] *= np.exp(-(iou[i][near] ** 2) / sigma)
        return {**{k: g[k][out] for k in keys}, "det": g["det"][out], "score": score[out]}

    rows = dets.select(*keys, "det", F.col("conf").cast("double").alias("conf"), *(F.col(c).cast("double").alias(c) for c in BOX))
    return per_group(rows, keys, [F.desc("conf"), "det"], fold, f"{typed(dets, keys)}, det long, score double")


def motion_states(moves: DataFrame, stationary: float, fast: float, hysteresis: float = 1.2, hold: int = 2) -> DataFrame:
    """stationary, walking or fast along each track, with hysteresis and a minimum number of agreeing observations."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "event_id"])
        state, candidate, seen, out = "unknown", None, 0, []
        for v in g["speed"]:
            if v is None or np.isnan(v):
                candidate, seen = None, 0
                out.append("unknown")
                continue
            now = "fast" if v >= fast else "stationary" if v <= stationary or (state == "stationary" and v < hysteresis * stationary) else "walking"
            if state == "unknown":
                state = now
            elif now != state:
                candidate, seen = now, seen + 1 if now == candidate else 1
                if seen >= hold:
                    state, candidate, seen = now, None, 0
            else:
                candidate, seen = None, 0
            out.append(state)
        return pd.DataFrame({"track_id": g["track_id"], "frame": g["frame"], "event_id": g["event_id"], "state": out})

    return moves.select("track_id", "frame", "event_id", "speed").groupBy("track_id").applyInPandas(fold, "track_id long, frame long, event_id long, state string")


def isotonic(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pool-adjacent-violators fit per key: steps (upper score, calibrated value, weight).

    Equal scores are summed on the cluster first; scores stay exact.  Ranges of scores are
    pooled each for itself, and then the blocks that are left of a key: pooling parts first
    changes nothing.  Rows without a score or outcome do not count.
    """
    from .ranks import in_ranges

    known = rows.where(F.col("score").isNotNull() & F.col("correct").isNotNull())
    summed = known.groupBy(*keys, F.col("score").cast("double").alias("upper")).agg(F.sum("correct").cast("double").alias("hits"), F.count("*").cast("double").alias("n"))
    ranged = in_ranges(summed, [*keys, "upper"], "levels")

    def pool(by):
        def fold(g):
            blocks: list[list[float]] = []
            for s, h, n in zip(g["upper"].tolist(), g["hits"].tolist(), g["n"].tolist(), strict=True):
                blocks.append([s, h, n])
                while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                    s, h, n = blocks.pop()
                    blocks[-1] = [s, blocks[-1][1] + h, blocks[-1][2] + n]
            columns = dict(zip(("upper", "hits", "n"), map(np.array, zip(*blocks, strict=True)), strict=True))
            return {**{k: np.repeat(g[k][:1], len(blocks)) for k in by}, **columns}

        return fold

    schema = ", upper double, hits double, n double"
    parts = per_group(ranged, [*keys, "range_"], ["upper"], pool([*keys, "range_"]), typed(ranged, [*keys, "range_"]) + schema)
    steps = per_group(parts, keys, ["upper"], pool(keys), typed(parts, keys) + schema)
    return steps.select(*keys, "upper", (F.col("hits") / F.col("n")).alias("value"), F.col("n").alias("weight"))


def calibrated(scores: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` (keys, score) with ``calibrated``: the value of the first step whose upper score is not below the score, the last step's beyond.

    Null where the key has no fit.  Steps of a key form one array, which has a bounded size.
    """
    fitted = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("upper", "value"))).alias("steps_"))
    same = [f.eqNullSafe(g) for f, g in ((scores[k], fitted[k]) for k in keys)]
    joined = scores.join(fitted, same, "left").drop(*(fitted[k] for k in keys))
    fits = F.filter("steps_", lambda s: s["upper"] >= F.col("score"))
    value = F.when(F.size(fits) > 0, fits[0]["value"]).otherwise(F.element_at("steps_", -1)["value"])
    return joined.withColumn("calibrated", F.when(F.col("score").isNotNull() & F.col("steps_").isNotNull(), value)).drop("steps_")


def oscillation(obs: DataFrame, value: str, least: int = 8, span: int = 30) -> DataFrame:
    """Dominant period of a track's signal by the real Fourier transform: track_id, n, period, share of power."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "event_id"]).drop_duplicates("frame")
        if len(g) < least or g["frame"].iloc[-1] - g["frame"].iloc[0] < span:
            return pd.DataFrame({"track_id": [], "n": [], "period": [], "share": []})
        t = np.linspace(g["frame"].iloc[0], g["frame"].iloc[-1], len(g))
        x = np.interp(t, g["frame"], g[value].astype(float))
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2
        k = int(power[1:].argmax()) + 1
        return pd.DataFrame({"track_id": [g["track_id"].iloc[0]], "n": [len(g)], "period": [(t[-1] - t[0]) / k], "share": [power[k] / max(power[1:].sum(), 1e-12)]})

    return obs.select("track_id", "frame", "event_id", value).groupBy("track_id").applyInPandas(fold, "track_id long, n long, period double, share double")
