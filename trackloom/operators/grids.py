"""Sums over windows of dense grids: where mass is missing, where a crowd has a hole.

A grid is one row a cell (keys, gx, gy, value), cells that are left out count 0.  Window sums
come from running sums along rows and then along columns, so that their cost does not depend on
the size of the window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .grouped import per_group, typed
from .nullsafe import join_same


def dense(cells: DataFrame, keys: Sequence[str], nx: int, ny: int, value: str = "value") -> DataFrame:
    """All cells of every grid that has one: keys, gx, gy, value; cells outside do not count, repeated ones add up."""
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    whole = cells.select(*keys).distinct().withColumn("gx", axis(nx)).withColumn("gy", axis(ny))
    known = cells.where(F.col("gx").between(0, nx - 1) & F.col("gy").between(0, ny - 1)).groupBy(*keys, F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy")).agg(F.sum(value).cast("double").alias("value"))
    return join_same(whole, known, [*keys, "gx", "gy"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def _along(keys: Sequence[str], at: str, other: str, value: str, size: int) -> tuple[Column, Column]:
    """The running sum of ``value`` along ``at`` (to be named run_), and the sum of ``size`` cells, of which size // 2 lie before the cell; cells outside are 0."""
    w = Window.partitionBy(*keys, other).orderBy(at)
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before, after = size // 2, size - 1 - size // 2
    total = F.sum(value).over(Window.partitionBy(*keys, other))
    upto = F.coalesce(F.lead("run_", after).over(w), total) if after else F.col("run_")
    return running, upto - F.lag("run_", before + 1, 0.0).over(w)


def window_sums(grid: DataFrame, keys: Sequence[str], wide: int, high: int, nx: int, ny: int, name: str = "mass") -> DataFrame:
    """A dense grid with ``name``: the sum of the wide x high cells around each cell."""
    run, across = _along(keys, "gx", "gy", "value", min(wide, 2 * nx))
    rows = grid.withColumn("run_", run).withColumn("row_", across)
    run, down = _along(keys, "gy", "gx", "row_", min(high, 2 * ny))
    return rows.withColumn("run_", run).withColumn(name, down).drop("run_", "row_")


def residual_region(density: DataFrame, observed: DataFrame, keys: Sequence[str], nx: int, ny: int, width: int, height: int, share: float = 0.3) -> DataFrame:
    """The window in which most of the expected mass was not observed: keys, x1, y1, x2, y2 (pixels of a width x height image), missing.

    ``density`` and ``observed`` are grids (keys, gx, gy, value) of nx x ny cells; the window
    takes ``share`` of each side.  Residuals below 0 count 0.  The first of equal sums, row by
    row, is taken (sums to nine decimals); windows that reach out of the image are moved inside.
    """
    wide, high = max(1, int(nx * share)), max(1, int(ny * share))
    left = dense(density, keys, nx, ny)
    both = join_same(left, dense(observed, keys, nx, ny).withColumnRenamed("value", "seen"), [*keys, "gx", "gy"], "left")
    rest = both.withColumn("value", F.greatest(F.col("value") - F.coalesce("seen", F.lit(0.0)), F.lit(0.0))).drop("seen")
    sums = settle(window_sums(rest, keys, wide, high, nx, ny), "windows")
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.round("mass", 9)).alias("m"), "gy", "gx")).alias("b"))
    inside = lambda at, size, n: F.least(F.greatest(at - size // 2, F.lit(0)), F.lit(n - size))
    best = best.select(*keys, inside(F.col("b.gx"), wide, nx).alias("cx"), inside(F.col("b.gy"), high, ny).alias("cy")).withColumns({"gx": F.col("cx") + wide // 2, "gy": F.col("cy") + high // 2})
    found = join_same(best, sums.select(*keys, "gx", "gy", "mass"), [*keys, "gx", "gy"])
    pixel = lambda cell, size, n: F.floor(cell * size / n).cast("long")
    return found.select(*keys, pixel(F.col("cx"), width, nx).alias("x1"), pixel(F.col("cy"), height, ny).alias("y1"), pixel(F.col("cx") + wide, width, nx).alias("x2"), pixel(F.col("cy") + high, height, ny).alias("y2"), F.col("mass").alias("missing"))


def _around(grid: np.ndarray, size: int) -> np.ndarray:
    """The sums of ``size`` rows of an array, of which size // 2 lie before the row; rows outside are 0."""
    upto = np.concatenate([np.zeros((1, grid.shape[1])), np.cumsum(grid, axis=0)])
    row = np.arange(len(grid))
    return upto[np.minimum(row + size - size // 2, len(grid))] - upto[np.maximum(row - size // 2, 0)]


def _highest(grid: np.ndarray, reach: int) -> np.ndarray:
    """The greatest of the rows of an array up to ``reach`` before and after each one."""
    top = grid.copy()
    for k in range(1, min(reach, len(grid) - 1) + 1):
        np.maximum(top[k:], grid[:-k], out=top[k:])
        np.maximum(top[:-k], grid[k:], out=top[:-k])
    return top


def low_density_centres(dets: DataFrame, keys: Sequence[str], width: int, height: int, cell_w: float, cell_h: float, least_ring: float, most: int = 12, scale: int = 4) -> DataFrame:
    """Holes in a crowd: keys, rank, x, y, ring; empty cells of which the surroundings hold at least ``least_ring`` boxes.

    Boxes are counted on cells of ``scale`` pixels.  A candidate has less than half a box within
    cell_w x cell_h and the highest count in the ring up to three times that size among the 9 x 9
    cells around it.  Candidates by falling ring, x and y suppress later ones within an ellipse
    of 0.7 cells; the first ``most`` of a frame are reported.
    """
    nx, ny = -(-width // scale), -(-height // scale)
    at = lambda a, b, n: F.least(F.greatest(F.rint((F.col(a) + F.col(b)) / (2 * scale)), F.lit(0.0)), F.lit(float(n - 1))).cast("long")
    # only cells with boxes are moved: a worker lays out one grid after the other
    cells = dets.select(*keys, at("x1", "x2", nx).alias("gx"), at("y1", "y2", ny).alias("gy")).groupBy(*keys, "gx", "gy").agg(F.count("*").cast("double").alias("value"))
    size = lambda c: max(1, round(c / scale))

    def fold(g):
        grid = np.zeros((nx, ny))
        grid[g["gx"], g["gy"]] = g["value"]
        central = _around(_around(grid, size(cell_w)).T, size(cell_h)).T
        ring = _around(_around(grid, size(3 * cell_w)).T, size(3 * cell_h)).T - central
        px, py = np.nonzero((central < 0.5) & (ring >= least_ring) & (ring >= _highest(_highest(ring, 4).T, 4).T))
        order = np.lexsort((-py, -px, -ring[px, py]))
        x, y = px[order] * scale, py[order] * scale
        kept: list[int] = []
        for k in range(len(order)):
            if (((x[k] - x[kept]) / (0.7 * cell_w)) ** 2 + ((y[k] - y[kept]) / (0.7 * cell_h)) ** 2 >= 1).all():
                kept.append(k)
                if len(kept) >= most:
                    break
        at_ = order[kept]
        return {**{k: np.repeat(g[k][:1], len(kept)) for k in keys}, "rank": np.arange(1, len(kept) + 1), "x": x[kept], "y": y[kept], "ring": ring[px[at_], py[at_]]}

    return per_group(cells, keys, [], fold, f"{typed(cells, keys)}, rank long, x long, y long, ring double")
