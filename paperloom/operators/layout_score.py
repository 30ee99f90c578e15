"""How alike two renderings of a page are, from the boxes of their ink: occupancy grids, profiles, extents and density.

A grid needs no box-by-cell pairs: a box marks the four corners of the cells that it covers, marks of equal cells are summed, and
two running sums, along rows and then along columns, give how many boxes cover each cell. A page has a fixed number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.choices import let

GRID, SOFT, REACH = 64, 4, 3  # cells on either side; cells of a soft cell's side; places on either side of a mean
PAGES = 64  # pages that a task measures at a time
MEASURES = ["row_x", "row_y", "col_x", "col_y", "low", "high", "source", "output"]
#: The weights of the scores.
WEIGHTS = {"row_score": 0.25, "occupancy_score": 0.20, "column_score": 0.10, "bbox_score": 0.05, "density_score": 0.05}


def profile_similarity(a: Column, b: Column) -> Column:
    """0.65 (1 - half the L1 distance of the shares) + 0.35 soft intersection over union of the shapes (shares of the peak).

    Of two empty profiles, or profiles without any weight, it is 1; if one has none, 0. The longer one is cut.
    """
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x)

    def scored(p: Column) -> Column:
        x, y, n = p["x"], p["y"], p["n"]
        l1 = total(F.zip_with(x, y, lambda u, v: F.abs(u / n["sx"] - v / n["sy"])))
        low = total(F.zip_with(x, y, lambda u, v: F.least(u / n["px"], v / n["py"])))
        high = total(F.zip_with(x, y, lambda u, v: F.greatest(u / n["px"], v / n["py"])))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * F.greatest(F.lit(0.0), 1 - l1 / 2) + 0.35 * low / high))

    size = F.least(F.size(a), F.size(b))
    cut = F.struct(F.slice(a, F.lit(1), size).alias("x"), F.slice(b, F.lit(1), size).alias("y"))
    norms = lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.struct(total(c["x"]).alias("sx"), total(c["y"]).alias("sy"), F.array_max(c["x"]).alias("px"), F.array_max(c["y"]).alias("py")).alias("n"))
    some = let(let(cut, norms), lambda p: F.when((p["n"]["sx"] <= 1e-6) & (p["n"]["sy"] <= 1e-6), F.lit(1.0)).when((p["n"]["sx"] <= 1e-6) | (p["n"]["sy"] <= 1e-6), F.lit(0.0)).otherwise(scored(p)))
    return F.when(size == 0, F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(some)


def _marks(boxes: DataFrame, by: list[str], width: float, height: float, grid: int) -> DataFrame:
    """by, row, col and n: the marks at the corners of the cells that boxes with left, top, right and bottom cover."""
    cell = lambda c, size, up: F.least(F.greatest((F.ceil(F.col(c) * grid / size) if up else F.floor(F.col(c) * grid / size)).cast("int"), F.lit(0)), F.lit(grid))
    spans = boxes.select(*by, cell("left", width, False).alias("c0"), cell("right", width, True).alias("c1"), cell("top", height, False).alias("r0"), cell("bottom", height, True).alias("r1"))
    corner = lambda r, c, n: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), F.lit(n).alias("n"))
    marks = spans.select(*by, F.explode(F.array(corner("r0", "c0", 1), corner("r0", "c1", -1), corner("r1", "c0", -1), corner("r1", "c1", 1))).alias("m"))
    return marks.groupBy(*by, "m.row", "m.col").agg(F.sum("m.n").alias("n"))


def covered(boxes: DataFrame, by: list[str], width: float, height: float, grid: int = GRID) -> DataFrame:
    """by, row, col and cover of every cell of a page's grid, for boxes with left, top, right and bottom."""
    marks = _marks(boxes, by, width, height, grid)
    cells = boxes.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("row")).select(*by, "row", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("col"))
    every = cells.join(marks, [*by, "row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    along = F.sum("n").over(W.partitionBy(*by, "row").orderBy("col"))
    return every.withColumn("n", along).withColumn("cover", F.sum("n").over(W.partitionBy(*by, "col").orderBy("row"))).drop("n")


def _measured(by: int, grid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages with their marks: smoothed profiles of both sides' ink along rows and columns, the lesser and greater ink of soft cells, and the ink of each side."""
    soft, reach = np.arange(0, grid, SOFT), np.arange(grid)
    low, high = np.maximum(reach - REACH, 0), np.minimum(reach + REACH + 1, grid)
    for batch in batches:
        for i in range(0, batch.num_rows, PAGES):
            part = batch.slice(i, PAGES)
            marks, n = part.column("marks"), part.num_rows
            side, row, col, count = (x.to_numpy(zero_copy_only=False) for x in marks.flatten().flatten())
            cover = np.zeros((n, 2, grid + 1, grid + 1), np.int64)
            np.add.at(cover, (np.repeat(np.arange(n), marks.value_lengths().to_numpy()), side, row, col), count)
            ink = (cover.cumsum(2).cumsum(3)[:, :, :grid, :grid] > 0).astype(np.int64)
            out = part.columns[:by]
            for axis in (3, 2):
                sums = np.concatenate((np.zeros((n, 2, 1), np.int64), ink.sum(axis).cumsum(2)), axis=2)
                smooth = (sums[:, :, high] - sums[:, :, low]) / float(2 * REACH + 1)
                out += [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * grid), pa.array(smooth[:, k].ravel())) for k in (0, 1)]
            cells = np.add.reduceat(np.add.reduceat(ink, soft, axis=2), soft, axis=3) / (SOFT * SOFT)
            for x in (cells.min(1), cells.max(1), cells[:, 0], cells[:, 1]):
                out.append(pa.array(x.sum((1, 2))))
            yield pa.RecordBatch.from_arrays(out, [*part.schema.names[:by], *MEASURES])


def layout_scores(boxes: DataFrame, by: list[str], width: float, height: float, grid: int = GRID) -> DataFrame:
    """by and the scores of each page, of boxes with side (source or output), left, top, right and bottom.

    Scores are shares; a page without ink on one side scores 0 where it is compared, one without any ink isn't there. ``score`` is
    their mean by ``WEIGHTS``. A page travels as its summed marks, at most (grid + 1) squared a side; cells are no rows.
    """
    sides = ["source", "output"]
    marks = _marks(boxes.where(F.col("side").isin(*sides)), [*by, "side"], width, height, grid)
    mark = F.struct((F.col("side") == "output").cast("int").alias("side"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "n")
    pages = marks.groupBy(*by).agg(F.collect_list(mark).alias("marks"))
    schema = T.StructType([*pages.schema.fields[: len(by)], *[T.StructField(c, T.ArrayType(T.DoubleType()) if c[-1] in "xy" else T.DoubleType()) for c in MEASURES]])
    out = pages.mapInArrow(partial(_measured, len(by), grid), schema)
    area = [F.col(c) * SOFT * SOFT for c in sides]
    density = F.when(F.greatest(*area) > 0, F.least(*area) / F.greatest(*area)).otherwise(F.lit(1.0))
    out = out.select(*by, F.when(F.col("high") > 1e-6, F.col("low") / F.col("high")).otherwise(F.lit(1.0)).alias("occupancy_score"), density.alias("density_score"), *[profile_similarity(F.col(f"{c}_x"), F.col(f"{c}_y")).alias(f"{name}_score") for c, name in (("row", "row"), ("col", "column"))])
    edge = lambda f, c, side: f(F.when(F.col("side") == side, F.col(c)))
    ends = boxes.groupBy(*by).agg(*[edge(f, c, s).alias(f"{s}_{c}") for s in sides for c, f in (("left", F.min), ("top", F.min), ("right", F.max), ("bottom", F.max))])
    away = sum((F.abs(F.col(f"source_{c}") - F.col(f"output_{c}")) / max(1.0, size) for c, size in (("left", width), ("top", height), ("right", width), ("bottom", height))), F.lit(0.0)) / 4
    out = out.join(ends.select(*by, F.coalesce(F.greatest(F.lit(0.0), 1 - away * 5), F.lit(0.0)).alias("bbox_score")), by)
    score = sum((F.col(c) * weight for c, weight in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return out.select(*by, *WEIGHTS, score.alias("score"))

