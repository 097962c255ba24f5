"""Faces in pictures: decoding of a detector's answers, overlaps, least size and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.operators.fulltext import once

from argentum.functions.media import box_iou

#: Fixed values of the detector: side of its input, anchors of a cell, least score, most overlap.
SIDE, ANCHORS, LEAST_SCORE, MOST_OVERLAP = 640, 2, 0.65, 0.4
#: Sides below which a face is left out; share of a face that its crop has around it; side of the crop's picture.
MIN_SIDE, MARGIN_X, MARGIN_Y, CROP_SIDE = 24, 0.22, 0.28, 180
BOX = ["x1", "y1", "x2", "y2"]


def decode(levels: DataFrame, key: str, least: float = LEAST_SCORE) -> DataFrame:
    """One row per face: key, level, anchor, score, x1, y1, x2, y2, landmarks (x and y in turn).

    A row of levels has key, stride, scale (of the picture in the detector's input), and the
    arrays scores, boxes (four for each score: left, top, right, bottom of a cell) and landmarks
    (ten for each score).  A cell of the grid has ANCHORS scores, row by row; scores without
    boxes or landmarks, or beyond the grid, are left out.
    """
    size = F.floor(F.lit(SIDE) / F.col("stride"))
    cell = F.floor(F.col("anchor") / ANCHORS)
    x, y = cell % F.col("of_row"), F.floor(cell / F.col("of_row"))
    held = lambda array, n: F.size(array) >= (F.col("anchor") + 1) * n
    side = lambda k: F.get("boxes", (F.col("anchor") * 4 + k).cast("int"))
    unit = F.col("stride") / F.col("scale")
    points = F.transform(
        F.slice("landmarks", (F.col("anchor") * 10 + 1).cast("int"), F.lit(10)), lambda p, i: (p + F.when(i % 2 == 0, x).otherwise(y)) * unit
    )
    return (
        levels.withColumn("of_row", size)
        .select("*", F.posexplode("scores").alias("anchor", "score"))
        .where((F.col("score") > least) & held("boxes", 4) & held("landmarks", 10))
        .where(F.col("anchor") < F.col("of_row") * F.col("of_row") * ANCHORS)
        .select(
            key,
            F.col("stride").alias("level"),
            "anchor",
            "score",
            ((x - side(0)) * unit).alias("x1"),
            ((y - side(1)) * unit).alias("y1"),
            ((x + side(2)) * unit).alias("x2"),
            ((y + side(3)) * unit).alias("y2"),
            points.alias("landmarks"),
        )
    )


def suppress(faces: DataFrame, key: str, order: list[str], most: float = MOST_OVERLAP) -> DataFrame:
    """Faces of each picture that overlap no better one by more than ``most``: best score first, then by ``order``.

    A picture has as many faces as its detector has anchors, at most; they are one array.
    """
    columns = [c for c in faces.columns if c != key]
    rank = F.struct((-F.col("score")).alias("_r"), *[F.col(c).alias(f"_r{k}") for k, c in enumerate(order)], F.struct(*columns).alias("face"))
    sides = lambda f: [f[c].cast("double") for c in BOX]
    grouped = faces.groupBy(key).agg(F.sort_array(F.collect_list(rank)).alias("all"))
    kept = F.aggregate(
        F.transform("all", lambda r: r["face"]),
        F.slice(F.transform("all", lambda r: r["face"]), 1, 0),
        lambda acc, f: F.when(F.forall(acc, lambda k: box_iou(sides(k), sides(f)) <= most), F.concat(acc, F.array(f))).otherwise(acc),
    )
    return grouped.select(key, F.explode(kept).alias("face")).select(key, "face.*")


def large_enough(box: list[Column], least: int = MIN_SIDE) -> Column:
    """Whether both sides of a box (left, top, right, bottom) have so many pixels."""
    return F.coalesce((box[2] - box[0] >= least) & (box[3] - box[1] >= least), F.lit(False))


def crop(box: list[Column], width: Column, height: Column) -> Column:
    """struct(x, y, width, height) of a face with its margins, inside the picture and at least a pixel wide and high."""

    def along(low: Column, high: Column, margin: float, bound: Column):
        room = F.greatest(high - low, F.lit(1.0)) * margin
        first = F.floor(F.least(F.greatest(low - room, F.lit(0.0)), bound - 1.0))
        last = F.floor(F.least(F.greatest(high + room, first + 1.0), bound.cast("double")))
        return first.cast("int"), (last - first).cast("int")

    (x, w), (y, h) = along(box[0], box[2], MARGIN_X, width), along(box[1], box[3], MARGIN_Y, height)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def fitted(width: Column, height: Column, side: int = CROP_SIDE) -> Column:
    """struct(width, height) of a crop's picture: as large as a square allows, at least a pixel."""
    share = F.least(side / width, side / height)
    own = lambda x: F.greatest(F.floor(x * share + 0.5), F.expr("1L")).cast("int")
    return F.struct(own(width).alias("width"), own(height).alias("height"))


#: Where eyes, nose and corners of the mouth lie in an aligned face of 112 by 112 (fixed values): x, y of each.
ALIGNED = [38.2946, 51.6963, 73.5318, 51.5014, 56.0252, 71.7366, 41.5493, 92.3655, 70.7299, 92.2041]


def similarity(source: list[Column], destination: list[Column]) -> Column:
    """The turn, scale and shift that take points nearest to others by least squares, as struct(a, b, x, y).

    Points are given as x, y, x, y, …; (u, v) goes to (a u - b v + x, b u + a v + y).  The best turn never mirrors: its angle
    comes from the sums and differences of the covariances, which is the two-sided decomposition in closed form.  Where all source points
    are one, nothing is turned or scaled.
    """
    n = len(source) // 2
    mean = lambda points, k: sum(points[k + 2 :: 2], points[k]) / F.lit(float(n))
    means = F.struct(*[mean(p, k).alias(f"{name}{'xy'[k]}") for name, p in (("s", source), ("d", destination)) for k in (0, 1)])

    def sums(m: Column) -> Column:
        at = [(source[2 * i] - m["sx"], source[2 * i + 1] - m["sy"], destination[2 * i] - m["dx"], destination[2 * i + 1] - m["dy"]) for i in range(n)]
        total = lambda terms: sum(terms[1:], terms[0])
        return F.struct(
            m.alias("m"),
            total([u * u + v * v for u, v, _, _ in at]).alias("spread"),
            total([p * u + q * v for u, v, p, q in at]).alias("along"),
            total([q * u - p * v for u, v, p, q in at]).alias("across"),
        )

    def solved(t: Column) -> Column:
        some = t["spread"] > 0
        return F.struct(
            t["m"].alias("m"), F.when(some, t["along"] / t["spread"]).otherwise(1.0).alias("a"), F.when(some, t["across"] / t["spread"]).otherwise(0.0).alias("b")
        )

    def shifted(r: Column) -> Column:
        m, a, b = r["m"], r["a"], r["b"]
        return F.struct(a.alias("a"), b.alias("b"), (m["dx"] - a * m["sx"] + b * m["sy"]).alias("x"), (m["dy"] - b * m["sx"] - a * m["sy"]).alias("y"))

    return once(once(once(means, sums), solved), shifted)
