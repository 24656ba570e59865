"""Pixel-level operators: frames ``image, [channel,] y, x, v`` and ``image, y, x, label``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import by_group, components, materialized, numbered

#: Pixels along a side of the tiles in which labels are worked on.
TILE = 256


def extract_channel(pixels: DataFrame, index: int, channel: str = "c", n_channels: str | None = None) -> DataFrame:
    """The channel ``index`` places from the end, counted from 1; channels are numbered from 0 in each image."""
    if n_channels:
        return pixels.where(F.col(channel) == F.col(n_channels) - index).drop(channel)
    most = pixels.groupBy(F.col("image").alias("i")).agg((F.max(channel) + 1).alias("n"))
    return pixels.join(most, F.col("image") == F.col("i")).where(F.col(channel) == F.col("n") - index).drop(channel, "i", "n")


def is_multichannel(pixels: DataFrame, needed: int, channel: str = "c") -> DataFrame:
    """Per image, whether it has as many channels as the highest index asked for."""
    return pixels.groupBy("image").agg((F.max(channel) + 1 >= needed).alias("multichannel"))


def quantile_normalize(pixels: DataFrame, low: float = 0.01, high: float = 0.998, mask: str | None = None) -> DataFrame:
    """``v`` scaled between two exact quantiles of its image and cut to whole numbers in 0..255; null where they are equal.

    With ``mask``, a boolean column, the quantiles are those of its pixels in images that have any.
    """
    chosen = F.col("v") if mask is None else F.when(F.col(mask), F.col("v"))
    both = lambda c: F.percentile(c, F.array(F.lit(low), F.lit(high)))
    q = pixels.groupBy(F.col("image").alias("i")).agg(both(chosen).alias("own"), *([] if mask is None else [both(F.col("v")).alias("all")]))
    q = q.select("i", (F.col("own") if mask is None else F.coalesce("own", "all")).alias("q"))
    scaled = F.try_divide(F.col("v") - F.col("q")[0], F.col("q")[1] - F.col("q")[0]) * 255
    return pixels.join(q, F.col("image").eqNullSafe(F.col("i"))).withColumn("scaled", F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)).cast("int"))).drop("i", "q")


def minmax_normalize(pixels: DataFrame) -> DataFrame:
    """``v`` stretched to 0..255 within its image; extremes come from a grouped count, so no image is gathered in a window."""
    ends = pixels.groupBy(F.col("image").alias("i")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return pixels.join(ends, F.col("image").eqNullSafe(F.col("i"))).withColumn("scaled", F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 255).drop("i", "lo", "hi")


def regions(labelled: DataFrame, keys: tuple[str, ...] = ("image", "label")) -> DataFrame:
    """Area, bounding box and centroid of each labelled object; label 0 and null are background."""
    inside = labelled.where(F.col("label") > 0) if dict(labelled.dtypes)["label"] in ("int", "bigint", "smallint") else labelled.where("label is not null")
    return inside.groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x")
    ).withColumn("bbox_area", (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1))


def object_count(labelled: DataFrame) -> DataFrame:
    return labelled.where("label > 0").groupBy("image").agg(F.count_distinct("label").alias("n_objects"))


def levels(pixels: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pixel values under each label, for the intensity features of proteins and masks."""
    return pixels.join(labelled.where("label > 0"), ["image", "y", "x"]).select("image", "label", "y", "x", "v")


def mask_levels(pixels: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mean, maximum and minimum only."""
    return levels(pixels, labelled).groupBy("image", "label").agg(F.avg("v").alias("int_mean"), F.max("v").alias("int_max"), F.min("v").alias("int_min"))


def _shifted(labelled: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    arms = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets)))
    return labelled.withColumn("arm", arms).select("image", (F.col("y") + F.col("arm.dy")).alias("y"), (F.col("x") + F.col("arm.dx")).alias("x"), "label", "arm")


def boundary(labelled: DataFrame) -> DataFrame:
    """Object pixels with fewer than four neighbours of their own label.

    Each pixel tells its four neighbours of itself, and a pixel counts what it hears: one grouped count instead of four joins.
    """
    inside = labelled.where("label > 0").select("image", "y", "x", "label")
    heard = _shifted(inside, [(0, 1), (0, -1), (1, 0), (-1, 0)]).select("image", "y", "x", "label").withColumn("own", F.lit(0)).unionByName(inside.withColumn("own", F.lit(1)))
    counted = heard.groupBy("image", "y", "x", "label").agg(F.sum("own").alias("own"), F.count_if(F.col("own") == 0).alias("neighbours"))
    return counted.where("own > 0 and neighbours < 4").select("image", "y", "x", "label", "neighbours")


def expand_labels(labelled: DataFrame, grid: DataFrame, distance: int, tile: int = TILE) -> DataFrame:
    """Each background pixel of the grid within the distance gets the nearest label, ties the least; labels keep their pixels.

    An exact distance transform in tiles with a margin of the distance: a scan along each row finds the nearest label in it, then each pixel
    takes the best of the rows around it. Labels are told to the tiles that they can reach; the work for a pixel grows with the distance, not its square.
    """
    side, kind = max(tile, 2 * distance, 1), dict(labelled.dtypes)
    own = grid.select("image", "y", "x").distinct().withColumns({"ty": F.floor(F.col("y") / side), "tx": F.floor(F.col("x") / side)})
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - distance) / side), F.floor((F.col(c) + distance) / side)))
    told = labelled.where("label > 0").select("image", "y", "x", "label").withColumn("ty", reach("y")).withColumn("tx", reach("x"))

    def grow(key: tuple, y: np.ndarray, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        asked, known = label == 0, label > 0
        py, px, y, x, label = y[asked].astype(np.int64), x[asked].astype(np.int64), y[known].astype(np.int64), x[known].astype(np.int64), label[known].astype(np.int64)
        if not len(py) or not len(y):
            return [py[:0], px[:0], label[:0]]
        # Only the part of the tile that has pixels, with its margin.
        top, left = py.min() - distance, px.min() - distance
        m, n = py.max() + distance - top + 1, px.max() + distance - left + 1
        seen = np.zeros((m, n), np.int64)
        near = (y >= top) & (y < top + m) & (x >= left) & (x < left + n)
        y, x, label = y[near], x[near], label[near]
        order = np.argsort(-label, kind="stable")  # of one pixel's labels the least is set last
        seen[y[order] - top, x[order] - left] = label[order]
        columns = np.broadcast_to(np.arange(n), (m, n))
        before = np.maximum.accumulate(np.where(seen > 0, columns, -1), axis=1)
        after = np.minimum.accumulate(np.where(seen > 0, columns, n)[:, ::-1], axis=1)[:, ::-1]
        none = np.int64(1) << 62
        # Squared distance and label in one number, so that the least is the nearest and then the least label.
        pack = lambda far, at, there: np.where(there, (far * far << 32) | np.take_along_axis(seen, np.where(there, at, 0), axis=1), none)
        best = np.minimum(pack(columns - before, before, before >= 0), pack(after - columns, after, after < n))
        found = np.full(len(py), none)
        for dy in range(-distance, distance + 1):
            found = np.minimum(found, best[py - top + dy, px - left] + (np.int64(dy * dy) << 32))
        near = found >> 32 <= distance * distance
        return [py[near], px[near], found[near] & 0xFFFFFFFF]

    both = own.withColumn("label", F.lit(0).cast(kind["label"])).unionByName(told)  # 0: a pixel that asks
    return by_group(both, ["image", "ty", "tx"], ["y", "x", "label"], grow, ", ".join(f"{c} {kind[c]}" for c in ("image", "y", "x", "label")))


def threshold_objects(pixels: DataFrame, cut: Column | float) -> DataFrame:
    """Label 1 for pixels over a threshold: a stand-in for a segmentation model, not its equal."""
    return pixels.select("image", "y", "x", F.when(F.col("v") > cut, 1).otherwise(0).alias("label"))


def connected_objects(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Four-connected objects of the pixels with label > 0: labels run from 1 in each image, in reading order of their first pixels.

    Tiles are labelled by themselves; pieces that touch across the tiles' borders are edges, whose components are found by
    labels and jumps. The number of rounds follows the pieces that an object has, by their logarithm, not its pixels.
    """
    kind = dict(mask.dtypes)
    inside = mask.where("label > 0").select("image", "y", "x").distinct()
    tiled = inside.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})

    def pieces(key: tuple, py: np.ndarray, px: np.ndarray) -> list[np.ndarray]:
        # Only the part of the tile that has pixels, and a rim around it.
        top, left = int(py.min()), int(px.min())
        y, x = py.astype(np.int64) - top, px.astype(np.int64) - left
        height, width = int(y.max()) + 1, int(x.max()) + 1
        none = height * width
        root = np.full((height + 2, width + 2), none)
        root[y + 1, x + 1] = y * width + x
        there = root < none
        while True:
            least = root.copy()
            inner = least[1:-1, 1:-1]
            for near in (root[:-2, 1:-1], root[2:, 1:-1], root[1:-1, :-2], root[1:-1, 2:]):
                np.minimum(inner, near, out=inner)
            least = np.where(there, least, none)
            # The root's own root, for the root first and then for its pixel.
            flat = np.append(least[1:-1, 1:-1].ravel(), none)
            hooked = flat.copy()
            np.minimum.at(hooked, root[there], least[there])
            jumped = hooked[hooked]
            new = np.full_like(root, none)
            new[1:-1, 1:-1] = np.where(there[1:-1, 1:-1], jumped[:-1].reshape(height, width), none)
            if (new == root).all():
                break
            root = new
        first = root[y + 1, x + 1]
        return [py, px, first // width + top, first % width + left]

    shape = f"image {kind['image']}, y {kind['y']}, x {kind['x']}, ry long, rx long"
    local = materialized(by_group(tiled, ["image", "ty", "tx"], ["y", "x"], pieces, shape).select("image", "y", "x", F.struct("image", "ry", "rx").alias("piece")))
    edges = []
    for dy, dx, c in ((1, 0, "y"), (0, 1, "x")):
        last = local.where(F.pmod(F.col(c) + 1, F.lit(tile)) == 0).select("image", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("piece").alias("a"))
        edges.append(last.join(local.where(F.pmod(F.col(c), F.lit(tile)) == 0).withColumnRenamed("piece", "b"), ["image", "y", "x"]).select("a", "b"))
    whole = components(edges[0].unionByName(edges[1]).distinct())
    joined = materialized(local.join(whole, F.col("piece") == F.col("v"), "left").select("image", "y", "x", F.coalesce("label", "piece").alias("root")))
    order = numbered(joined.groupBy("image", "root").agg(F.min(F.struct("y", "x")).alias("first")), [F.col("first")], ("image",), "number")
    order = order.select(F.col("image").alias("i"), F.col("root").alias("r"), F.col("number").cast("int").alias("label"))
    return joined.join(order, (F.col("image") == F.col("i")) & (F.col("root") == F.col("r"))).select("image", "y", "x", "label")
