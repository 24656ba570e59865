"""Intensity features of objects: frames ``image, label, v`` (and ``y, x`` where the box matters)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspark.functions.scalar import guarded_ratio

from .frame import by_group

KEYS = ("image", "label")


def intensity_stats(pixels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Extremes, exact linear quartiles, mean, least mode, population spread, excess kurtosis and skewness.

    Null values are skipped; an object without values has nulls.
    """
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = pixels.groupBy(*keys).agg(
        F.min("v").alias("int_min"), q.alias("q"), F.max("v").alias("int_max"), F.avg("v").alias("int_mean"), F.mode("v", True).alias("int_mode"),
        F.stddev_pop("v").alias("int_sd"), F.kurtosis("v").alias("kurtosis"), F.skewness("v").alias("skewness"),
    )
    return out.select(*keys, "int_min", F.col("q")[0].alias("int_d25"), F.col("q")[1].alias("int_media"), F.col("q")[2].alias("int_d75"), "int_max", "int_mean", "int_mode", "int_sd", "kurtosis", "skewness")


def entropy(pixels: DataFrame, keys: tuple[str, ...] = KEYS, with_box: bool = True) -> DataFrame:
    """Base-2 entropy of the values; with the box, its pixels outside the object count as zeros."""
    counts = pixels.groupBy(*keys, "v").agg(F.count("*").alias("n"), *([F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")] if with_box else []))
    if with_box:
        box = (F.max("y1") - F.min("y0") + 1) * (F.max("x1") - F.min("x0") + 1)
        counts = counts.groupBy(*keys).agg(F.collect_list(F.struct("v", "n")).alias("bins"), box.alias("total"), F.sum("n").alias("area"))
        zero = F.struct(F.lit(0.0).cast("double").alias("v"), (F.col("total") - F.col("area")).alias("n"))
        counts = counts.select(*keys, "total", F.explode(F.concat("bins", F.array(zero))).alias("b")).select(*keys, F.col("b.v").cast("double").alias("v"), F.col("b.n").alias("n"), "total")
        counts = counts.groupBy(*keys, "v").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
        p = F.col("n") / F.col("total")
        return counts.where("n > 0").groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"))
    # -sum p log2 p = log2 N - (sum n log2 n) / N: one pass over the counts.
    total = F.sum("n")
    return counts.groupBy(*keys).agg((F.log2(total.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / total).alias("entropy"))


def condensation(pixels: DataFrame, alpha: float = 1.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Ratios between bright and dim parts of each object.

    ``hc = mean + alpha * population spread``; pixels at or over it are condensed. A ratio is null
    unless its denominator is positive; only values over 0 count towards the whole.
    """
    cuts = pixels.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg((F.avg("v") + alpha * F.stddev_pop("v")).alias("hc"), F.percentile("v", F.array(F.lit(0.8), F.lit(0.2))).alias("q"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    v = F.col("v")
    hot, cold, bright, dim = v >= F.col("hc"), v < F.col("hc"), v >= F.col("q")[0], v <= F.col("q")[1]
    add = lambda c: F.sum(F.when(c, v).otherwise(0.0))
    sums = pixels.join(cuts, same).groupBy(*keys).agg(
        F.first(F.col("q")[0]).alias("p80"), F.first(F.col("q")[1]).alias("p20"), F.count_if(bright).alias("n_bright"), F.count_if(dim).alias("n_dim"), F.count_if(hot).alias("hc_n"), F.count_if(cold).alias("ec_n"),
        F.count_if(v > 0).alias("all_n"), add(hot).alias("hc_v"), add(cold).alias("ec_v"), F.sum("v").alias("all_v"),
    )
    ratio = lambda a, b, name: guarded_ratio(F.col(a), F.col(b)).alias(name)
    return sums.select(*keys, ratio("p80", "p20", "i80_i20"), ratio("n_bright", "n_dim", "nhigh_nlow"), ratio("hc_n", "ec_n", "hc_area_ec_area"), ratio("hc_n", "all_n", "hc_area_nuc_area"), ratio("hc_v", "ec_v", "hc_content_ec_content"), ratio("hc_v", "all_v", "hc_content_dna_content"))


def _shifted_power(moments: dict[tuple[int, int], Column], p: int, q: int, cy: Column, cx: Column) -> Column:
    """Central moment by the binomial shift of raw ones."""
    from math import comb

    total = None
    for i in range(p + 1):
        for j in range(q + 1):
            term = moments[i, j] * float(comb(p, i) * comb(q, j))
            for _ in range(p - i):
                term = term * -cy
            for _ in range(q - j):
                term = term * -cx
            total = term if total is None else total + term
    return total


def raw_moments(pixels: DataFrame, order: int = 3, weighted: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``m_pq``: sums of y^p x^q (times v) over each object, with y and x counted from its box's corner; p, q = 0..order."""
    corner = pixels.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("y").alias("y0"), F.min("x").alias("x0"))
    rows = pixels.join(corner, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    y, x = (F.col("y") - F.col("y0")).cast("double"), (F.col("x") - F.col("x0")).cast("double")

    def term(p: int, q: int) -> Column:
        out = F.col("v").cast("double") if weighted else F.lit(1.0)
        for _ in range(p):
            out = out * y
        for _ in range(q):
            out = out * x
        return F.sum(out).alias(f"m_{p}{q}")

    return rows.groupBy(*keys).agg(*(term(p, q) for p in range(order + 1) for q in range(order + 1)))


def central_moments(raw: DataFrame, order: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``mu_pq`` about the centroid, which comes along as ``cy, cx``; nulls for objects without mass."""
    m = {(p, q): F.col(f"m_{p}{q}") for p in range(order + 1) for q in range(order + 1)}
    with_centre = raw.withColumn("cy", F.try_divide(m[1, 0], m[0, 0])).withColumn("cx", F.try_divide(m[0, 1], m[0, 0]))
    cy, cx = F.col("cy"), F.col("cx")
    return with_centre.select(*keys, "cy", "cx", *(_shifted_power(m, p, q, cy, cx).alias(f"mu_{p}{q}") for p in range(order + 1) for q in range(order + 1)))


def normalized_moments(central: DataFrame, order: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``nu_pq = mu_pq / mu_00 ** ((p + q) / 2 + 1)``; null below order 2."""
    cell = lambda p, q: (F.when(F.col("mu_00") > 0, F.col(f"mu_{p}{q}") / F.pow("mu_00", F.lit((p + q) / 2 + 1))) if p + q >= 2 else F.lit(None).cast("double")).alias(f"nu_{p}{q}")
    return central.select(*keys, *(cell(p, q) for p in range(order + 1) for q in range(order + 1)))


def hu_moments(normalized: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The seven invariants under shift, scale and rotation."""
    n = lambda p, q: F.col(f"nu_{p}{q}")
    a, b = n(3, 0) + n(1, 2), n(2, 1) + n(0, 3)
    c, d = n(3, 0) - 3 * n(1, 2), 3 * n(2, 1) - n(0, 3)
    e, f = n(2, 0) - n(0, 2), n(1, 1)
    hu = [n(2, 0) + n(0, 2), e * e + 4 * f * f, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), e * (a * a - b * b) + 4 * f * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)]
    return normalized.select(*keys, *(h.alias(f"hu_{i}") for i, h in enumerate(hu)))


def shape_from_moments(pixels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Area, box, axes of the ellipse with the same second moments (pixels have a width), eccentricity, orientation."""
    g = pixels.groupBy(*keys).agg(
        F.count("*").alias("area"), ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("bbox_area"), (F.var_pop(F.col("y").cast("double")) + 1 / 12).alias("yy"), (F.var_pop(F.col("x").cast("double")) + 1 / 12).alias("xx"), F.covar_pop(F.col("y").cast("double"), F.col("x").cast("double")).alias("xy")
    )
    half, root = (F.col("yy") + F.col("xx")) / 2, F.sqrt(4 * F.col("xy") * F.col("xy") + (F.col("yy") - F.col("xx")) * (F.col("yy") - F.col("xx"))) / 2
    g = g.withColumn("l1", half + root).withColumn("l2", F.greatest(half - root, F.lit(0.0)))
    angle = F.when(F.col("yy") == F.col("xx"), F.when(F.col("xy") < 0, F.lit(3.141592653589793 / 4)).when(F.col("xy") > 0, F.lit(-3.141592653589793 / 4)).otherwise(F.lit(0.0))).otherwise(0.5 * F.atan2(-2 * F.col("xy"), F.col("xx") - F.col("yy")))
    return g.select(
        *keys, "area", "bbox_area", F.sqrt(4 * F.col("area") / F.pi()).alias("equivalent_diameter"), (4 * F.sqrt("l1")).alias("major_axis_length"), (4 * F.sqrt("l2")).alias("minor_axis_length"),
        F.sqrt(1 - F.col("l2") / F.col("l1")).alias("eccentricity"), angle.alias("orientation"), F.sqrt(F.col("l2") / F.col("l1")).alias("a_r"), (F.col("area") / F.col("bbox_area")).alias("area_bbarea"),
    )


def _texture(y: np.ndarray, x: np.ndarray, v: np.ndarray, steps: list[tuple[int, int]]) -> list[float]:
    """Contrast, dissimilarity, homogeneity, angular second moment, energy and correlation of one object, means over the steps to a pair's other pixel.

    Only the object's pixels are looked at, each as first and as second of its pair; pairs of two outside pixels, which are all (0, 0), follow from their number.
    """
    y, x = y.astype(np.int64) - int(y.min()), x.astype(np.int64) - int(x.min())
    height, width = int(y.max()) + 1, int(x.max()) + 1
    top = np.nanmax(v, initial=-np.inf)
    grey = np.nan_to_num(np.floor(v / top * 255)).astype(np.int64) if top > 0 else np.zeros(len(v), np.int64)
    order = np.lexsort((grey, y * width + x))
    y, x, grey = y[order], x[order], grey[order]
    place = y * width + x
    last = np.append(place[1:] != place[:-1], True)  # of one place's values the greatest
    y, x, grey, place = y[last], x[last], grey[last], place[last]
    total = np.zeros(6)
    for dy, dx in steps:
        t = float(max(0, height - abs(dy)) * max(0, width - abs(dx)))
        if not t:  # a step that leaves the box has no pairs: its properties are zeros, and its correlation one
            total[5] += 1
            continue
        ends = []
        for s in (1, -1):
            oy, ox = y + s * dy, x + s * dx
            inside = (oy >= 0) & (oy < height) & (ox >= 0) & (ox < width)
            other = (oy * width + ox)[inside]
            at = np.minimum(np.searchsorted(place, other), len(place) - 1)
            ends.append((grey[inside], np.where(place[at] == other, grey[at], 0), place[at] == other))
        (own, beside, _), (late, _, known) = ends
        i = np.concatenate([own, np.zeros(int((~known).sum()), np.int64)]).astype(float)
        j = np.concatenate([beside, late[~known]]).astype(float)
        n = np.unique(i + 1j * j, return_counts=True)[1].astype(float)
        zero, rest, far = float(((i == 0) & (j == 0)).sum()), t - len(i), i - j
        asm = ((n * n).sum() + 2 * zero * rest + rest * rest) / (t * t)
        si, sj = i.sum() / t, j.sum() / t
        vi, vj, c = (i * i).sum() / t - si * si, (j * j).sum() / t - sj * sj, (i * j).sum() / t - si * sj
        correlation = 1.0 if vi < 1e-15 or vj < 1e-15 else c / np.sqrt(max(vi * vj, 1e-300))
        total += ((far * far).sum() / t, np.abs(far).sum() / t, ((1 / (1 + far * far)).sum() + rest) / t, asm, np.sqrt(asm), correlation)
    return (total / len(steps)).tolist()


def glcm(pixels: DataFrame, distances: tuple[int, ...] = (1, 5, 20), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Grey-level co-occurrence properties per object and distance, averaged over 0, 45, 90 and 135 degrees.

    Values are scaled by the object's greatest to 0..255; box pixels outside the object are zeros. An object's pixels
    are taken in one call; no pixel is copied for each step.
    """
    from math import cos, pi, sin

    steps = [[(round(d * sin(a * pi / 4)), round(d * cos(a * pi / 4))) for a in range(4)] for d in distances]

    def one(key: tuple, y: np.ndarray, x: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        found = np.array([_texture(y, x, v, s) for s in steps])
        return [np.array(distances), *found.T]

    kind = dict(pixels.dtypes)
    schema = ", ".join([*(f"{k} {kind[k]}" for k in keys), "d int", *(f"{c} double" for c in ("contrast", "dissimilarity", "homogeneity", "asm", "energy", "correlation"))])
    return by_group(pixels.withColumn("v", F.col("v").cast("double")), list(keys), ["y", "x", "v"], one, schema)
