"""Cell typing by mixture thresholds, statuses and zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frame, spatial


def mixture_means(n: np.ndarray, v: np.ndarray, steps: int = 500, tol: float = 1e-6) -> tuple[float, float]:
    """Means of a two-component normal mixture of the values v with weights n, by expectation maximisation from the halves about the median."""
    v, n = np.asarray(v, float), np.asarray(n, float)
    half = np.cumsum(n) <= n.sum() / 2 if len(v) > 1 else np.ones(len(v), bool)
    if not half.any():
        half[0] = True
    if half.all():
        half[-1] = len(v) == 1
    r = np.where(half, 0.9, 0.1)
    last = -np.inf
    for _ in range(steps):
        w = np.stack([n * r, n * (1 - r)])
        total = w.sum(axis=1) + 1e-10
        mean = (w @ v) / total
        var = np.maximum((w * (v - mean[:, None]) ** 2).sum(axis=1) / total, 1e-6)
        logp = np.log(total / n.sum())[:, None] - 0.5 * (np.log(2 * np.pi * var)[:, None] + (v - mean[:, None]) ** 2 / var[:, None])
        top = np.logaddexp(logp[0], logp[1])
        r = np.exp(logp[0] - top)
        now = float((n * top).sum() / n.sum())
        if abs(now - last) < tol:
            break
        last = now
    return float(mean[0]), float(mean[1])


def mixture_thresholds(levels: DataFrame, value: str = "int_mean", group: str | None = "image", bins: int = 4096) -> DataFrame:
    """``[group,] threshold``: the middle of the two component means; groups of fewer than two values have none.

    Fits are on exact values with their counts. A group of at most ``bins`` distinct values is fitted in one task;
    for all larger ones together each round of the fit is one grouped aggregation over their counts.
    """
    keys = [group] if group else []
    rows = levels.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v"))
    if not group:
        rows, keys = rows.withColumn("_all", F.lit(1)), ["_all"]
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    counts = frame.materialized(counts)
    sizes = counts.groupBy(F.col(keys[0]).alias("_k")).agg(F.count("*").alias("d"), F.sum("n").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("k > 1")
    kind = dict(rows.dtypes)[keys[0]]

    def fit(key, hist):
        hist = hist.sort_values("v")
        return pd.DataFrame({keys[0]: [key[0]], "threshold": [sum(mixture_means(hist["n"].to_numpy(), hist["v"].to_numpy())) / 2]})

    small = counts.join(sizes.where(F.col("d") <= bins).select("_k"), F.col(keys[0]).eqNullSafe(F.col("_k"))).drop("_k")
    out = small.groupBy(*keys).applyInPandas(fit, f"{keys[0]} {kind}, threshold double")
    large = {r["_k"]: (r["k"], r["lo"], r["hi"]) for r in sizes.where(F.col("d") > bins).collect()}
    if large:
        means = _means_by_rounds(counts.withColumnRenamed(keys[0], "g"), large, kind, bins)
        out = out.unionByName(levels.sparkSession.createDataFrame([(g, sum(m) / 2) for g, m in means.items()], f"{keys[0]} {kind}, threshold double"))
    return out if group else out.drop("_all")


def _means_by_rounds(counts: DataFrame, groups: dict, kind: str, bins: int, steps: int = 500, tol: float = 1e-6) -> dict:
    """What :func:`mixture_means` gives for each group of ``g, v, n``; groups: key -> number of rows, least and greatest value."""
    spark = counts.sparkSession

    def with_state(state: dict, schema: str) -> DataFrame:
        rows = spark.createDataFrame([(g, *map(float, x)) for g, x in state.items()], f"_k {kind}, {schema}")
        return counts.join(F.broadcast(rows), F.col("g").eqNullSafe(F.col("_k")))  # one row for each group left

    # The value at which the counts pass the half, by narrowing the range that holds it.
    middle, ranges = {}, {g: (lo, hi, k / 2) for g, (k, lo, hi) in groups.items()}
    while ranges:
        held = with_state(ranges, "lo double, hi double, rest double").where("v between lo and hi")
        place = F.when(F.col("v") == F.col("hi"), bins).otherwise(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))
        found: dict = {}
        for r in held.groupBy("g", place.cast("long").alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").toLocalIterator():
            found.setdefault(r["g"], []).append((r["n"], r["lo"], r["hi"]))
        narrower = {}
        for g, parts in found.items():
            rest = ranges[g][2]
            for n, lo, hi in parts:
                if n > rest:
                    break
                rest -= n
            if lo == hi:
                middle[g] = lo
            else:
                narrower[g] = (lo, hi, rest)
        ranges = narrower

    def moved(r, side: str, c: float) -> tuple[float, float, float]:
        """Weight, mean and variance from sums about c."""
        w, s, q = r[f"w{side}"], r[f"s{side}"], r[f"q{side}"]
        total = w + 1e-10
        mean = (s + c * w) / total
        return total, mean, max((q - 2 * (mean - c) * s + (mean - c) ** 2 * w) / total, 1e-6)

    def sums(df: DataFrame, share: Column, top: Column) -> list:
        df = df.withColumns({"r": share, "top": top})
        part = lambda side, w: [F.sum(w).alias(f"w{side}"), F.sum(w * (F.col("v") - F.col(f"c{side}"))).alias(f"s{side}"), F.sum(w * (F.col("v") - F.col(f"c{side}")) ** 2).alias(f"q{side}")]
        return df.groupBy("g").agg(*part(0, F.col("n") * F.col("r")), *part(1, F.col("n") * (1 - F.col("r"))), F.sum(F.col("n") * F.col("top")).alias("top")).collect()

    # If no value lies below the middle one, the least value alone is the lower half.
    start = with_state({g: (m, m, m, groups[g][1]) for g, m in middle.items()}, "m double, c0 double, c1 double, lo double")
    lower = (F.col("v") < F.col("m")) | ((F.col("m") == F.col("lo")) & (F.col("v") == F.col("lo")))
    now = {r["g"]: (moved(r, "0", middle[r["g"]]), moved(r, "1", middle[r["g"]])) for r in sums(start, F.when(lower, 0.9).otherwise(0.1), F.lit(0.0))}
    means, last = {}, dict.fromkeys(now, -np.inf)
    for _ in range(steps - 1):
        state = {g: (a[1], b[1], np.log(a[0] / groups[g][0]) - 0.5 * np.log(2 * np.pi * a[2]), np.log(b[0] / groups[g][0]) - 0.5 * np.log(2 * np.pi * b[2]), a[2], b[2]) for g, (a, b) in now.items()}
        df = with_state(state, "c0 double, c1 double, l0 double, l1 double, v0 double, v1 double")
        p0, p1 = (F.col(f"l{i}") - 0.5 * (F.col("v") - F.col(f"c{i}")) ** 2 / F.col(f"v{i}") for i in "01")
        df = df.withColumns({"p0": p0, "p1": p1})
        top = F.greatest("p0", "p1") + F.log1p(F.exp(-F.abs(F.col("p0") - F.col("p1"))))
        new = {}
        for r in sums(df, F.exp(F.col("p0") - top), top):
            g, level = r["g"], r["top"] / groups[r["g"]][0]
            if abs(level - last[g]) < tol:
                means[g] = (now[g][0][1], now[g][1][1])
            else:
                last[g], new[g] = level, (moved(r, "0", now[g][0][1]), moved(r, "1", now[g][1][1]))
        now = new
        if not now:
            break
    return means | {g: (a[1], b[1]) for g, (a, b) in now.items()}


def positive_cells(levels: DataFrame, value: str = "int_mean", group: str | None = "image") -> DataFrame:
    """Rows over their group's threshold."""
    cuts = mixture_thresholds(levels, value, group)
    if not group:
        return levels.join(F.broadcast(cuts)).where(F.col(value) > F.col("threshold")).drop("threshold")  # one row
    cuts = cuts.withColumnRenamed(group, "_g")
    return levels.join(cuts, F.col(group).eqNullSafe(F.col("_g"))).where(F.col(value) > F.col("threshold")).drop("_g", "threshold")


def positive_ids_of_images(levels: DataFrame, images: list[str], value: str = "int_mean", key: str = "nuc_id") -> DataFrame:
    """The ids over their image's threshold, for the images named only; an image without rows, or of fewer than two values, has none."""
    return positive_cells(levels.where(F.col("image").isin(images)), value).select(key)


def assign_cell_types(features: DataFrame, aicda: DataFrame, cd3: DataFrame, mask: DataFrame | None = None, mask_threshold: float = 0.0, key: str = "nuc_id") -> DataFrame:
    """Statuses from the positive ids, and ``cell_type``: CD3 decides for T cells whatever AICDA says."""
    out = frame.mark(frame.mark(features, aicda, "aicda_status", key=key), cd3, "cd3_status", key=key)
    if mask is not None:
        out = frame.mark(out, mask.where(F.col("int_mean") > mask_threshold), "gc_status", key=key)
    kind = F.when(F.col("cd3_status") == "positive", spatial.T_CELL).when(F.col("aicda_status") == "positive", spatial.DZ).otherwise(spatial.LZ)
    return out.withColumn("cell_type", kind)


def germinal_only(features: DataFrame) -> DataFrame:
    return features.where("gc_status = 'positive'") if "gc_status" in features.columns else features


def tcell_influence(cells: DataFrame, contact_um: float = 15.0, signal_um: float = 30.0, pixel_size: float = 0.3225) -> DataFrame:
    """Zones with radii given in micrometres; distances are in pixels."""
    return spatial.influence_zones(cells, contact_um / pixel_size, signal_um / pixel_size)


def fractions_by_image(cells: DataFrame) -> DataFrame:
    """Counts of B cells and of interacting ones per image, and four ratios, 0 where nothing divides."""
    dz, lz = F.col("cell_type") == spatial.DZ, F.col("cell_type") == spatial.LZ
    near = F.col("influence") == "T-cell interactors"
    g = cells.where(dz | lz).groupBy("image").agg(F.count("*").alias("n_bcells"), F.count_if(dz).alias("n_dz"), F.count_if(lz).alias("n_lz"), F.count_if(near).alias("n_interactors"), F.count_if(near & dz).alias("n_dz_interactors"), F.count_if(near & lz).alias("n_lz_interactors"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return g.withColumns({"interactor_fraction": ratio("n_interactors", "n_bcells"), "dz_interactor_fraction": ratio("n_dz_interactors", "n_dz"), "lz_interactor_fraction": ratio("n_lz_interactors", "n_lz"), "dz_share_of_interactors": ratio("n_dz_interactors", "n_interactors")})
