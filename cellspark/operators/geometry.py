"""Geometry of single objects that needs ordered points: one call per object, many objects in an Arrow batch.

An object's pixels fit a task (they are its box); the objects, not the images, are the groups.
Definitions: edge pixels lack one of four neighbours in the object (pixels on the box's rim count
as edge only if a neighbour inside the box is missing, unless ``padded``); perimeters weigh edge steps
as 1, diagonal ones as sqrt 2 and corners as their mean; radii are distances of edge pixels to the centroid.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .frame import by_group

RADII = ["min_radius", "max_radius", "med_radius", "avg_radius", "mode_radius", "d25_radius", "d75_radius", "std_radius", "feret_max"]
CALLIPER = ["min_calliper", "max_calliper", "smallest_largest_calliper"]
HULL = ["perimeter", "convex_area", "concavity", "solidity", "shape_factor"]
CURVATURE = [
    "avg_curvature", "std_curvature", "npolarity_changes",
    *(f"{s}_{side}_curv" for side in ("posi", "negi") for s in ("max", "avg", "med", "std", "sum", "len")),
    *(f"{s}_{side}" for side in ("pos", "neg") for s in ("num_prominant", "prominance_prominant", "width_prominant", "value_prominant")),
    "frac_peri_w_posi_curvature", "frac_peri_w_neg_curvature", "frac_peri_w_polarity_changes",
]
COLUMNS = [*RADII, *CALLIPER, *HULL, *CURVATURE]
NAN = float("nan")


def mask_of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
    out[y - y.min(), x - x.min()] = True
    return out


def edge_of(mask: np.ndarray, padded: bool = False) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=not padded)
    return mask & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])


def radii(mask: np.ndarray) -> list[float]:
    points = np.argwhere(edge_of(mask)).astype(float)
    if len(points) < 3:
        return [NAN] * len(RADII)
    r = np.hypot(*(points - np.argwhere(mask).mean(axis=0)).T)
    values, times = np.unique(r, return_counts=True)
    hull = convex_hull(points)
    feret = max(float(np.hypot(*(hull - h).T).max()) for h in hull)
    q25, q50, q75 = np.percentile(r, [25, 50, 75])
    return [values[0], values[-1], q50, r.mean(), values[times.argmax()], q25, q75, r.std(), feret]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order; collinear points give their two ends."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)
    halves = []
    for run in (pts, pts[::-1]):
        half: list[tuple] = []
        for p in run:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]):
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


def polygon_area(corners: np.ndarray) -> float:
    y, x = corners[:, 0], corners[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2) if len(corners) > 2 else 0.0


def hull_pixels(mask: np.ndarray) -> int:
    """Pixels whose centres lie in the convex hull of the object's pixels taken as diamonds around their centres."""
    rows = np.flatnonzero(mask.any(axis=1))
    ends = mask[rows].argmax(axis=1), mask.shape[1] - 1 - mask[rows, ::-1].argmax(axis=1)  # what lies between a row's ends is no corner
    at = np.concatenate([np.stack([rows, x], axis=1) for x in ends]).astype(float)
    corners = convex_hull(np.concatenate([at + d for d in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]))
    yy, xx = np.ogrid[: mask.shape[0], : mask.shape[1]]
    inside = np.ones(mask.shape, bool)
    for (y0, x0), (y1, x1) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        inside &= (y1 - y0) * (xx - x0) - (x1 - x0) * (yy - y0) <= 1e-9
    return int(inside.sum()) if inside.sum() >= mask.sum() else int(mask.sum())


def perimeter(mask: np.ndarray) -> float:
    """Length of the outline through edge pixel centres, each pixel weighed by the steps that it has to its neighbours."""
    edge = np.pad(edge_of(mask, padded=True), 1).astype(int)
    straight = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:]
    diagonal = edge[:-2, :-2] + edge[:-2, 2:] + edge[2:, :-2] + edge[2:, 2:]
    inner = edge[1:-1, 1:-1] == 1
    code = straight * 2 + diagonal * 10 + 1
    weights = {c: 1.0 for c in (5, 7, 15, 17, 25, 27)} | {c: 2**0.5 for c in (21, 33)} | {c: (1 + 2**0.5) / 2 for c in (13, 23)}
    times = np.bincount(code[inner], minlength=max(weights) + 1).tolist()
    return float(sum(w * times[c] for c, w in weights.items()))


def callipers(mask: np.ndarray, resolution: int = 10) -> list[float]:
    """Least and greatest count of pixels across the object over turned axes, and their ratio: pixels are binned along each axis."""
    at = np.argwhere(mask).astype(float)
    at -= at.mean(axis=0)
    widths: list[float] = []
    turns = np.deg2rad(np.arange(1, 361, resolution))[:, None]
    some = max(1, (1 << 20) // len(at))  # turns at once
    for i in range(0, len(turns), some):
        a = turns[i : i + some]
        bins = np.floor(at[:, 1] * np.cos(a) - at[:, 0] * np.sin(a) + 0.5).astype(int)
        bins -= bins.min(axis=1, keepdims=True)
        span = int(bins.max()) + 1
        counts = np.bincount((bins + span * np.arange(len(a))[:, None]).ravel(), minlength=span * len(a))
        widths += counts.reshape(len(a), span).max(axis=1).astype(float).tolist()
    return [min(widths), max(widths), min(widths) / max(widths)]


def circumradius(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radius and centre of the circle through three points, row by row; collinear points have radius 0."""
    d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
    flat = d == 0
    d = np.where(flat, 1, d)
    sa, sb, sc = ((p**2).sum(axis=1) for p in (a, b, c))
    uy = (sa * (b[:, 1] - c[:, 1]) + sb * (c[:, 1] - a[:, 1]) + sc * (a[:, 1] - b[:, 1])) / d
    ux = (sa * (c[:, 0] - b[:, 0]) + sb * (a[:, 0] - c[:, 0]) + sc * (b[:, 0] - a[:, 0])) / d
    centre = np.stack([uy, ux], axis=1)
    return np.where(flat, 0.0, np.hypot(*(a - centre).T)), centre


def local_curvature(mask: np.ndarray, step: int = 2) -> np.ndarray:
    """Signed 1/r along the outline by falling angle: r is the local radius plus one, negative if its centre is not in the object, 0 on lines."""
    padded = np.pad(mask, 5)
    points = np.argwhere(edge_of(padded)).astype(float)
    away = points - points.mean(axis=0)
    points = points[np.argsort(-np.arctan2(away[:, 0], away[:, 1]), kind="stable")]
    r, centre = circumradius(np.roll(points, step, axis=0), points, np.roll(points, -step, axis=0))
    cell = np.floor(centre).astype(int)
    inside = (cell >= 0).all(axis=1) & (cell[:, 0] < padded.shape[0]) & (cell[:, 1] < padded.shape[1])
    hit = np.zeros(len(r), bool)
    hit[inside] = padded[cell[inside, 0], cell[inside, 1]]
    signed = np.where(r == 0, 0.0, np.where(hit, r + 1, -(r + 1)))
    return np.divide(1.0, signed, out=np.zeros_like(signed), where=signed != 0)


def peaks(v: np.ndarray, prominence: float = 0.1, width: float = 5, distance: int = 10) -> list[tuple[float, float, float]]:
    """(prominence, width at half prominence, height) of local maxima that are far enough apart, prominent and wide enough."""
    v, top, i = np.asarray(v).tolist(), [], 1
    while i < len(v) - 1:
        if v[i] > v[i - 1]:
            j = i
            while j + 1 < len(v) and v[j + 1] == v[i]:
                j += 1
            if j + 1 < len(v) and v[j + 1] < v[i]:
                top.append((i + j) // 2)
            i = j
        i += 1
    keep: list[int] = []
    for p in sorted(top, key=lambda p: -v[p]):  # the higher of two near peaks stays
        if all(abs(p - k) >= distance for k in keep):
            keep.append(p)
    out = []
    for p in sorted(keep):
        left = next((k for k in range(p - 1, -1, -1) if v[k] > v[p]), -1)
        right = next((k for k in range(p + 1, len(v)) if v[k] > v[p]), len(v))
        rise = v[p] - max(min(v[left + 1 : p + 1]), min(v[p:right]))
        if rise < prominence:
            continue
        level = v[p] - rise / 2
        lo, hi = p, p
        while lo > left + 1 and v[lo - 1] > level:
            lo -= 1
        while hi < right - 1 and v[hi + 1] > level:
            hi += 1
        a = lo - (v[lo] - level) / (v[lo] - v[lo - 1]) if lo > 0 and v[lo - 1] < v[lo] else lo
        b = hi + (v[hi] - level) / (v[hi] - v[hi + 1]) if hi + 1 < len(v) and v[hi + 1] < v[hi] else hi
        if b - a >= width:
            out.append((float(rise), float(b - a), float(v[p])))
    return out


def curvature(mask: np.ndarray, around: float) -> list[float]:
    k = local_curvature(mask)
    changes = float((np.diff(np.sign(k)) != 0).sum())
    out = [k.mean(), k.std(), changes]
    lengths = []
    for side in (k[k > 0], np.abs(k[k < 0])):
        lengths.append(float(len(side)) if len(side) else NAN)
        out += [side.max(), side.mean(), np.median(side), side.std(), side.sum(), float(len(side))] if len(side) else [NAN] * 6
    for signal in (k, -k):
        found = peaks(signal)
        out += [float(len(found)), *np.mean(found, axis=0)] if found else [0.0, NAN, NAN, NAN]
    return [*out, *(n / around if around else NAN for n in (*lengths, changes))]


def object_geometry(y: np.ndarray, x: np.ndarray) -> list[float]:
    """The values of COLUMNS for one object's pixels."""
    mask = mask_of(y, x)
    area, around, hull = int(mask.sum()), perimeter(mask), hull_pixels(mask)
    return [*radii(mask), *callipers(mask), around, float(hull), (hull - area) / hull, area / hull, around**2 / (4 * np.pi * area), *curvature(mask, around)]


def geometry(pixels: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """``image, label`` and COLUMNS; missing values are null. Radii alone are found without the rest, if ``columns`` is RADII."""
    of = (lambda y, x: radii(mask_of(y, x))) if columns == RADII else object_geometry
    kinds = dict(pixels.dtypes)
    schema = f"image {kinds['image']}, label {kinds['label']}, " + ", ".join(f"{c} double" for c in columns)
    return by_group(pixels, ["image", "label"], ["y", "x"], lambda key, y, x: [float(v) for v in of(y, x)], schema)
