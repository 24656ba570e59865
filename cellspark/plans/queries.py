"""Named queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.functions import scalar
from cellspark.functions.special import t_p_value
from cellspark.operators import celltype, density, frame, geometry, intensity, ml, pixels, spatial, stats
from cellspark.plans import analysis
from cellspark.plans.fixtures import Views, with_views
from cellspark.streaming.incremental import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Register the decorated function of the views under its name."""

    def wrap(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views, recursive=recursive) if views else sql
        return f

    return wrap


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, /, **own: int) -> DataFrame:
    return df.select(*(r(F.col(c), own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def distance_r(c: Column | str, digits: int = 6) -> Column:
    """A distance, which is never negative, rounded by multiplying and dividing as the SQL does: a pair costs no decimal number."""
    d, scale = F.col(c) if isinstance(c, str) else c, F.lit(10.0**digits)
    # NaN is greater than all numbers.
    return F.when(d < 1e9, F.floor(d * scale + 0.5).cast("double") / scale).otherwise(r(d, digits))


#: Added before rounding where exact ties occur, which two engines' sums may miss on either side.
NUDGE = 1.3e-8


def nudged(df: DataFrame) -> DataFrame:
    return df.select(*((F.col(c) + F.lit(NUDGE)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_round(names: str, digits: int = 6, **own: int) -> str:
    return ", ".join(f"round({n}, {own.get(n, digits)}) + 0.0e0 AS {n}" for n in names.split())


# Pixels and object features ------------------------------------------------------------------------


@query(
    f"""WITH s AS (SELECT image, label, avg(v) + 1.0e0 * stddev_pop(v) AS hc, quantile_cont(v, 0.8) AS p80, quantile_cont(v, 0.2) AS p20 FROM pix GROUP BY ALL),
c AS (SELECT image, label, any_value(p80) AS p80, any_value(p20) AS p20, count(*) FILTER (WHERE v >= p80) AS hi, count(*) FILTER (WHERE v <= p20) AS lo, count(*) FILTER (WHERE v >= hc) AS hn, count(*) FILTER (WHERE v < hc) AS en,
  count(*) FILTER (WHERE v > 0) AS an, coalesce(sum(v) FILTER (WHERE v >= hc), 0) AS hv, coalesce(sum(v) FILTER (WHERE v < hc), 0) AS ev, sum(v) AS av FROM pix JOIN s USING (image, label) GROUP BY ALL),
q AS (SELECT image, label, CASE WHEN p20 > 0 THEN p80 / p20 END AS i80_i20, CASE WHEN lo > 0 THEN hi / lo END AS nhigh_nlow, CASE WHEN en > 0 THEN hn / en END AS hc_area_ec_area, CASE WHEN an > 0 THEN hn / an END AS hc_area_nuc_area,
  CASE WHEN ev > 0 THEN hv / ev END AS hc_content_ec_content, CASE WHEN av > 0 THEN hv / av END AS hc_content_dna_content FROM c)
SELECT image, label, {sql_round("i80_i20 nhigh_nlow hc_area_ec_area hc_area_nuc_area hc_content_ec_content hc_content_dna_content")} FROM q""",
    "pix",
)
def hc_ec_ratio(d: Views) -> DataFrame:
    return rounded(intensity.condensation(d.pix))


@query(
    """WITH m AS (SELECT image, label, v, row_number() OVER (PARTITION BY image, label ORDER BY count(*) DESC, v) AS k FROM pix GROUP BY image, label, v),
s AS (SELECT image, label, avg(v) AS mu, stddev_pop(v) AS sd FROM pix GROUP BY ALL),
g AS (SELECT p.image, p.label, min(v) AS int_min, quantile_cont(v, 0.25) AS int_d25, median(v) AS int_media, quantile_cont(v, 0.75) AS int_d75, max(v) AS int_max, any_value(mu) AS int_mean, any_value(sd) AS int_sd,
  avg((v - mu) * (v - mu) * (v - mu) * (v - mu)) / (any_value(sd) * any_value(sd) * any_value(sd) * any_value(sd)) - 3 AS kurtosis, avg((v - mu) * (v - mu) * (v - mu)) / (any_value(sd) * any_value(sd) * any_value(sd)) AS skewness
  FROM pix p JOIN s USING (image, label) GROUP BY ALL)
SELECT image, label, int_min, round(int_d25, 6) AS int_d25, int_media, round(int_d75, 6) AS int_d75, int_max, round(int_mean, 6) AS int_mean, m.v AS int_mode, round(int_sd, 6) AS int_sd, round(kurtosis, 6) + 0.0e0 AS kurtosis, round(skewness, 6) + 0.0e0 AS skewness
FROM g JOIN m USING (image, label) WHERE k = 1""",
    "pix",
)
def intensity_stats(d: Views) -> DataFrame:
    return rounded(intensity.intensity_stats(d.pix))


@query(
    """WITH c AS (SELECT image, label, v, count(*) AS n FROM pix GROUP BY ALL), t AS (SELECT image, label, sum(n) AS total FROM c GROUP BY ALL)
SELECT image, label, round(-sum(n / total * log2(n / total)), 6) + 0.0e0 AS entropy FROM c JOIN t USING (image, label) GROUP BY ALL""",
    "pix",
)
def intensity_entropy(d: Views) -> DataFrame:
    return rounded(intensity.entropy(d.pix, with_box=False))


@query(
    """WITH o AS (SELECT * FROM obj WHERE label > 0), bx AS (SELECT image, label, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS total, count(*) AS area FROM o GROUP BY ALL),
c AS (SELECT image, label, v, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT image, label, 0.0e0, total - area FROM bx),
s AS (SELECT image, label, v, sum(n) AS n FROM c GROUP BY ALL)
SELECT image, label, round(-sum(n / total * log2(n / total)), 6) + 0.0e0 AS entropy FROM s JOIN bx USING (image, label) WHERE n > 0 GROUP BY ALL""",
    "obj",
)
def intensity_entropy_box(d: Views) -> DataFrame:
    return rounded(intensity.entropy(d.obj.where("label > 0")))


@query(
    """WITH q AS (SELECT image, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.998) AS hi FROM grid GROUP BY ALL)
SELECT image, CAST(trunc(least(greatest((v - lo) / (hi - lo) * 255, 0), 255)) AS INTEGER) AS scaled, count(*) AS n FROM grid JOIN q USING (image) WHERE hi > lo GROUP BY ALL
UNION ALL SELECT image, NULL, count(*) FROM grid JOIN q USING (image) WHERE hi = lo GROUP BY ALL""",
    "grid",
)
def quantile_normalize(d: Views) -> DataFrame:
    return pixels.quantile_normalize(d.grid).groupBy("image", "scaled").agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT image, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.998) AS hi, quantile_cont(v, 0.01) FILTER (WHERE v > 20) AS mlo, quantile_cont(v, 0.998) FILTER (WHERE v > 20) AS mhi FROM grid GROUP BY ALL),
u AS (SELECT image, coalesce(mlo, lo) AS lo, coalesce(mhi, hi) AS hi FROM q)
SELECT image, CAST(trunc(least(greatest(CASE WHEN hi <> lo THEN (v - lo) / (hi - lo) * 255 END, 0), 255)) * CASE WHEN hi <> lo THEN 1 END AS INTEGER) AS scaled, count(*) AS n FROM grid JOIN u USING (image) GROUP BY ALL""",
    "grid",
)
def quantile_normalize_masked(d: Views) -> DataFrame:
    out = pixels.quantile_normalize(d.grid.withColumn("m", F.col("v") > 20), mask="m")
    return out.groupBy("image", "scaled").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT image, min(v) AS lo, max(v) AS hi FROM grid GROUP BY ALL)
SELECT image, y, x, round(CASE WHEN hi <> lo THEN (v - lo) / (hi - lo) * 255 END, 6) + 0.0e0 AS scaled FROM grid JOIN e USING (image)""",
    "grid",
)
def minmax_normalize(d: Views) -> DataFrame:
    return pixels.minmax_normalize(d.grid).select("image", "y", "x", r("scaled").alias("scaled"))


@query("SELECT image, y, x, v FROM (SELECT l_suppkey AS image, CAST(l_partkey % 16 AS INTEGER) AS y, CAST(l_orderkey % 16 AS INTEGER) AS x, l_quantity AS v, l_linenumber - 1 AS c, max(l_linenumber) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE c = n - 2")
def extract_channel(d: Views) -> DataFrame:
    rows = d.table("lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_orderkey") % 16).cast("int").alias("x"), F.col("l_quantity").alias("v"), (F.col("l_linenumber") - 1).alias("c"))
    return pixels.extract_channel(rows, 2)


@query("SELECT l_suppkey AS image, max(l_linenumber) >= 7 AS multichannel FROM lineitem GROUP BY ALL")
def multichannel(d: Views) -> DataFrame:
    return pixels.is_multichannel(d.table("lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_linenumber") - 1).alias("c")), 7)


@query(
    """SELECT image, label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS bbox_area FROM obj WHERE label > 0 GROUP BY ALL""",
    "obj",
)
def region_bbox_centroid(d: Views) -> DataFrame:
    return rounded(pixels.regions(d.obj))


@query("SELECT image, count(DISTINCT label) AS n_objects FROM obj WHERE label > 0 GROUP BY ALL", "obj")
def objects_per_image(d: Views) -> DataFrame:
    return pixels.object_count(d.obj)


@query("SELECT image, label, round(avg(v), 6) AS int_mean, max(v) AS int_max, min(v) AS int_min FROM obj WHERE label > 0 GROUP BY ALL", "obj")
def mask_levels(d: Views) -> DataFrame:
    return rounded(pixels.mask_levels(d.grid, d.obj.drop("v")))


_MOMENTS = ", ".join(f"sum(v{''.join(' * y' * p)}{''.join(' * x' * q)}) AS m_{p}{q}" for p in range(4) for q in range(4))
_RAW = f"o AS (SELECT image, label, v, CAST(y - min(y) OVER (PARTITION BY image, label) AS DOUBLE) AS y, CAST(x - min(x) OVER (PARTITION BY image, label) AS DOUBLE) AS x FROM obj WHERE label > 0), raw AS (SELECT image, label, {_MOMENTS} FROM o GROUP BY ALL)"


@query(f"WITH {_RAW} SELECT * FROM raw", "obj")
def raw_moments(d: Views) -> DataFrame:
    return intensity.raw_moments(d.obj.where("label > 0"))


def _power(c: str, n: int) -> str:
    return "".join(f" * (o.{c} - c.c{c})" for _ in range(n))


_CENTRE = _RAW + ", c AS (SELECT image, label, m_00, m_10 / m_00 AS cy, m_01 / m_00 AS cx FROM raw)"
_MU = ", ".join(f"sum(o.v{_power('y', p)}{_power('x', q)}) AS mu_{p}{q}" for p in range(4) for q in range(4))


@query(f"WITH {_CENTRE} SELECT o.image, o.label, round(any_value(cy) + 1.3e-8, 6) AS cy, round(any_value(cx) + 1.3e-8, 6) AS cx, " + ", ".join(f"round(sum(o.v{_power('y', p)}{_power('x', q)}) + 1.3e-8, 3) + 0.0e0 AS mu_{p}{q}" for p in range(4) for q in range(4)) + " FROM o JOIN c USING (image, label) GROUP BY ALL", "obj")
def central_moments(d: Views) -> DataFrame:
    return rounded(nudged(intensity.central_moments(intensity.raw_moments(d.obj.where("label > 0")))), 3, cy=6, cx=6)


_NU = f"WITH {_CENTRE}, mu AS (SELECT o.image, o.label, {_MU} FROM o JOIN c USING (image, label) GROUP BY ALL), nu AS (SELECT image, label, " + ", ".join(f"mu_{p}{q} / pow(mu_00, {(p + q) / 2 + 1}) AS nu_{p}{q}" for p in range(4) for q in range(4) if p + q >= 2) + " FROM mu)"


@query(_NU + " SELECT image, label, " + ", ".join(f"round(nu_{p}{q}, 9) + 0.0e0 AS nu_{p}{q}" if p + q >= 2 else f"CAST(NULL AS DOUBLE) AS nu_{p}{q}" for p in range(4) for q in range(4)) + " FROM nu", "obj")
def normalized_moments(d: Views) -> DataFrame:
    return rounded(intensity.normalized_moments(intensity.central_moments(intensity.raw_moments(d.obj.where("label > 0")))), 9)


@query(
    _NU
    + """, h AS (SELECT image, label, nu_30 + nu_12 AS a, nu_21 + nu_03 AS b, nu_30 - 3 * nu_12 AS c, 3 * nu_21 - nu_03 AS d, nu_20 - nu_02 AS e, nu_11 AS f, nu_20 + nu_02 AS g FROM nu)
SELECT image, label, round(g, 9) + 0.0e0 AS hu_0, round(e * e + 4 * f * f, 9) + 0.0e0 AS hu_1, round(c * c + d * d, 12) + 0.0e0 AS hu_2, round(a * a + b * b, 12) + 0.0e0 AS hu_3, round(c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), 15) + 0.0e0 AS hu_4,
round(e * (a * a - b * b) + 4 * f * a * b, 15) + 0.0e0 AS hu_5, round(d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b), 15) + 0.0e0 AS hu_6 FROM h""",
    "obj",
)
def hu_moments(d: Views) -> DataFrame:
    hu = intensity.hu_moments(intensity.normalized_moments(intensity.central_moments(intensity.raw_moments(d.obj.where("label > 0")))))
    return rounded(hu, 15, hu_0=9, hu_1=9, hu_2=12, hu_3=12)


@query(
    f"""WITH g AS (SELECT image, label, count(*) AS area, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS bbox_area, var_pop(y) + 1.0e0 / 12 AS yy, var_pop(x) + 1.0e0 / 12 AS xx, covar_pop(y, x) AS xy FROM obj WHERE label > 0 GROUP BY ALL),
l AS (SELECT *, (yy + xx) / 2 + sqrt(4 * xy * xy + (yy - xx) * (yy - xx)) / 2 AS l1, greatest((yy + xx) / 2 - sqrt(4 * xy * xy + (yy - xx) * (yy - xx)) / 2, 0) AS l2 FROM g),
q AS (SELECT image, label, area, bbox_area, sqrt(4 * area / pi()) AS equivalent_diameter, 4 * sqrt(l1) AS major_axis_length, 4 * sqrt(l2) AS minor_axis_length, sqrt(1 - l2 / l1) AS eccentricity, sqrt(l2 / l1) AS a_r, area / bbox_area AS area_bbarea FROM l)
SELECT image, label, area, bbox_area, {sql_round("equivalent_diameter major_axis_length minor_axis_length eccentricity a_r area_bbarea")} FROM q""",
    "obj",
)
def shape_axes(d: Views) -> DataFrame:
    return rounded(intensity.shape_from_moments(d.obj.where("label > 0")).drop("orientation"))


@query(
    f"""WITH o AS (SELECT * FROM obj WHERE label > 0), t AS (SELECT image, label, max(v) AS top, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM o GROUP BY ALL),
dense AS (SELECT t.image, t.label, gy AS y, gx AS x, coalesce(CAST(CASE WHEN top > 0 THEN floor(o.v / top * 255) ELSE 0 END AS INTEGER), 0) AS g FROM t, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS gy) a, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS gx) b LEFT JOIN o ON o.image = t.image AND o.label = t.label AND o.y = gy AND o.x = gx),
s AS (SELECT * FROM (VALUES (1, 0, 0, 1), (1, 1, 1, 1), (1, 2, 1, 0), (1, 3, 1, -1), (5, 0, 0, 5), (5, 1, 4, 4), (5, 2, 5, 0), (5, 3, 4, -4), (20, 0, 0, 20), (20, 1, 14, 14), (20, 2, 20, 0), (20, 3, 14, -14)) s(d, a, dy, dx)),
pr AS (SELECT p.image, p.label, d, a, p.g AS i, q.g AS j, count(*) AS n FROM dense p, s, dense q WHERE q.image = p.image AND q.label = p.label AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL),
tot AS (SELECT image, label, d, a, sum(n) AS t FROM pr GROUP BY ALL),
m AS (SELECT image, label, d, a, sum(n / t * (i - j) * (i - j)) AS contrast, sum(n / t * abs(i - j)) AS dissimilarity, sum(n / t / (1 + (i - j) * (i - j))) AS homogeneity, sum(n / t * (n / t)) AS asm, sqrt(sum(n / t * (n / t))) AS energy,
  sum(n / t * i * i) - sum(n / t * i) * sum(n / t * i) AS vi, sum(n / t * j * j) - sum(n / t * j) * sum(n / t * j) AS vj, sum(n / t * i * j) - sum(n / t * i) * sum(n / t * j) AS c FROM pr JOIN tot USING (image, label, d, a) GROUP BY ALL),
q AS (SELECT image, label, d, sum(contrast) / 4 AS contrast, sum(dissimilarity) / 4 AS dissimilarity, sum(homogeneity) / 4 AS homogeneity, sum(asm) / 4 AS asm, sum(energy) / 4 AS energy, (sum(CASE WHEN vi < 1e-9 OR vj < 1e-9 THEN 1.0e0 ELSE c / sqrt(vi * vj) END) + 4 - count(*)) / 4 AS correlation FROM m GROUP BY ALL)
SELECT t.image, t.label, dd.d, {", ".join(f"round(coalesce({c}, {int(c == 'correlation')}) + 1.3e-8, 5) + 0.0e0 AS {c}" for c in "contrast dissimilarity homogeneity asm energy correlation".split())} FROM t CROSS JOIN (VALUES (1), (5), (20)) dd(d) LEFT JOIN q ON q.image = t.image AND q.label = t.label AND q.d = dd.d""",
    "obj",
)
def glcm_props(d: Views) -> DataFrame:
    return rounded(nudged(intensity.glcm(d.obj.where("label > 0"), (1, 5, 20))), 5)


@query(
    """WITH o AS (SELECT image, y, x, label FROM obj WHERE label > 0), n AS (SELECT a.image, a.y, a.x, a.label, count(b.image) AS neighbours FROM o a LEFT JOIN o b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL)
SELECT * FROM n WHERE neighbours < 4""",
    "obj",
)
def boundary_pixels(d: Views) -> DataFrame:
    return pixels.boundary(d.obj)


@query(
    """WITH o AS (SELECT image, y, x, label FROM obj WHERE label > 0), bx AS (SELECT image, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, avg(y) AS cy, avg(x) AS cx FROM o GROUP BY ALL),
n AS (SELECT a.image, a.y, a.x, a.label, count(b.image) AS k FROM o a LEFT JOIN o b ON a.image = b.image AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL),
e AS (SELECT image, label, sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) AS rr FROM n JOIN bx USING (image, label) WHERE k + CAST(y = y0 AS INTEGER) + CAST(y = y1 AS INTEGER) + CAST(x = x0 AS INTEGER) + CAST(x = x1 AS INTEGER) < 4),
g AS (SELECT image, label, count(*) AS k, min(rr) AS min_radius, max(rr) AS max_radius, median(rr) AS med_radius, avg(rr) AS avg_radius, quantile_cont(rr, 0.25) AS d25_radius, quantile_cont(rr, 0.75) AS d75_radius, stddev_pop(rr) AS std_radius FROM e GROUP BY ALL)
SELECT bx.image, bx.label, """
    + ", ".join(f"round(CASE WHEN k >= 3 THEN {c} END, 6) + 0.0e0 AS {c}" for c in "min_radius max_radius med_radius avg_radius d25_radius d75_radius std_radius".split())
    + " FROM bx LEFT JOIN g USING (image, label)",
    "obj",
)
def radii_stats(d: Views) -> DataFrame:
    return rounded(geometry.geometry(d.obj.where("label > 0"), geometry.RADII).select("image", "label", *(c for c in geometry.RADII if c not in ("mode_radius", "feret_max"))))


@query()
def object_geometry(d: Views) -> DataFrame:
    return rounded(geometry.geometry(d.obj.where("label > 0")))


@query(
    """WITH s AS (SELECT * FROM seeds WHERE label > 0), c AS (SELECT g.image, g.y, g.x, s.label, (g.y - s.y) * (g.y - s.y) + (g.x - s.x) * (g.x - s.x) AS d2 FROM grid g JOIN s ON g.image = s.image AND abs(g.y - s.y) <= 2 AND abs(g.x - s.x) <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY image, y, x ORDER BY d2, label) AS rn FROM c WHERE d2 <= 4) SELECT image, y, x, label FROM k WHERE rn = 1""",
    "seeds",
)
def expand_labels(d: Views) -> DataFrame:
    return pixels.expand_labels(d.seeds, d.grid, 2)


@query(
    ("WITH o AS (SELECT image, y, x, y * 16 + x AS i FROM grid WHERE v > 30), w AS (SELECT image, i, i AS root FROM o UNION SELECT o.image, o.i, w.root FROM w JOIN o ON o.image = w.image AND ((abs(o.i - w.i) = 16) OR (abs(o.i - w.i) = 1 AND o.i // 16 = w.i // 16))), m AS (SELECT image, i, min(root) AS root FROM w GROUP BY ALL) SELECT image, CAST(i // 16 AS INTEGER) AS y, CAST(i % 16 AS INTEGER) AS x, CAST(dense_rank() OVER (PARTITION BY image ORDER BY root) AS INTEGER) AS label FROM m"),
    "grid",
    recursive=True,
)
def connected_objects(d: Views) -> DataFrame:
    return pixels.connected_objects(pixels.threshold_objects(d.grid, 30.0))


# Relational shaping --------------------------------------------------------------------------------

_IDS = "SELECT l_suppkey || '_' || l_linenumber AS nuc_id, l_suppkey AS image, avg(l_quantity) AS v, avg(l_discount) AS int_mean FROM lineitem GROUP BY l_suppkey, l_linenumber"


def _objects(d: Views) -> DataFrame:
    """Means are rounded to 12 digits, so that one of exactly 0.05 does not fall on either side by the order of its sum."""
    return d.table("lineitem").groupBy(F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("label")).agg(F.avg("l_quantity").alias("v"), F.round(F.avg("l_discount"), 12).alias("int_mean")).select(scalar.nuc_id().alias("nuc_id"), "image", "v", "int_mean")


@query(f"WITH o AS ({_IDS}) SELECT nuc_id, image, round(v, 6) AS v FROM o WHERE int_mean > 0.05")
def semi_filter_gc(d: Views) -> DataFrame:
    o = _objects(d)
    return rounded(frame.filter_inside(o.drop("int_mean"), o.select("nuc_id", (F.col("int_mean") - 0.05).alias("int_mean"))))


@query(f"WITH o AS ({_IDS}) SELECT nuc_id, image, CASE WHEN int_mean > 0.05 THEN 'positive' ELSE 'negative' END AS gc_status FROM o")
def mark_status(d: Views) -> DataFrame:
    o = _objects(d)
    return frame.mark(o.select("nuc_id", "image"), o.where("int_mean > 0.05"), "gc_status")


@query("""SELECT image, count(*) FILTER (WHERE cell_type = 'T-cells') AS "T-cells", count(*) FILTER (WHERE cell_type = 'DZ B-cells') AS "DZ B-cells", count(*) FILTER (WHERE cell_type = 'LZ B-cells') AS "LZ B-cells" FROM cells GROUP BY ALL""", "cells")
def crosstab_image_type(d: Views) -> DataFrame:
    return frame.crosstab(d.cells, "image", "cell_type", [spatial.T_CELL, spatial.DZ, spatial.LZ])


@query("SELECT l_suppkey AS image, median(l_quantity) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice, round(median(l_tax), 6) AS l_tax FROM lineitem GROUP BY ALL")
def per_image_median(d: Views) -> DataFrame:
    return rounded(frame.group_medians(d.table("lineitem").withColumnRenamed("l_suppkey", "image"), "image", ["l_quantity", "l_extendedprice", "l_tax"]))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 5) AS p25, round(median({c}), 5) AS p50, round(quantile_cont({c}, 0.75), 5) AS p75, max({c}) AS max FROM (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount FROM lineitem)"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
)
def describe_exact(d: Views) -> DataFrame:
    rows = d.table("lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return rounded(frame.describe(rows, ["l_quantity", "l_extendedprice", "l_discount"]), 5)


@query("SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal), 5) AS mean, round(stddev_samp(c_acctbal), 5) AS std, count(c_acctbal) AS n FROM customer GROUP BY ALL")
def group_mean_std_count(d: Views) -> DataFrame:
    return rounded(frame.group_mean_std_count(d.table("customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal"), 5)


@query("SELECT cell_type, count(*) AS n FROM cells GROUP BY ALL", "cells")
def cell_type_counts(d: Views) -> DataFrame:
    return frame.value_counts(d.cells, "cell_type")


@query("SELECT c_custkey AS id, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS status FROM customer UNION ALL SELECT o_custkey, NULL, o_orderstatus FROM orders")
def union_by_name(d: Views) -> DataFrame:
    a = d.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(d.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status")), allowMissingColumns=True)


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def ids_intersect(d: Views) -> DataFrame:
    return d.table("customer").select(F.col("c_custkey").alias("id")).intersect(d.table("orders").select("o_custkey"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ids_except(d: Views) -> DataFrame:
    return d.table("customer").select(F.col("c_custkey").alias("id")).join(d.table("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query("SELECT feature FROM (VALUES ('constant'), ('l_discount')) t(feature)")
def constant_columns(d: Views) -> DataFrame:
    rows = d.table("lineitem").select("l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax", F.lit(1.0).alias("constant"))
    _, gone = frame.clean_data(rows)
    return d.spark.createDataFrame([(c,) for c in gone], "feature string")


@query("WITH q AS (SELECT a.feature AS i, b.feature AS j, round(abs(corr(a.value, b.value)), 6) AS r FROM feat a JOIN feat b ON a.id = b.id AND a.feature < b.feature GROUP BY ALL) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, r FROM q", "feat")
def pearson_matrix(d: Views) -> DataFrame:
    wide = d.table("embeddings").select(*(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)))
    return rounded(frame.correlation_pairs(wide, wide.columns))


@query("WITH q AS (SELECT a.feature AS i, b.feature AS j, abs(corr(a.value, b.value)) AS r FROM feat a JOIN feat b ON a.id = b.id AND a.feature < b.feature GROUP BY ALL) SELECT DISTINCT 'f' || j AS feature FROM q WHERE r > 0.1", "feat")
def correlated_to_drop(d: Views) -> DataFrame:
    wide = d.table("embeddings").select(*(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)))
    return d.spark.createDataFrame([(c,) for c in frame.correlated_columns(wide, wide.columns, 0.1)], "feature string")


@query("SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_pop(s_acctbal) FROM supplier), 6) + 0.0e0 AS s_acctbal FROM supplier")
def standardize(d: Views) -> DataFrame:
    return frame.standardize(d.table("supplier"), ["s_acctbal"]).select("s_suppkey", r("s_acctbal").alias("s_acctbal"))


@query("SELECT c_nationkey, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0e0 ELSE 0.0e0 END), 6) AS share FROM customer GROUP BY ALL")
def cluster_share(d: Views) -> DataFrame:
    return rounded(frame.group_share(d.table("customer"), "c_nationkey", "c_mktsegment", "BUILDING"))


@query("WITH u AS (SELECT cell_type, y FROM b UNION ALL SELECT 'all B-cells', y FROM b) SELECT cell_type, count(*) AS n, round(avg(y), 6) AS mean FROM u GROUP BY ALL", "b")
def facet_rows(d: Views) -> DataFrame:
    rows = frame.with_copy(d.cells.where(F.col("cell_type").isin(spatial.DZ, spatial.LZ)), "cell_type", "all B-cells")
    return rounded(rows.groupBy("cell_type").agg(F.count("*").alias("n"), F.avg("y").alias("mean")))


@query("SELECT s_name, replace(replace(s_name, '#', '/'), '/', '_') AS safe, regexp_extract('/data/run.1/' || s_name || '.ome.tif', '([^/]+?)(\\.[^./]*)?$', 1) AS stem, CASE WHEN s_acctbal / 10000 < 0.0001 THEN '****' WHEN s_acctbal / 10000 < 0.001 THEN '***' WHEN s_acctbal / 10000 < 0.01 THEN '**' WHEN s_acctbal / 10000 < 0.05 THEN '*' ELSE 'ns' END AS stars FROM supplier")
def scalar_functions(d: Views) -> DataFrame:
    return d.table("supplier").select("s_name", scalar.safe_name(F.replace("s_name", F.lit("#"), F.lit("/"))).alias("safe"), scalar.file_stem(F.concat(F.lit("/data/run.1/"), "s_name", F.lit(".ome.tif"))).alias("stem"), scalar.p_stars(F.col("s_acctbal") / 10000).alias("stars"))


# Distances -----------------------------------------------------------------------------------------

_PAIR = "sqrt((a.y - t.y) * (a.y - t.y) + (a.x - t.x) * (a.x - t.x))"
_D2 = "(a.y - t.y) * (a.y - t.y) + (a.x - t.x) * (a.x - t.x)"


@query(f"SELECT a.image, a.id, round(min({_PAIR}), 6) AS distance FROM cells a JOIN cells t ON a.image = t.image WHERE a.cell_type <> 'T-cells' AND t.cell_type = 'T-cells' GROUP BY ALL HAVING min({_D2}) <= 100", "cells")
def nearest_tcell(d: Views) -> DataFrame:
    return rounded(spatial.nearest_of_class(d.cells, 10.0))


@query(f"WITH m AS (SELECT a.image, a.id, min({_D2}) AS d2 FROM cells a JOIN cells t ON a.image = t.image WHERE a.cell_type <> 'T-cells' AND t.cell_type = 'T-cells' GROUP BY ALL) SELECT c.image, c.id, c.cell_type, CASE WHEN d2 <= 25 THEN 'T-cell interactors' WHEN d2 <= 100 THEN 'Potential T-cell interactors' ELSE 'Non-T-cell interactors' END AS influence FROM cells c LEFT JOIN m USING (image, id)", "cells")
def influence_zones(d: Views) -> DataFrame:
    return spatial.influence_zones(d.cells, 5.0, 10.0).select("image", "id", "cell_type", "influence")


@query(f"SELECT a.image, a.id, count(*) AS n_near FROM cells a JOIN cells t ON a.image = t.image WHERE t.cell_type = 'T-cells' AND {_D2} > 0 AND {_D2} < 64 GROUP BY ALL", "cells")
def radius_join_legacy(d: Views) -> DataFrame:
    return spatial.radius_members(d.cells, 8.0, strict=True)


@query(f"SELECT a.image, a.id, count(*) AS n_near FROM cells a JOIN cells t ON a.image = t.image WHERE t.cell_type = 'T-cells' AND {_D2} <= 64 GROUP BY ALL", "cells")
def radius_join_inclusive(d: Views) -> DataFrame:
    return spatial.radius_members(d.cells, 8.0)


@query(f"WITH k AS (SELECT a.image, a.id, t.cell_type AS tt, row_number() OVER (PARTITION BY a.image, a.id ORDER BY round({_D2}, 9), t.id) AS rn FROM cells a JOIN cells t ON a.image = t.image) SELECT DISTINCT image, id FROM k WHERE rn <= 6 AND tt = 'T-cells'", "cells")
def knn_membership(d: Views) -> DataFrame:
    return spatial.knn_members(d.cells)


@query(f"SELECT a.image, a.id, round(avg({_PAIR}), 6) AS mean_distance, round(median({_PAIR}), 6) AS median_distance, round(min({_PAIR}), 6) AS min_distance FROM cells a JOIN cells t ON a.image = t.image WHERE t.cell_type = 'T-cells' GROUP BY ALL", "cells")
def tcell_distance_stats(d: Views) -> DataFrame:
    return rounded(spatial.class_distance_stats(d.cells))


@query(f"WITH p AS (SELECT a.image, a.id, {_PAIR} AS d, min({_PAIR}) OVER (PARTITION BY a.image) AS lo, max({_PAIR}) OVER (PARTITION BY a.image) AS hi FROM cells a JOIN cells t ON a.image = t.image WHERE t.cell_type = 'T-cells') SELECT image, id, round(avg((d - lo) / (hi - lo)), 6) AS mean_distance, round(median((d - lo) / (hi - lo)), 6) AS median_distance, round(min((d - lo) / (hi - lo)), 6) AS min_distance FROM p WHERE hi > lo GROUP BY ALL UNION ALL SELECT DISTINCT image, id, CAST(NULL AS DOUBLE), NULL, NULL FROM p WHERE hi = lo", "cells")
def tcell_distance_scaled(d: Views) -> DataFrame:
    return rounded(spatial.class_distance_stats(d.cells, scaled=True))


@query(f"WITH p AS (SELECT a.image, a.id, {_PAIR} AS d, min({_PAIR}) OVER (PARTITION BY a.image, t.id) AS lo, max({_PAIR}) OVER (PARTITION BY a.image, t.id) AS hi FROM cells a JOIN cells t ON a.image = t.image WHERE t.cell_type = 'T-cells'), s AS (SELECT image, id, CASE WHEN hi > lo THEN (d - lo) / (hi - lo) END AS s FROM p) SELECT image, id, round(avg(s), 6) AS mean_distance, round(median(s), 6) AS median_distance, round(min(s), 6) AS min_distance FROM s GROUP BY ALL", "cells")
def tcell_distance_per_target(d: Views) -> DataFrame:
    return rounded(spatial.class_distance_stats_per_target(d.cells))


@query(f"SELECT a.image, a.id AS id_a, t.id AS id_b, round({_PAIR}, 6) AS distance FROM cells a JOIN cells t ON a.image = t.image", "cells")
def pairwise_distance(d: Views) -> DataFrame:
    return spatial.pairwise_distances(d.cells).withColumn("distance", distance_r("distance"))


@query(
    f"""WITH p AS (SELECT a.image, a.id, a.cell_type AS ct, t.cell_type AS tt, t.id AS tid, {_D2} AS d2 FROM b a JOIN b t ON a.image = t.image), n AS (SELECT image, count(*) AS n, greatest(1, CAST(floor(0.02e0 * count(*)) AS INTEGER)) AS k FROM b GROUP BY ALL), f AS (SELECT image, sqrt(max(d2)) AS far FROM p GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY round(d2, 9), tid) AS rn FROM p WHERE ct <> tt)
SELECT image, id, round(avg(sqrt(d2)) / any_value(far), 6) AS scaled_distance FROM k JOIN n USING (image) JOIN f USING (image) WHERE rn <= k AND n >= 10 AND far > 0 GROUP BY ALL""",
    "b",
)
def border_scaled_distance(d: Views) -> DataFrame:
    return rounded(spatial.border_scaled_distance(d.cells))


_FREQ = f"p AS (SELECT a.image, a.id, a.cell_type AS ct, t.cell_type AS tt, t.id AS tid, {_D2} AS d2 FROM b a JOIN b t ON a.image = t.image AND a.id <> t.id), n AS (SELECT image, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY round(d2, 9), tid) AS rn FROM p), q AS (SELECT image, id, avg(CASE WHEN ct = tt THEN 1.0e0 ELSE 0.0e0 END) AS same_type FROM k JOIN n USING (image) WHERE rn <= 50 AND n >= 10 GROUP BY ALL)"


@query(f"WITH {_FREQ} SELECT image, id, round(same_type, 6) AS same_type, round(abs(same_type - 0.5e0), 6) AS frequency_distance FROM q", "b")
def border_frequency(d: Views) -> DataFrame:
    return rounded(spatial.border_frequency(d.cells))


@query(f"WITH {_FREQ} SELECT image, id, CASE WHEN abs(same_type - 0.5e0) < 0.4 THEN 'close' ELSE 'distant' END AS border_proximity FROM q", "b")
def border_proximity(d: Views) -> DataFrame:
    return spatial.border_proximity(spatial.border_frequency(d.cells)).select("image", "id", "border_proximity")


@query(
    f"""WITH p AS (SELECT a.image, a.id, a.cell_type AS ct, t.cell_type AS tt, t.id AS tid, {_D2} AS d2 FROM b a JOIN b t ON a.image = t.image), n AS (SELECT image, greatest(1, CAST(floor(0.02e0 * count(*)) AS INTEGER)) AS k FROM cells GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY round(d2, 9), tid) AS rn FROM p WHERE ct <> tt), m AS (SELECT image, id, avg(sqrt(d2)) AS d FROM o JOIN n USING (image) WHERE rn <= k GROUP BY ALL), e AS (SELECT image, min(d) AS lo, max(d) AS hi FROM m GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY round(d2, 9), tid) AS rn FROM p WHERE id <> tid), f AS (SELECT image, id, avg(CASE WHEN tt = 'DZ B-cells' THEN 1.0e0 ELSE 0.0e0 END) AS f FROM s JOIN n USING (image) WHERE rn <= k GROUP BY ALL)
SELECT image, id, round((d - lo) / (hi - lo), 6) AS scaled_distance, round(abs(2 * f - 1), 6) AS frequency_distance FROM m JOIN e USING (image) JOIN f USING (image, id) WHERE hi > lo""",
    "b",
)
def border_legacy(d: Views) -> DataFrame:
    return rounded(spatial.border_legacy(d.cells))


_ZONES = f"m AS (SELECT a.image, a.id, min({_D2}) AS d2 FROM cells a JOIN cells t ON a.image = t.image WHERE a.cell_type <> 'T-cells' AND t.cell_type = 'T-cells' GROUP BY ALL)"


@query(
    f"""WITH {_ZONES}, g AS (SELECT image, count(*) AS n_bcells, count(*) FILTER (WHERE cell_type = 'DZ B-cells') AS n_dz, count(*) FILTER (WHERE cell_type = 'LZ B-cells') AS n_lz, count(*) FILTER (WHERE d2 <= 25) AS n_interactors,
count(*) FILTER (WHERE d2 <= 25 AND cell_type = 'DZ B-cells') AS n_dz_interactors, count(*) FILTER (WHERE d2 <= 25 AND cell_type = 'LZ B-cells') AS n_lz_interactors FROM b LEFT JOIN m USING (image, id) GROUP BY ALL)
SELECT *, round(CASE WHEN n_bcells > 0 THEN n_interactors / n_bcells ELSE 0 END, 6) AS interactor_fraction, round(CASE WHEN n_dz > 0 THEN n_dz_interactors / n_dz ELSE 0 END, 6) AS dz_interactor_fraction, round(CASE WHEN n_lz > 0 THEN n_lz_interactors / n_lz ELSE 0 END, 6) AS lz_interactor_fraction,
round(CASE WHEN n_interactors > 0 THEN n_dz_interactors / n_interactors ELSE 0 END, 6) AS dz_share_of_interactors FROM g""",
    "b",
)
def fraction_by_image(d: Views) -> DataFrame:
    return rounded(celltype.fractions_by_image(celltype.tcell_influence(d.cells, 5.0, 10.0, 1.0)))


# Statistics ----------------------------------------------------------------------------------------

_WELCH = "o AS (SELECT feature, label, count(*) AS n1, avg(value) AS m1, var_samp(value) AS v1 FROM feat GROUP BY ALL), e AS (SELECT a.feature, a.label, count(*) AS n2, avg(t.value) AS m2, var_samp(t.value) AS v2 FROM (SELECT DISTINCT feature, label FROM feat) a JOIN feat t ON a.feature = t.feature AND a.label <> t.label GROUP BY ALL), w AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS statistic, (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / (v1 / n1 * (v1 / n1) / (n1 - 1) + v2 / n2 * (v2 / n2) / (n2 - 1)) AS df FROM o JOIN e USING (feature, label) WHERE n1 >= 3 AND n2 >= 3)"


@query(f"WITH {_WELCH} SELECT label, feature, round(statistic, 4) + 0.0e0 AS statistic, round(df, 3) AS df FROM w", "feat")
def welch_t(d: Views) -> DataFrame:
    return rounded(stats.find_markers(d.feat).select("label", "feature", "statistic", "df"), 4, df=3)


@query(f"WITH {_WELCH} SELECT label, feature, n1, n2, round(m1, 6) + 0.0e0 AS mean_in, round(m2, 6) + 0.0e0 AS mean_out, round(m1 - m2, 6) + 0.0e0 AS delta, round(abs(m1 - m2), 6) AS abs_delta_fc, round(statistic, 4) + 0.0e0 AS statistic FROM w", "feat")
def find_markers(d: Views) -> DataFrame:
    return rounded(stats.find_markers(d.feat).select("label", "feature", "n1", "n2", "mean_in", "mean_out", "delta", "abs_delta_fc", "statistic"), 6, statistic=4)


@query(f"WITH {_WELCH} SELECT label, feature, CAST(printf('%.4e', (m1 + 1e-15) / (m2 + 1e-15)) AS DOUBLE) AS fold_change, round(statistic, 4) + 0.0e0 AS statistic FROM w", "feat")
def find_markers_legacy(d: Views) -> DataFrame:
    """Ratios of means have any size: five digits of each."""
    m = stats.find_markers(d.feat, legacy=True)
    return m.select("label", "feature", F.format_string("%.4e", "fold_change").cast("double").alias("fold_change"), r("statistic", 4).alias("statistic"))


@query(f"WITH {_WELCH}, k AS (SELECT label, feature, round(abs(m1 - m2), 9) AS delta, row_number() OVER (PARTITION BY label ORDER BY round(abs(m1 - m2), 9) DESC, feature) AS rn FROM w) SELECT label, feature, round(delta, 6) AS delta, rn FROM k WHERE rn <= 10", "feat")
def top_markers_per_group(d: Views) -> DataFrame:
    m = stats.find_markers(d.feat).select("label", "feature", F.round("abs_delta_fc", 9).alias("delta"))
    return rounded(frame.top_per_group(m, "label", [F.desc("delta"), F.col("feature")], 10)).withColumn("rn", F.col("rn").cast("long"))


@query()
def marker_p_values(d: Views) -> DataFrame:
    return stats.find_markers(d.feat).select("label", "feature", r("pval", 9).alias("pval"), r("p_adj", 9).alias("p_adj"))


_P = "SELECT p_partkey AS id, CAST((p_partkey * 7919) % 10007 AS DOUBLE) / 10007.0e0 AS p FROM part"


@query(f"WITH p AS ({_P}), k AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS rk, count(*) OVER () AS m FROM p) SELECT id, round(least(1.0e0, min(p * m / rk) OVER (ORDER BY rk DESC)), 6) AS p_adj FROM k")
def bh_adjust(d: Views) -> DataFrame:
    p = d.table("part").select(F.col("p_partkey").alias("id"), (((F.col("p_partkey") * 7919) % 10007).cast("double") / 10007.0).alias("p"))
    return rounded(stats.adjust_fdr(p, "p", ["id"]).select("id", "p_adj"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS avg_rank FROM part")
def avg_ranks(d: Views) -> DataFrame:
    return frame.with_average_rank(d.table("part").select("p_partkey", "p_brand", "p_size"), "p_size", ("p_brand",), "avg_rank").select("p_partkey", "avg_rank")


_MWU = "v AS (SELECT c_nationkey AS feature, c_mktsegment AS label, round(c_acctbal, -2) AS value FROM customer), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM v), tie AS (SELECT feature, sum(t * t * t - t) AS tie, sum(t) AS n FROM (SELECT feature, value, CAST(count(*) AS DOUBLE) AS t FROM v GROUP BY ALL) GROUP BY ALL), s AS (SELECT feature, label, sum(rk) AS r1, CAST(count(*) AS DOUBLE) AS n1 FROM k GROUP BY ALL)"


@query(f"WITH {_MWU}, u AS (SELECT label, feature, r1 - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n2, n, tie FROM s JOIN tie USING (feature)) SELECT label, feature, u, round(greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))), 0), 6) AS z FROM u")
def mann_whitney_u(d: Views) -> DataFrame:
    long = d.table("customer").select(F.col("c_nationkey").alias("feature"), F.col("c_mktsegment").alias("label"), F.round("c_acctbal", -2).alias("value"))
    return rounded(stats.rank_sums(long))


@query("WITH d AS (SELECT l_suppkey AS image, l_quantity - 25 - l_linenumber AS d FROM lineitem), k AS (SELECT image, d, rank() OVER (PARTITION BY image ORDER BY abs(d)) + (count(*) OVER (PARTITION BY image, abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0), s AS (SELECT image, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS down, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT image, sum(t * t * t - t) AS tie FROM (SELECT image, abs(d) AS m, CAST(count(*) AS DOUBLE) AS t FROM d WHERE d <> 0 GROUP BY ALL) GROUP BY ALL) SELECT image, least(up, down) AS w, n, round((least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM s JOIN t USING (image)")
def wilcoxon_w(d: Views) -> DataFrame:
    pairs = d.table("lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_quantity").alias("a"), (F.lit(25.0) + F.col("l_linenumber")).alias("b"))
    return rounded(stats.wilcoxon(pairs, ["image"]).drop("pval"))


_SCREEN = "x AS (SELECT feature, value, CAST(label AS DOUBLE) AS target FROM feat), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rv, rank() OVER (PARTITION BY feature ORDER BY target) + (count(*) OVER (PARTITION BY feature, target) - 1) / 2 AS rt FROM x), q AS (SELECT feature, count(*) AS n, corr(value, target) AS pearson_r, corr(rv, rt) AS spearman_r FROM k GROUP BY ALL)"


@query(f"WITH {_SCREEN} SELECT feature, n, round(pearson_r, 6) + 0.0e0 AS pearson_r, round(spearman_r, 6) + 0.0e0 AS spearman_r FROM q", "feat")
def spearman_screen(d: Views) -> DataFrame:
    return rounded(stats.correlations(d.feat.select("feature", "value", F.col("label").cast("double").alias("target"))).drop("spearman_p"))


@query(f"WITH {_SCREEN} SELECT feature, round(abs(pearson_r), 6) AS strength FROM q ORDER BY round(abs(pearson_r), 9) DESC, feature LIMIT 10", "feat")
def top_correlations(d: Views) -> DataFrame:
    c = stats.correlations(d.feat.select("feature", "value", F.col("label").cast("double").alias("target")))
    return rounded(c.select("feature", F.abs("pearson_r").alias("strength")).orderBy(F.round("strength", 9).desc(), "feature").limit(10))


@query()
def correlation_screen(d: Views) -> DataFrame:
    return stats.correlation_screen(d.feat.select("feature", "value", F.col("label").cast("double").alias("target")))


@query()
def metadata_correlation(d: Views) -> DataFrame:
    meta = d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("image")).agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").cast("double").alias("n_orders"))
    cells = d.table("customer").select(F.col("c_nationkey").alias("image"), "c_acctbal", F.length("c_name").cast("double").alias("name_length"))
    return analysis.correlate_metadata(cells, ["c_acctbal", "name_length"], meta)["correlation_results"]


@query("WITH g AS (SELECT feature, avg(value) FILTER (WHERE label = 1) AS mean1, avg(value) FILTER (WHERE label = 2) AS mean2, var_samp(value) FILTER (WHERE label = 1) AS v1, var_samp(value) FILTER (WHERE label = 2) AS v2, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 2) AS n2 FROM feat WHERE label IN (1, 2) GROUP BY ALL) SELECT feature, round(mean1, 6) + 0.0e0 AS mean1, round(mean2, 6) + 0.0e0 AS mean2, round(sqrt(v1), 6) AS std1, round(sqrt(v2), 6) AS std2, n1, n2, round((mean1 - mean2) / sqrt(v1 / n1 + v2 / n2), 4) + 0.0e0 AS statistic, round((mean1 - mean2) / sqrt((v1 + v2) / 2), 5) + 0.0e0 AS cohens_d FROM g", "feat")
def cohens_d(d: Views) -> DataFrame:
    return rounded(stats.group_difference(d.feat, "label", 1, 2).drop("df", "pval"), 6, statistic=4, cohens_d=5)


@query(
    f"""WITH {_FREQ}, f AS (SELECT q.image, q.id, b.cell_type, CASE WHEN abs(same_type - 0.5e0) < 0.1 THEN 'close' ELSE 'distant' END AS pr, b.y, b.x FROM q JOIN b USING (image, id)), u AS (SELECT cell_type, pr, 'y' AS feature, y AS value FROM f UNION ALL SELECT cell_type, pr, 'x', x FROM f),
g AS (SELECT cell_type, feature, avg(value) FILTER (WHERE pr = 'close') AS mean_close, avg(value) FILTER (WHERE pr = 'distant') AS mean_distant, var_samp(value) FILTER (WHERE pr = 'close') AS v1, var_samp(value) FILTER (WHERE pr = 'distant') AS v2, count(*) FILTER (WHERE pr = 'close') AS n_close, count(*) FILTER (WHERE pr = 'distant') AS n_distant FROM u GROUP BY ALL)
SELECT cell_type, feature, round(mean_close, 5) AS mean_close, round(mean_distant, 5) AS mean_distant, n_close, n_distant, round((mean_close - mean_distant) / sqrt(v1 / n_close + v2 / n_distant), 4) + 0.0e0 AS statistic, round((mean_close - mean_distant) / sqrt((v1 + v2) / 2), 5) + 0.0e0 AS effect_size FROM g WHERE n_close >= 10 AND n_distant >= 10""",
    "b",
)
def boundary_differences(d: Views) -> DataFrame:
    near = spatial.border_proximity(spatial.border_frequency(d.cells), 0.1).select(F.col("image").alias("i"), F.col("id").alias("k"), "border_proximity")
    rows = d.cells.join(near, (F.col("image") == F.col("i")) & (F.col("id") == F.col("k")))
    return rounded(stats.boundary_differences(stats.unpivot(rows, ["cell_type", "border_proximity"], ["y", "x"])).drop("df", "pval"), 5, statistic=4)


@query("SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) + 0.0e0 AS slope, round(regr_intercept(p_retailprice, p_size), 5) AS intercept, count(*) AS n FROM part GROUP BY ALL")
def regression_line(d: Views) -> DataFrame:
    return rounded(stats.regression_lines(d.table("part"), "p_brand", "p_size", "p_retailprice"), 6, intercept=5)


@query()
def student_t_tail(d: Views) -> DataFrame:
    return d.table("supplier").select("s_suppkey", r(t_p_value(F.col("s_acctbal") / 1000, F.col("s_suppkey").cast("double"))).alias("p"))


# Typing, classification, clustering ----------------------------------------------------------------


@query()
def gmm_threshold(d: Views) -> DataFrame:
    return rounded(celltype.mixture_thresholds(d.table("customer").select(F.col("c_nationkey").alias("image"), F.col("c_acctbal").alias("int_mean"))))


@query()
def positive_cells(d: Views) -> DataFrame:
    return celltype.positive_cells(d.table("customer").select(F.col("c_nationkey").alias("image"), F.col("c_custkey").alias("nuc_id"), F.col("c_acctbal").alias("int_mean"))).select("image", "nuc_id")


@query()
def positive_ids_of_images(d: Views) -> DataFrame:
    names = [str(r[0]) for r in d.table("nation").select("n_nationkey").where("n_regionkey = 2").collect()]
    return celltype.positive_ids_of_images(d.table("customer").select(F.col("c_nationkey").cast("string").alias("image"), F.col("c_custkey").alias("nuc_id"), F.col("c_acctbal").alias("int_mean")), names)


@query(
    """SELECT p_partkey AS nuc_id, CASE WHEN p_size > 25 THEN 'positive' ELSE 'negative' END AS aicda_status, CASE WHEN p_type LIKE 'PROMO%' THEN 'positive' ELSE 'negative' END AS cd3_status, CASE WHEN p_type LIKE 'PROMO%' THEN 'T-cells' WHEN p_size > 25 THEN 'DZ B-cells' ELSE 'LZ B-cells' END AS cell_type FROM part"""
)
def assign_cell_types(d: Views) -> DataFrame:
    p = d.table("part").withColumnRenamed("p_partkey", "nuc_id")
    return celltype.assign_cell_types(p.select("nuc_id"), p.where("p_size > 25"), p.where(F.col("p_type").startswith("PROMO")))


@query("SELECT label, CAST(f AS INTEGER) AS fold, count(*) AS n FROM (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 10 AS f FROM embeddings) GROUP BY ALL")
def stratified_folds(d: Views) -> DataFrame:
    return ml.stratified_folds(d.table("embeddings"), "label", "vec_id").groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("SELECT label, (SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) AS n FROM embeddings GROUP BY label")
def undersample_counts(d: Views) -> DataFrame:
    return ml.undersample(d.table("embeddings"), "label", "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT truth, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM scored GROUP BY truth, predicted", "scored")
def confusion_matrix(d: Views) -> DataFrame:
    return rounded(ml.confusion(d.scored, "truth", "predicted", normalize=True))


@query("SELECT round(avg(recall), 6) AS balanced_accuracy FROM (SELECT truth, avg(CASE WHEN truth = predicted THEN 1.0e0 ELSE 0.0e0 END) AS recall FROM scored GROUP BY truth)", "scored")
def balanced_accuracy(d: Views) -> DataFrame:
    return rounded(ml.balanced_accuracy(d.scored, "truth", "predicted"))


@query("WITH l AS (SELECT DISTINCT truth AS label FROM scored UNION SELECT DISTINCT predicted FROM scored), g AS (SELECT label, count(*) FILTER (WHERE truth = label) AS support, count(*) FILTER (WHERE predicted = label) AS claimed, count(*) FILTER (WHERE truth = label AND predicted = label) AS hits FROM scored, l GROUP BY label), q AS (SELECT label, coalesce(hits / nullif(claimed, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS rc, support FROM g) SELECT label, round(p, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 6) AS f1, support FROM q", "scored")
def classification_report(d: Views) -> DataFrame:
    return rounded(ml.report(d.scored, "truth", "predicted"))


_ROC = "g AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM scored GROUP BY ALL), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY score DESC) / sum(n) OVER () AS fpr FROM g)"


@query(f"WITH {_ROC} SELECT round(score, 9) AS score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM c", "scored")
def roc_points(d: Views) -> DataFrame:
    return rounded(ml.roc_points(d.scored, "truth", "score"), 6, score=9)


@query(f"WITH {_ROC}, s AS (SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS f0, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS t0 FROM c) SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM s", "scored")
def auc_trapezoid(d: Views) -> DataFrame:
    return rounded(ml.auc(ml.roc_points(d.scored, "truth", "score")))


_FOLDED = "p AS (SELECT *, CAST(id % 5 AS INTEGER) AS fold FROM scored)"


def _folded(d: Views) -> DataFrame:
    return d.scored.withColumn("fold", (F.col("id") % 5).cast("int"))


@query(
    f"""WITH {_FOLDED}, l AS (SELECT fold, truth AS label FROM p UNION SELECT fold, predicted FROM p),
g AS (SELECT l.fold, l.label, count(*) FILTER (WHERE truth = l.label) AS t, count(*) FILTER (WHERE predicted = l.label) AS k, count(*) FILTER (WHERE truth = l.label AND predicted = l.label) AS h FROM l JOIN p ON l.fold = p.fold GROUP BY ALL)
SELECT fold, round(sum(h) / sum(t), 6) AS accuracy, round(avg(CASE WHEN t > 0 THEN h / t END), 6) AS balanced_accuracy, round(avg(2.0e0 * h / (t + k)), 6) AS f1_macro FROM g GROUP BY fold""",
    "scored",
)
def fold_scores(d: Views) -> DataFrame:
    return rounded(ml.fold_scores(_folded(d), "truth"))


@query(
    f"""WITH {_FOLDED}, c AS (SELECT fold, truth, predicted, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT fold, truth, predicted, n / sum(n) OVER (PARTITION BY fold, truth) AS share FROM c), k AS (SELECT truth, count(DISTINCT fold) AS k FROM p GROUP BY truth)
SELECT truth, predicted, round(sum(share) / any_value(k), 6) AS share FROM s JOIN k USING (truth) GROUP BY truth, predicted""",
    "scored",
)
def mean_fold_confusion(d: Views) -> DataFrame:
    return rounded(ml.mean_fold_confusion(_folded(d), "truth"))


@query("SELECT round(avg(CASE WHEN truth = predicted THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy FROM scored", "scored")
def accuracy(d: Views) -> DataFrame:
    return rounded(ml.accuracy(d.scored, "truth", "predicted"))


@query(
    """WITH k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, CAST(CASE WHEN pos < (n % 10) * (n // 10 + 1) THEN pos // (n // 10 + 1) ELSE n % 10 + (pos - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) END AS INTEGER) AS fold, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM k GROUP BY ALL"""
)
def ordered_folds(d: Views) -> DataFrame:
    return ml.ordered_folds(d.table("embeddings"), "label", "vec_id").groupBy("label", "fold").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("SELECT count(DISTINCT label) FILTER (WHERE label <> 3) AS n_clusters FROM embeddings")
def n_clusters(d: Views) -> DataFrame:
    """Label 3 stands for noise here."""
    return ml.n_clusters(d.table("embeddings").select(F.when(F.col("label") == 3, -1).otherwise(F.col("label")).alias("cluster")))


@query("SELECT id, round(score, 9) AS score FROM scored WHERE score < 0.05", "scored")
def significant_rows(d: Views) -> DataFrame:
    return rounded(frame.significant(d.scored, "score").select("id", "score"), 9)


@query("SELECT count(*) FILTER (WHERE score < 0.05) AS n_significant FROM scored", "scored")
def n_significant(d: Views) -> DataFrame:
    return frame.n_significant(d.scored, "score")


@query("SELECT id, round(score, 9) AS score FROM scored ORDER BY scored.score, id LIMIT 25", "scored")
def top_features(d: Views) -> DataFrame:
    return rounded(frame.top_n(d.scored, [F.col("score"), F.col("id")], 25).select("id", "score"), 9)


@query(
    """WITH c AS (SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'T-cells' WHEN p_size > 25 THEN 'DZ B-cells' ELSE 'LZ B-cells' END AS cell_type, p_retailprice > 1200 AS inside FROM part)
SELECT cell_type, count(*) FILTER (WHERE inside) AS positive, count(*) FILTER (WHERE NOT inside) AS negative FROM c GROUP BY ALL"""
)
def cell_types_by_gc_status(d: Views) -> DataFrame:
    p = d.table("part").withColumnRenamed("p_partkey", "nuc_id")
    typed = celltype.assign_cell_types(p.select("nuc_id"), p.where("p_size > 25"), p.where(F.col("p_type").startswith("PROMO")), p.select("nuc_id", (F.col("p_retailprice").cast("double") - 1200).alias("int_mean")))
    return frame.crosstab(typed, "cell_type", "gc_status", ["positive", "negative"])


@query(f"WITH {_RAW}, u AS (SELECT image, label, {_MOMENTS.replace('sum(v', 'sum(1.0e0')} FROM o GROUP BY ALL) SELECT * FROM u", "obj")
def unweighted_moments(d: Views) -> DataFrame:
    return intensity.raw_moments(d.obj.where("label > 0"), weighted=False)


#: All components of an embedding.
_COMPONENTS = [f"f{k}" for k in range(64)]


def _wide(d: Views) -> DataFrame:
    return d.table("embeddings").select(F.col("vec_id").alias("nuc_id"), F.concat(F.lit("c"), F.col("label") % 2).alias("kind"), *(F.col("embedding")[k].cast("double").alias(f) for k, f in enumerate(_COMPONENTS)))


@query()
def cross_validation(d: Views) -> DataFrame:
    return ml.cross_validate(_wide(d), _COMPONENTS, "kind", "nuc_id")["folds"]


@query()
def feature_importance(d: Views) -> DataFrame:
    return ml.cross_validate(_wide(d), _COMPONENTS, "kind", "nuc_id")["importance"]


@query()
def dz_probability(d: Views) -> DataFrame:
    cells = celltype.tcell_influence(d.cells, 5.0, 10.0, 1.0).withColumn("nuc_id", F.col("id"))
    train, test = ml.split_for_probability(cells)
    out = ml.fit_predict(train, test, ["y", "x"], "cell_type", spatial.DZ, "nuc_id")
    return frame.group_mean_std_count(out, ["cell_type", "influence"], "probability")


@query()
def embedding_clusters(d: Views) -> DataFrame:
    e = ml.embedding(_wide(d), _COMPONENTS).select("nuc_id", "kind", "e0", "e1")
    return ml.clusters(frame.materialized(e), ["e0", "e1"])


@query()
def density_clusters(d: Views) -> DataFrame:
    return density.density_clusters(d.cells, 5, 3)


@query()
def density_cluster_sizes(d: Views) -> DataFrame:
    """Clusters of all cells at once, by the embedding's first two components, with the sizes that ``analyze`` takes."""
    points = d.table("embeddings").select(F.lit("all").alias("image"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("y"), F.col("embedding")[1].cast("double").alias("x"))
    return frame.value_counts(density.density_clusters(points, 20, 10), "cluster")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_windows(d: Views) -> DataFrame:
    return rounded(windowed_counts(d.table("events")))
