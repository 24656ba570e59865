"""Command line: init, pipeline, preprocess, segment, extract, analyze."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.functions.scalar import nuc_id, parse_channels
from cellspark.operators import frame, geometry, intensity, pixels
from cellspark.plans import analysis
from cellspark.plans.config import default_config, load_config, save_config
from cellspark.session import session
from cellspark.sources import images, tables
from cellspark.streaming.incremental import STEPS, FileLog, StepState, process_each_file


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellspark", description=__doc__)
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="write a default configuration")
    c.add_argument("--name", default="dataset1")
    c.add_argument("--output", default="configs/config.yaml")
    c = sub.add_parser("pipeline", help="run steps of a configuration")
    c.add_argument("--config", required=True)
    c.add_argument("--steps", nargs="+", choices=STEPS, default=list(STEPS))
    c.add_argument("--output-dir")
    for flag in ("--resume", "--reset", "--status"):
        c.add_argument(flag, action="store_true")
    c = sub.add_parser("preprocess", help="images to scaled channels")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--channels", nargs="+", default=["dapi:1", "cd3:2", "aicda:3"])
    c.add_argument("--quantiles", nargs=2, type=float, default=[0.01, 0.998])
    c.add_argument("--mask-dir")
    c.add_argument("--skip-normalize", action="store_true")
    c = sub.add_parser("segment", help="scaled channel to labels (threshold and connected objects)")
    c.add_argument("--input", required=True)
    c.add_argument("--output-labels", required=True)
    c.add_argument("--output-rois")
    c.add_argument("--prob-thresh", type=float, default=0.43)
    c.add_argument("--no-pretrained", action="store_true")
    c.add_argument("--model-dir", default="models")
    c.add_argument("--model-name", default="DAPI_segmentation")
    c = sub.add_parser("extract", help="pixels and labels to feature tables")
    c.add_argument("--raw-images", required=True)
    c.add_argument("--labels", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--proteins", nargs="*", default=[])
    c.add_argument("--cell-segmentation", action="store_true")
    c.add_argument("--dilation-radius", type=int, default=10)
    c.add_argument("--extract-spatial", action="store_true", default=True)
    c = sub.add_parser("analyze", help="feature tables to results")
    c.add_argument("--features", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--analysis-type", nargs="+", default=["cell_type"])
    c.add_argument("--metadata")
    c.add_argument("--correlation-threshold", type=float, default=0.8)
    c.add_argument("--random-seed", type=int, default=1234)
    c.add_argument("--pixel-size", type=float, default=0.3225)
    c.add_argument("--contact-radius", type=float, default=15.0)
    c.add_argument("--signaling-radius", type=float, default=30.0)
    c.add_argument("--border-threshold", type=float, default=0.4)
    c.add_argument("--no-plots", action="store_true")
    c.add_argument("--n-permutations", type=int, default=10_000)
    return p


def preprocess(spark, source: str, output: str, channels: dict[str, int], quantiles: list[float], skip: bool = False) -> None:
    """Channels of merged images and the scaled one. Whether images are merged is told by the first; single ones are the dapi channel as they are."""
    raw, failed = images.scan_images(spark, source)
    first = pixels.is_multichannel(raw, max(channels.values())).orderBy("image").first()
    merged = first is None or first["multichannel"]
    if not merged:
        raw.where("c = 0").drop("c").write.mode("overwrite").partitionBy("image").parquet(f"{output}/dapi")
    for name, index in channels.items() if merged else ():
        pixels.extract_channel(raw, index).write.mode("overwrite").partitionBy("image").parquet(f"{output}/{name}")
    if not skip:
        dapi = spark.read.parquet(f"{output}/dapi")
        scaled = pixels.quantile_normalize(dapi, *quantiles)
        scaled.select("image", "y", "x", F.col("scaled").cast("double").alias("v")).write.mode("overwrite").partitionBy("image").parquet(f"{output}/dapi_scaled")
    failed.write.mode("overwrite").parquet(f"{output}/failed_images")


def segment(spark, source: str, output: str, cut: float = 0.43) -> None:
    scaled = spark.read.parquet(source)
    pixels.connected_objects(pixels.threshold_objects(scaled, cut * 255)).write.mode("overwrite").partitionBy("image").parquet(output)


#: Feature families that can be asked for.
FAMILIES = ("simple_geometry", "calliper_distances", "radii_features", "curvature", "int_dist_features", "hc_ec_ratios_features", "gclm_features", "moments_features")


def moment_features(rows: DataFrame) -> DataFrame:
    """All 112: raw, central, normalised and Hu moments, weighted by intensity and not, and the weighted centroid from the box's corner."""
    keys, out = ["image", "label"], None
    grid = [(p, q) for p in range(4) for q in range(4)]
    for head, weighted in (("weighted_moments", True), ("moments", False)):
        raw = intensity.raw_moments(rows, weighted=weighted)
        central = intensity.central_moments(raw)
        normal = intensity.normalized_moments(central)
        tables_ = [
            raw.select(*keys, *(F.col(f"m_{p}{q}").alias(f"{head}-{p}-{q}") for p, q in grid)),
            central.select(*keys, *([F.col("cy").alias("weighted_centroid-0"), F.col("cx").alias("weighted_centroid-1")] if weighted else []), *(F.col(f"mu_{p}{q}").alias(f"{head}_central-{p}-{q}") for p, q in grid)),
            normal.select(*keys, *(F.col(f"nu_{p}{q}").alias(f"{head}_normalized-{p}-{q}") for p, q in grid)),
            intensity.hu_moments(normal).withColumnsRenamed({f"hu_{i}": f"{head}_hu-{i}" for i in range(7)}),
        ]
        for t in tables_:
            out = t if out is None else out.join(t, keys)
    return out


def nuclear_features(raw: DataFrame, labelled: DataFrame, families: tuple[str, ...] = FAMILIES, normalize: bool = True) -> DataFrame:
    """One wide row for each object with the families asked for; ``normalize`` stretches each image to 0..255 first."""
    if unknown := set(families) - set(FAMILIES):
        raise ValueError(f"unknown families {sorted(unknown)}")
    if normalize:
        raw = pixels.minmax_normalize(raw).select("image", "y", "x", F.coalesce("scaled", F.lit(0.0)).alias("v"))
    rows = frame.materialized(pixels.levels(raw, labelled))
    keys = ["image", "label"]
    out, parts = rows.select(*keys).distinct(), []
    shaped = [c for name, columns in (("radii_features", geometry.RADII), ("calliper_distances", geometry.CALLIPER), ("simple_geometry", geometry.HULL), ("curvature", geometry.CURVATURE)) if name in families for c in columns]
    if "simple_geometry" in families:
        parts.append(intensity.shape_from_moments(rows))
    if shaped:
        parts.append(geometry.geometry(rows).select(*keys, *shaped))
    if "int_dist_features" in families:
        parts += [intensity.intensity_stats(rows), intensity.entropy(rows)]
    if "hc_ec_ratios_features" in families:
        parts.append(intensity.condensation(rows))
    if "gclm_features" in families:
        names = ("contrast", "dissimilarity", "homogeneity", "asm", "energy", "correlation")
        parts.append(intensity.glcm(rows).groupBy(*keys).agg(*(F.max(F.when(F.col("d") == d, F.col(c))).alias(f"{c}_{d}") for d in (1, 5, 20) for c in names)))
    if "moments_features" in families:
        parts.append(moment_features(rows))
    for part in parts:
        out = out.join(part, keys, "left")
    return out.withColumn("nuc_id", nuc_id())


def protein_levels(picture: DataFrame, labelled: DataFrame) -> DataFrame:
    """The eleven intensity statistics of each object."""
    found = pixels.levels(picture, labelled)
    return intensity.intensity_stats(found).join(intensity.entropy(found), ["image", "label"]).withColumn("nuc_id", nuc_id())


def extract(spark, raw: str, labels: str, output: str, proteins: list[str], cells: bool = False, radius: int = 10) -> None:
    picture, labelled = spark.read.parquet(raw), spark.read.parquet(labels)
    tables.write_results({"nuc_features": nuclear_features(picture, labelled), "spatial_coordinates": pixels.regions(labelled).select("image", "label", nuc_id().alias("nuc_id"), F.col("centroid_y").alias("centroid-0"), F.col("centroid_x").alias("centroid-1"))}, output)
    where = pixels.expand_labels(labelled, picture, radius) if cells else labelled
    for path in proteins:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        tables.write_results({f"{name}_levels": protein_levels(spark.read.parquet(path), where)}, output)


def extract_by_image(spark, raw: str, labels: str, output: str, proteins: list[str], state: str, cells: bool = False, radius: int = 10, per_batch: int = 64, resume: bool = False) -> FileLog:
    """As :func:`extract`, a batch of images at a time: an image's rows are replaced as a whole, each image is logged, and bad ones become rows of ``failed_images``. With ``resume``, images that are done stay as they are and failed ones are tried again."""
    log = FileLog(spark, f"{state}/log")
    if not resume:
        log.reset("extract")

    def work(names: list[str]) -> None:
        own = lambda path: spark.read.parquet(path).withColumn("image", F.col("image").cast("string")).where(F.col("image").isin(names))
        picture, labelled = own(raw), own(labels)
        results = {"nuc_features": nuclear_features(picture, labelled), "spatial_coordinates": pixels.regions(labelled).select("image", "label", nuc_id().alias("nuc_id"), F.col("centroid_y").alias("centroid-0"), F.col("centroid_x").alias("centroid-1"))}
        where = pixels.expand_labels(labelled, picture, radius) if cells else labelled
        for path in proteins:
            results[f"{path.rstrip('/').rsplit('/', 1)[-1]}_levels"] = protein_levels(own(path), where)
        for name, df in results.items():
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image").parquet(f"{output}/{name}")

    image = F.url_decode(F.replace(F.regexp_extract("path", "/image=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    process_each_file(spark, labels, "extract", work, log, f"{state}/stream", image, "*.parquet", per_batch, resume)
    log.status("extract").where("status = 'failed'").select(F.col("file").alias("image"), "error").write.mode("overwrite").parquet(f"{output}/failed_images")
    return log


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "init":
        save_config(default_config(args.name), args.output)
        return 0
    spark = session()
    if args.command == "pipeline":
        return run_pipeline(spark, load_config(args.config), args)
    if args.command == "preprocess":
        preprocess(spark, args.input, args.output, parse_channels(args.channels), args.quantiles, args.skip_normalize)
    elif args.command == "segment":
        segment(spark, args.input, args.output_labels, args.prob_thresh)
    elif args.command == "extract":
        extract(spark, args.raw_images, args.labels, args.output, args.proteins, args.cell_segmentation, args.dilation_radius)
    else:
        _analyze(spark, args.features, args.output, args.analysis_type, args.metadata, threshold=args.correlation_threshold, seed=args.random_seed, pixel_size=args.pixel_size, contact=args.contact_radius, signal=args.signaling_radius, border=args.border_threshold, permutations=args.n_permutations)
    return 0


def _analyze(spark, features: str, output: str, types: list[str], metadata: str | None = None, **options) -> None:
    read = lambda name: tables.optional(spark, f"{features}/{name}")
    results = analysis.analyze(spark.read.parquet(f"{features}/nuc_features"), types, read("spatial_coordinates"), read("aicda_levels"), read("cd3_levels"), read("gc_levels"), tables.optional(spark, metadata) if metadata else None, **options)
    tables.write_results(results, output)


def run_pipeline(spark, config: dict, args) -> int:
    """Steps in order; the first that fails is recorded and stops the run."""
    out = args.output_dir or config.get("output_dir", "output")
    state = StepState(spark, f"{out}/state")
    if args.status:
        state.status().show(truncate=False)
        return 0
    if args.reset:
        state.reset()
    pre, options = config["preprocessing"], config.get("analysis", {})
    work = {
        "preprocess": lambda: preprocess(spark, pre.get("input_dir", "input"), f"{out}/images", pre["channels"], pre["quantiles"]),
        "segment": lambda: segment(spark, f"{out}/images/dapi_scaled", f"{out}/labels", config["segmentation"].get("prob_thresh", 0.43)),
        "extract": lambda: extract_by_image(spark, f"{out}/images/dapi", f"{out}/labels", f"{out}/features", [f"{out}/images/{c}" for c in pre["channels"] if c != "dapi"], f"{out}/state_extract", resume=args.resume),
        "analyze": lambda: _analyze(spark, f"{out}/features", f"{out}/results", options.get("types", ["cell_type"]), options.get("metadata"), threshold=options.get("correlation_threshold", 0.8), seed=options.get("random_seed", 1234)),
    }
    for step in [s for s in STEPS if s in (state.remaining(args.steps) if args.resume else args.steps)]:
        state.start(step)
        try:
            work[step]()
        except Exception as e:
            state.fail(step, str(e)[:500])
            raise
        state.complete(step)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
