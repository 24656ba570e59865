"""The analyses as one graph of named DataFrames: ask for types, get results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.operators import celltype, frame, ml, spatial, stats

TYPES = ("cell_type_detection", "cell_type", "tcell_interaction", "boundary", "correlation", "umap", "markers", "tcell_interaction_dz", "tcell_interaction_lz", "dz_prediction_probability", "tcell_fraction_comparison", "boundary_dz", "boundary_lz")
ALIASES = {"detect_cells": "cell_type_detection", "classification": "cell_type", "tcell": "tcell_interaction", "dz_lz_boundary": "boundary", "visualization": "umap", "differential": "markers"}
#: What "all" stands for.
ALL = TYPES[:7]


def resolve(types: list[str]) -> list[str]:
    """Types in their fixed order, aliases replaced; unknown names raise."""
    wanted = set()
    for t in types:
        if t == "all":
            wanted |= set(ALL)
        elif (name := ALIASES.get(t, t)) in TYPES:
            wanted.add(name)
        else:
            raise ValueError(f"unknown analysis {t!r}")
    return [t for t in TYPES if t in wanted]


def analyze(
    features: DataFrame, types: list[str], spatial_table: DataFrame | None = None, aicda: DataFrame | None = None, cd3: DataFrame | None = None, mask: DataFrame | None = None, metadata: DataFrame | None = None,
    filter_inside: bool = False, threshold: float = 0.8, seed: int = 1234, pixel_size: float = 0.3225, contact: float = 15.0, signal: float = 30.0, border: float = 0.4, permutations: int = 10_000, folds: int = 10, trees: int = 100,
) -> dict[str, DataFrame]:
    """Results by name. features: ``nuc_id, image`` and numbers; levels: ``nuc_id, image, int_mean``; spatial: ``nuc_id, centroid-0, centroid-1``.

    An analysis whose inputs are absent is left out.
    """
    todo = resolve(types)
    out: dict[str, DataFrame] = {}
    if filter_inside and mask is not None:
        features = frame.filter_inside(features, mask)
    kept, dropped = frame.clean_data(features)
    columns = [c for c in kept if c not in frame.correlated_columns(features, kept, threshold)]
    out["processed_features"] = features.select("nuc_id", "image", *columns)
    typed = features.select("nuc_id", "image", *columns)
    if aicda is not None and cd3 is not None:
        typed = celltype.assign_cell_types(typed, celltype.positive_cells(aicda), celltype.positive_cells(cd3), mask)
        typed = frame.materialized(typed)
        if "cell_type_detection" in todo:
            kinds = [spatial.T_CELL, spatial.DZ, spatial.LZ]
            out["cell_type_counts"] = frame.value_counts(typed, "cell_type")
            out["cell_type_counts_per_image"] = frame.crosstab(typed, "image", "cell_type", kinds)
            if mask is not None:
                out["cell_type_by_gc_status"] = frame.crosstab(typed, "cell_type", "gc_status", ["positive", "negative"])
        b = frame_b(typed)
        if "cell_type" in todo:
            out["feature_statistics"] = frame.describe(typed, columns)
            out |= _classified(b, columns, "cell_type", "classification", folds, seed, trees, *LEAST["cell_type"])
            out["marker_features"] = stats.find_markers(stats.unpivot(b.withColumnRenamed("cell_type", "label"), ["label"], columns))
        if "markers" in todo:
            out["markers_by_celltype"] = stats.find_markers(stats.unpivot(typed.withColumnRenamed("cell_type", "label"), ["label"], columns))
        if spatial_table is not None:
            cells = frame.attach(typed, spatial_table.select("nuc_id", *(F.col(f"`{c}`").alias(n) for c, n in zip(frame.centroid_columns(spatial_table.columns), "yx", strict=True)))).withColumn("id", F.col("nuc_id")).where("y is not null and x is not null")
            out |= _spatial(cells, columns, todo, pixel_size, contact, signal, border, permutations, folds, seed, trees)
    if "umap" in todo:
        kinds = ["cell_type"] if "cell_type" in typed.columns else []
        placed = frame.materialized(ml.embedding(typed, columns).select("nuc_id", "image", *kinds, "e0", "e1"))
        out["embedding"] = ml.clusters(placed, ["e0", "e1"], seed=seed)
    if "correlation" in todo and metadata is not None:
        out |= correlate_metadata(out["processed_features"], columns, metadata, permutations, seed)
    n_before = len(kept) + len(dropped)
    out["analysis_summary"] = out["processed_features"].agg(F.count("*").alias("n_samples"), F.lit(n_before).alias("n_features_before"), F.lit(len(columns)).alias("n_features_after"), F.lit(",".join(todo)).alias("analyses"))
    return out


def frame_b(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("cell_type").isin(spatial.DZ, spatial.LZ))


def _classified(rows: DataFrame, columns: list[str], label: str, name: str, folds: int, seed: int, trees: int, least: int = 100, matched: int = 0) -> dict[str, DataFrame]:
    """Results of a classification; none for fewer than ``least`` rows, fewer than ``matched`` of them with all features, or a single class."""
    whole = reduce(lambda x, y: x & y, (F.col(f"`{c}`").isNotNull() for c in columns), F.lit(True))
    n, k, m = rows.agg(F.count("*"), F.count_distinct(label), F.count_if(whole)).first()
    if n < least or m < matched or k < 2:
        return {}
    cv = ml.cross_validate(rows, columns, label, "nuc_id", folds, seed, True, trees)
    return {f"{name}_results": cv["summary"], f"{name}_predictions": cv["predictions"], f"{name}_importance": cv["importance"], f"{name}_confusion": ml.confusion(cv["predictions"], label, "predicted", True), f"{name}_fold_scores": cv["scores"], f"{name}_mean_confusion": cv["confusion"]}


#: The fewest rows of each classification, and the fewest of those with all features.
LEAST = {"cell_type": (100, 0), "tcell": (101, 0), "tcell_subset": (100, 0), "boundary_lz": (101, 51), "boundary_subset": (100, 50)}
#: The fewest non-interactors, interactors, training and test rows of the probability analysis.
LEAST_PROBABILITY = (100, 50, 50, 50)


def _spatial(cells: DataFrame, columns: list[str], todo: list[str], pixel_size: float, contact: float, signal: float, border: float, permutations: int, folds: int, seed: int, trees: int) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    zoned = frame.materialized(celltype.tcell_influence(cells, contact, signal, pixel_size))
    pair = zoned.where(F.col("influence").isin("T-cell interactors", "Non-T-cell interactors"))
    b = frame_b(pair)
    if "tcell_interaction" in todo:
        out["tcell_influence_counts"] = zoned.groupBy("cell_type", "influence").count()
        out["tcell_distances"] = spatial.class_distance_stats(cells)
        out |= _classified(b, columns, "influence", "tcell_classification", folds, seed, trees, *LEAST["tcell"])
        near = frame.attach(frame_b(zoned), out["tcell_distances"].select(F.col("id").alias("nuc_id"), F.col("mean_distance").alias("target")))
        facets = frame.with_copy(near, "cell_type", "all B-cells").where("target is not null")
        long = stats.unpivot(facets, ["cell_type", "target"], [c for c in ("int_min", "int_mean", "area") if c in columns] or columns[:3])
        long = long.withColumn("feature", F.concat_ws("|", "cell_type", "feature")).select("feature", "value", "target")
        out["tcell_distance_correlations"] = stats.correlations(long).where("n > 50").join(stats.permutation_p(long, permutations, seed), "feature")
    if "markers" in todo:
        out["markers_by_tcell_influence"] = stats.find_markers(stats.unpivot(pair.withColumnRenamed("influence", "label"), ["label"], columns))
    for kind, name in ((spatial.DZ, "dz"), (spatial.LZ, "lz")):
        if f"tcell_interaction_{name}" in todo:
            rows = b.where(F.col("cell_type") == kind)
            out |= _classified(rows, columns, "influence", f"tcell_interaction_{name}", folds, seed, trees, *LEAST["tcell_subset"])
            out[f"tcell_interaction_{name}_markers"] = stats.find_markers(stats.unpivot(rows.withColumnRenamed("influence", "label"), ["label"], columns))
    if "dz_prediction_probability" in todo:
        sizes = b.agg(F.count_if(F.col("influence") == "Non-T-cell interactors"), F.count_if(F.col("influence") == "T-cell interactors")).first()
        train, test = (frame.materialized(x) for x in ml.split_for_probability(b, seed=seed))
        if all(n >= least for n, least in zip((*sizes, train.count(), test.count()), LEAST_PROBABILITY, strict=True)):
            out["prediction_results"] = ml.fit_predict(train, test, columns, "cell_type", spatial.DZ, "nuc_id", seed, trees).select("nuc_id", "cell_type", "influence", "probability", "predicted_positive", "positive_label")
            out["dz_probability_by_group"] = frame.group_mean_std_count(out["prediction_results"], ["cell_type", "influence"], "probability")
    if "tcell_fraction_comparison" in todo:
        out["per_image_statistics"] = celltype.fractions_by_image(zoned)
        sides = stats.unpivot(out["per_image_statistics"], [], ["dz_interactor_fraction", "lz_interactor_fraction"]).select(F.lit("interactor_fraction").alias("f"), F.col("feature").alias("zone"), "value").withColumnRenamed("f", "feature")
        out["fraction_test"] = stats.group_difference(sides, "zone", "dz_interactor_fraction", "lz_interactor_fraction")
    if any(t.startswith("boundary") for t in todo):
        near = spatial.border_proximity(spatial.border_frequency(cells)).withColumnRenamed("id", "nuc_id").drop("image")
        scaled = spatial.border_scaled_distance(cells).select(F.col("id").alias("nuc_id"), "scaled_distance")
        borders = frame.materialized(near.join(scaled, "nuc_id", "left"))
        rows = cells.join(borders, "nuc_id")
        if "boundary" in todo:
            out["border_distances"] = rows.select("nuc_id", "image", "cell_type", "y", "x", "scaled_distance", "frequency_distance", "same_type", "border_proximity")
            out["boundary_differences"] = stats.boundary_differences(stats.unpivot(rows, ["cell_type", "border_proximity"], columns))
            out |= _classified(rows.where(F.col("cell_type") == spatial.LZ), columns, "border_proximity", "boundary_classification_lz", folds, seed, trees, *LEAST["boundary_lz"])
        for kind, name in ((spatial.DZ, "dz"), (spatial.LZ, "lz")):
            if f"boundary_{name}" in todo:
                part = rows.where(F.col("cell_type") == kind)
                out |= _classified(part, columns, "border_proximity", f"boundary_{name}", folds, seed, trees, *LEAST["boundary_subset"])
                out[f"boundary_{name}_markers"] = stats.find_markers(stats.unpivot(part.withColumnRenamed("border_proximity", "label"), ["label"], columns))
    return out


def correlate_metadata(features: DataFrame, columns: list[str], metadata: DataFrame, permutations: int = 10_000, seed: int = 42) -> dict[str, DataFrame]:
    """Image medians of every feature against every numeric column of the image's metadata, and the ten strongest."""
    targets = frame.numeric_columns(metadata, ("image",))
    medians = stats.unpivot(frame.group_medians(features, "image", columns), ["image"], columns)
    long = medians.join(stats.unpivot(metadata, ["image"], targets).select(F.col("image").alias("i"), F.col("feature").alias("of"), F.col("value").alias("target")), F.col("image") == F.col("i"))
    keyed = frame.materialized(long.select(F.concat_ws("|", "of", "feature").alias("feature"), "value", "target"))
    screen = stats.correlation_screen(keyed, permutations, seed).withColumns({"of": F.split("feature", "\\|")[0], "feature": F.split("feature", "\\|")[1]})
    return {"correlation_results": screen, "top_correlations": screen.orderBy("pearson_p_adj", "of", "feature").limit(10)}
