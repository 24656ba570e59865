"""Configuration of a run: nested mappings in YAML."""

from __future__ import annotations

import copy

import yaml

REQUIRED = ("dataset_name", "preprocessing", "segmentation")
_DEFAULT = {
    "dataset_name": "dataset1",
    "preprocessing": {"channels": {"dapi": 1, "cd3": 2, "aicda": 3}, "quantiles": [0.01, 0.998]},
    "segmentation": {"prob_thresh": 0.43, "use_pretrained": True, "model_dir": "models", "model_name": "DAPI_segmentation"},
    "feature_extraction": {"dilation_radius": 10, "extract_spatial": True},
    "analysis": {"types": ["cell_type"], "correlation_threshold": 0.8, "random_seed": 1234, "pixel_size": 0.3225, "contact_radius": 15.0, "signaling_radius": 30.0, "border_threshold": 0.4, "n_permutations": 10_000},
}


def default_config(name: str = "dataset1") -> dict:
    return copy.deepcopy(_DEFAULT) | {"dataset_name": name}


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    if missing := [k for k in REQUIRED if k not in config]:
        raise ValueError(f"configuration without {', '.join(missing)}")
    return config


def save_config(config: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, sort_keys=False)
