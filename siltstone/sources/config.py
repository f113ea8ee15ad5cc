"""Configuration files (O-11): JSON always, YAML where a parser is installed."""

from __future__ import annotations

import json
import os
import warnings
from pathlib import Path

#: Keys that configurations may hold and no operator reads.
UNREAD = ("exclude_filename_patterns", "exclude_path_patterns", "keep_config_patterns", "min_stars", "language_weights", "min_content_density", "min_math_density", "boilerplate_patterns", "cross_dedup_with_stack", "cross_dataset", "algorithm", "allow_partial", "num_workers", "batch_size", "checkpoint_every_n_samples")


def find(name: str, root: str | Path = ".") -> Path:
    """The first that exists of: the name as it is, under the root, under its configs folder, and there by its last part."""
    root = Path(root)
    tried = [Path(name), root / name, root / "configs" / name, root / "configs" / Path(name).name]
    for path in tried:
        if path.is_file():
            return path
    raise FileNotFoundError(f"{name} is not among {', '.join(map(str, tried))}")


def parse(path: Path) -> dict:
    if path.suffix == ".json":
        return json.loads(path.read_text())
    try:
        import yaml
    except ImportError as error:
        raise ImportError(f"{path} needs a YAML parser, which is not installed; JSON works without") from error
    return yaml.safe_load(path.read_text())


def check_proportions(datasets: dict[str, dict], tolerance: float = 0.01) -> None:
    total = sum(d.get("target_proportion", 0) for d in datasets.values())
    if abs(total - 1.0) > tolerance:
        raise ValueError(f"proportions sum to {total:.3f}, not 1")


def unread_keys(config: dict) -> list[str]:
    """Keys at any depth that no operator reads."""
    out = []
    for key, value in config.items():
        if key in UNREAD:
            out.append(key)
        elif isinstance(value, dict):
            out += unread_keys(value)
    return out


def load_dataset_config(name: str, root: str | Path = ".") -> dict:
    config = parse(find(name, root))
    check_proportions(config.get("datasets", {}))
    if ignored := unread_keys(config):
        warnings.warn(f"keys without effect: {', '.join(sorted(set(ignored)))}", stacklevel=2)
    return config


def environment() -> str:
    """Where the engine runs: the master's kind as the environment states it, `local` without."""
    return os.environ.get("SPARK_MASTER", "local").split(":")[0].split("[")[0]


def resolved_paths(config: dict, root: str | Path, env: str | None = None) -> dict:
    """A configuration with the output folder and, where it states none, the folder of processed data.

    Both lie under the place that `storage.<env>` names (mount_path or output_dir, with checkpoint_dir and data_dir),
    else under the root.
    """
    storage = config.get("storage", {})
    place = storage.get(env or environment(), {})
    base = place.get("mount_path") or place.get("output_dir")
    output = os.path.join(base, place.get("checkpoint_dir", "checkpoints")) if base else str(Path(root) / "checkpoints" / "cpt")
    data = os.path.join(base, place.get("data_dir", "data")) if base else str(Path(root) / "data" / "processed")
    processed = storage.get("processed_data", {})
    return config | {"training": config.get("training", {}) | {"output_dir": output}, "storage": storage | {"processed_data": processed | {"path": processed.get("path") or data}}}


def load_config(name: str, root: str | Path = ".", env: str | None = None) -> dict:
    """A configuration with `environments.<env>` merged into its `training` part."""
    config = parse(find(name, root))
    override = config.get("environments", {}).get(env or environment(), {})
    return config | {"training": config.get("training", {}) | override}
