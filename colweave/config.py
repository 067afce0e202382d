"""One frozen settings object; every field is checked when it is built."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any

# Fixed option values.
IMPUTE_STRATEGIES = ("auto", "interpolate", "median", "knn")
OUTLIER_METHODS = ("iqr", "z_score", "isolation_forest")
OUTLIER_TREATMENTS = ("clip", "winsorize", "none")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
SIMILARITIES = ("correlation", "cosine")


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    results_dir: str = "results"
    random_seed: int = 42
    timestamp_col: str | None = None

    strict_mode: bool = False
    drop_duplicates: bool = True
    drop_redundant_columns: bool = True

    outlier_method: str = "iqr"
    outlier_treatment: str = "clip"
    missing_impute_strategy: str = "auto"
    missing_threshold_drop: float = 0.5
    near_constant_threshold: float = 1e-4
    redundant_correlation_threshold: float = 0.99

    correlation_threshold: float = 0.5
    top_k_neighbors: int = 5
    # The similarity that the top-k graph ranks by.
    top_k_similarity: str = "correlation"
    # Only a drawing option; accepted and without effect on the edges.
    weighted_graph: bool = True
    learnable_epochs: int = 150
    learnable_lr: float = 0.01
    learnable_weight_decay: float = 1e-4

    # Accepted so that existing configurations load; embeddings here are closed
    # form, so epochs, rate, decay and hidden width have no effect.
    gnn_epochs: int = 200
    gnn_lr: float = 0.01
    gnn_hidden_dim: int = 16
    gnn_embedding_dim: int = 8
    gnn_weight_decay: float = 1e-4
    # Leading axes that node features keep.
    node_feature_dim: int = 32

    # Accepted; Spark decides the parallelism.
    multiprocessing: bool = True
    num_workers: int | None = None
    log_level: str = "INFO"

    # Opt out of substring time names for integer columns.
    strict_time_names: bool = False

    def __post_init__(self) -> None:
        problems = []

        def need(ok: bool, text: str) -> None:
            if not ok:
                problems.append(text)

        need(isinstance(self.random_seed, int), "random_seed must be an integer")
        need(self.timestamp_col is None or isinstance(self.timestamp_col, str),
             "timestamp_col must be a string when set")
        for name in ("strict_mode", "drop_duplicates", "drop_redundant_columns"):
            need(isinstance(getattr(self, name), bool), f"{name} must be true or false")
        for name, allowed in (
            ("missing_impute_strategy", IMPUTE_STRATEGIES),
            ("outlier_method", OUTLIER_METHODS),
            ("outlier_treatment", OUTLIER_TREATMENTS),
            ("top_k_similarity", SIMILARITIES),
        ):
            need(getattr(self, name) in allowed, f"{name} must be one of {sorted(allowed)}")
        need(str(self.log_level).upper() in LOG_LEVELS, f"log_level must be one of {sorted(LOG_LEVELS)}")
        for name in ("correlation_threshold", "redundant_correlation_threshold", "missing_threshold_drop"):
            need(0.0 <= getattr(self, name) <= 1.0, f"{name} must be between 0.0 and 1.0")
        for name in ("top_k_neighbors", "learnable_epochs", "learnable_lr", "gnn_epochs",
                     "gnn_lr", "gnn_hidden_dim", "gnn_embedding_dim", "node_feature_dim"):
            need(getattr(self, name) > 0, f"{name} must be positive")
        for name in ("learnable_weight_decay", "gnn_weight_decay", "near_constant_threshold"):
            need(getattr(self, name) >= 0, f"{name} must be non-negative")
        need(self.num_workers is None or self.num_workers > 0, "num_workers must be positive when set")
        if problems:
            raise ValueError("; ".join(problems))

    def replace(self, **changes: Any) -> "Settings":
        return dataclasses.replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> "Settings":
        known = {f.name for f in dataclasses.fields(cls)}
        unknown = [key for key in values if key not in known]
        if unknown:
            raise ValueError(f"Unknown configuration key: {unknown[0]}")
        return cls(**values)

    @classmethod
    def from_yaml(cls, path: str) -> "Settings":
        """Settings from a flat YAML file; needs the optional ``yaml`` module."""
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML settings needs the yaml module; use from_dict") from exc
        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})
