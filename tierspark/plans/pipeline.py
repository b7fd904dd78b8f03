"""Whole pipeline: manifest + access log -> features -> clusters -> categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tierspark.plans.classification_job import ClassificationRun, classify_files
from tierspark.plans.feature_job import FeatureRun, compute_features
from tierspark.schemas import DEFAULT_RULES, Rules


@dataclass
class TieringRun:
    features: FeatureRun
    classes: ClassificationRun

    @property
    def table(self) -> DataFrame:
        return self.classes.table

    @property
    def files(self) -> DataFrame:
        return self.classes.files

    def close(self) -> None:
        """Delete what the run wrote to the shared folder; read the results first."""
        self.classes.close()
        self.features.close()


def run_tiering(manifest: DataFrame, log: DataFrame, width: float = 1.0, k: int = 4,
                rules: Rules = DEFAULT_RULES, seed: int = 42, tol: float = 1e-4,
                observation_end: float | None = None, medians_from: str = "rules") -> TieringRun:
    """Features, then classification. The per-path table is written once by the
    feature step; the points are a projection of it, so they are only persisted
    (not written again) for the clustering passes."""
    feats = compute_features(manifest, log, width, observation_end=observation_end)
    classes = classify_files(feats.features, k, rules, seed=seed, tol=tol,
                             medians_from=medians_from, cut_lineage=False)
    return TieringRun(feats, classes)
