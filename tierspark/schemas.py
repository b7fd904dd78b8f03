"""Schemas, feature names and the category rule set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Manifest as written by the file generator: every column is text.
MANIFEST_TEXT = T.StructType([
    T.StructField("path", T.StringType(), True),
    T.StructField("creation_ts", T.StringType(), True),
    T.StructField("primary_node", T.StringType(), True),
    T.StructField("size_bytes", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
])

# Access log: headerless CSV, bound by position.
ACCESS_LOG_TEXT = T.StructType([
    T.StructField("ts_iso", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("op", T.StringType(), True),
    T.StructField("client_node", T.StringType(), True),
    T.StructField("pid", T.StringType(), True),
])

# Raw features, in output order.
FEATURES = ["access_freq", "age_seconds", "write_ratio", "locality", "concurrency"]

# Normalised features: the clustering space, in this fixed order.
NORM_FEATURES = [
    "access_freq_norm",
    "age_norm",
    "write_ratio_norm",
    "locality_norm",
    "concurrency_norm",
]
NORM_OF = dict(zip(FEATURES, NORM_FEATURES))

FEATURE_TABLE = T.StructType(
    [T.StructField("path", T.StringType(), True),
     T.StructField("access_freq", T.LongType(), True),
     T.StructField("age_seconds", T.DoubleType(), True),
     T.StructField("write_ratio", T.DoubleType(), True),
     T.StructField("locality", T.DoubleType(), True),
     T.StructField("concurrency", T.LongType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in NORM_FEATURES]
)


@dataclass(frozen=True)
class Rules:
    """Category rule set: per-feature global medians, per-category weights and
    expected directions (+1, -1, 0), replication factors for tie-breaking and
    the category order (earlier wins a tie on score and replication factor).

    ``moderate`` names the category scored by closeness to the global median
    (|delta| < ``moderate_band``) instead of by direction.
    """

    features: tuple
    global_medians: dict
    weights: dict
    directions: dict
    replication_factors: dict
    categories: tuple
    moderate: str = "Moderate"
    moderate_band: float = 0.1

    def to_dict(self) -> dict:
        return {"features": list(self.features), "global_medians": dict(self.global_medians),
                "weights": {c: dict(v) for c, v in self.weights.items()},
                "directions": {c: dict(v) for c, v in self.directions.items()},
                "replication_factors": dict(self.replication_factors),
                "categories": list(self.categories), "moderate": self.moderate,
                "moderate_band": self.moderate_band}

    @classmethod
    def from_dict(cls, d: dict) -> "Rules":
        """Rule set from a mapping (e.g. parsed JSON); missing keys keep the
        default rule set's values."""
        base = DEFAULT_RULES.to_dict()
        base.update(d)
        return cls(tuple(base["features"]), dict(base["global_medians"]),
                   {c: dict(v) for c, v in base["weights"].items()},
                   {c: {f: int(x) for f, x in v.items()} for c, v in base["directions"].items()},
                   {c: int(v) for c, v in base["replication_factors"].items()},
                   tuple(base["categories"]), base["moderate"],
                   float(base["moderate_band"])).validate()

    def validate(self) -> "Rules":
        for cat in self.categories:
            for f in self.features:
                if f not in self.weights[cat] or f not in self.directions[cat]:
                    raise ValueError(f"rule for category {cat!r} lacks feature {f!r}")
            if cat not in self.replication_factors:
                raise ValueError(f"no replication factor for {cat!r}")
        return self


# --- fixed values (must equal the reference's rule configuration) ---------------
# Category order; weights and directions per category, features in the order of
# NORM_FEATURES; replication factors. Global medians are 0.5 and the Moderate band is
# |delta| < 0.1.
CATEGORIES = ("Hot", "Shared", "Moderate", "Archival")
_W = {
    "Hot": (1.0, 0.8, 0.5, 0.5, 1.0),
    "Shared": (0.7, 0.2, 1.0, 0.2, 0.5),
    "Moderate": (0.5, 0.5, 0.5, 0.5, 0.5),
    "Archival": (0.1, 1.0, 0.1, 0.5, 0.1),
}
_D = {
    "Hot": (1, -1, 1, 1, 1),
    "Shared": (1, 1, 1, 1, 1),
    "Moderate": (0, 0, 0, 0, 0),
    "Archival": (-1, 1, -1, -1, -1),
}
_RF = {"Hot": 3, "Shared": 2, "Moderate": 1, "Archival": 4}
# ---------------------------------------------------------------------------------

DEFAULT_RULES = Rules(
    features=tuple(NORM_FEATURES),
    global_medians={f: 0.5 for f in NORM_FEATURES},
    weights={c: dict(zip(NORM_FEATURES, _W[c])) for c in CATEGORIES},
    directions={c: dict(zip(NORM_FEATURES, _D[c])) for c in CATEGORIES},
    replication_factors=dict(_RF),
    categories=CATEGORIES,
).validate()
