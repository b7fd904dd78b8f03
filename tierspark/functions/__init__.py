"""Column -> Column helpers (all JVM-side built-ins, no Python UDFs)."""

from tierspark.functions.timefmt import (
    epoch_seconds, parse_iso_epoch, parse_iso_whole_seconds, iso_millis, iso_micros,
)
from tierspark.functions.hashing import uniform01
from tierspark.functions.vectors import min_sq_dist, nearest_index
from tierspark.functions.formatting import centroid_id_text, cluster_name

__all__ = [
    "epoch_seconds", "parse_iso_epoch", "parse_iso_whole_seconds", "iso_millis",
    "iso_micros", "uniform01", "min_sq_dist", "nearest_index", "centroid_id_text",
    "cluster_name",
]
