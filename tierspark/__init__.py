"""Storage-tiering analytics on Spark.

Turns a file manifest and a file access log into per-file features, groups the
files with k-means++ / Lloyd clustering expressed as DataFrame jobs, scores the
clusters against storage categories and writes a centroid/category table.
Every public function takes and returns Spark DataFrames.
"""

from tierspark.schemas import FEATURES, NORM_FEATURES, Rules, DEFAULT_RULES

__all__ = ["FEATURES", "NORM_FEATURES", "Rules", "DEFAULT_RULES"]
