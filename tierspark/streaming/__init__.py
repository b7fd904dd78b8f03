"""Structured Streaming twin of the log aggregation (optional extension)."""

from tierspark.streaming.log_stream import (features_from_buckets, read_log_stream,
                                            start_bucket_sink)

__all__ = ["read_log_stream", "start_bucket_sink", "features_from_buckets"]
