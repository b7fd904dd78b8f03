"""Readers, writers and adapters that present the driver's tables as a
manifest and an access log."""

from tierspark.sources.files import (
    read_manifest, parse_manifest, read_access_log, parse_access_log,
    write_features, read_features, resolve_input, write_table, export_log,
    write_manifest, write_access_log_text,
)
from tierspark.sources.driver_tables import VIEWS, View, load_table

__all__ = [
    "read_manifest", "parse_manifest", "read_access_log", "parse_access_log",
    "write_features", "read_features", "resolve_input", "write_table",
    "export_log", "write_manifest", "write_access_log_text", "VIEWS", "View",
    "load_table",
]
