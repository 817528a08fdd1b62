"""Table access: Parquet scans, CSV, JSON lines, optional sources."""

from creditweave.sources.tables import exists, load, load_optional

__all__ = ["exists", "load", "load_optional"]
