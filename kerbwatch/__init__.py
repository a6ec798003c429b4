"""Zone and time-window analytics over geo-located enforcement records, on Spark."""

from kerbwatch.config import Settings

__all__ = ["Settings"]
