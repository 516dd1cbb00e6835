"""Readers for the input tables."""

from sumtrail.sources.tables import read_table

__all__ = ["read_table"]
