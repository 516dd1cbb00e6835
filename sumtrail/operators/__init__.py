"""Reusable DataFrame transformations."""

from sumtrail.operators.totals import join_totals

__all__ = ["join_totals"]
