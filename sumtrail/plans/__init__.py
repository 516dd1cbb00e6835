"""Queries built from the other packages."""

from sumtrail.plans.revenue import nation_revenue

__all__ = ["nation_revenue"]
