"""Column expressions."""

from sumtrail.functions.money import amount, net_price

__all__ = ["amount", "net_price"]
