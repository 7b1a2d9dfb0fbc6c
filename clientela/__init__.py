"""Retail customer analytics as PySpark DataFrame programs.

Every product is a function from a :class:`~clientela.operators.ledger.Ledger`
(customers, sales, items, payments) and plain parameters to a DataFrame.
"""

from clientela.operators.ledger import Ledger
from clientela.params import Bounds, Channel, Period, Rules

__all__ = ["Bounds", "Channel", "Ledger", "Period", "Rules"]
