"""fairlease — Spark-native lease-deposit valuation and risk operators.

Every public operator takes DataFrames and returns a DataFrame; the heavy
lifting is left to Catalyst (pushdown, pruning, join choice) and AQE.
"""

__version__ = "0.1.0"
