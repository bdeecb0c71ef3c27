"""lorekeep: Spark operators that keep a large document corpus and its catalogs in order.

Every operator takes DataFrames and returns a DataFrame. Sinks are separate
calls, so each write can be looked at as a plan first.
"""

__version__ = "0.1.0"
