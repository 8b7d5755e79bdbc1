"""crivo: feature screening for large categorical tables, on Spark DataFrames.

Reads many files whose columns drift, cleans and encodes them, and ranks every
feature by its association with a target.
"""

__version__ = "0.1.0"
