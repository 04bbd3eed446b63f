"""keelson: tabular and small-image classification operators on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames. Fitted state (means,
code tables, weights) is itself a small DataFrame or a bounded set of numbers,
so fitting on one split and applying to another are separate steps.
"""

__version__ = "0.1.0"
