"""viewscope: Spark-native analytics over a table of published content items.

Every operator is a plain function from DataFrame (plus parameters) to a lazy
DataFrame. Nothing is collected to the driver except one-row audit results and
model parameters whose size does not grow with the data.
"""

from viewscope.schema import Filters

__all__ = ["Filters"]
