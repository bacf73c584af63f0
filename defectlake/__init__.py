"""defectlake: structural-inspection analytics expressed as PySpark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
