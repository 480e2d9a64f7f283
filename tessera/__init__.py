"""tessera — Spark-native operators for tabular-experiment data work.

Every operator is a plain function ``f(df, ...) -> DataFrame`` that only
builds a lazy plan; Catalyst/AQE choose the physical strategy.
"""

import sys

from pyspark import cloudpickle

from tessera.session import get_spark, shared_dir

# Workers need no copy of the package on their path: what a UDF uses travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "shared_dir"]
