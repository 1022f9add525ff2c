"""basketlens: commerce analytics (orders, customers, click-stream) on Spark.

Every operator takes DataFrames and returns a DataFrame built from native Spark
SQL expressions. Some run jobs while the result is built (shared intermediates,
snapshots); what reaches the driver is of fixed size (sums, at most 1,000 heavy
keys).
"""

import sys as _sys

__version__ = "0.1.0"

# Functions of the subpackages that run on executors are shipped by value, so
# executors do not need this package installed or on their path.
try:  # pragma: no cover - depends on the Spark build
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
