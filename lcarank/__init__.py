"""lcarank — employer allowlist, posting-to-employer resolution and resume-fit ranking on Spark.

Everything is a DataFrame transformation; see README.md for the operator map.
"""

import sys as _sys

try:  # ship the two pandas UDFs by value, so executors need not have this package installed
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: rely on --py-files instead
    pass
