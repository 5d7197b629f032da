"""riskloom: workforce-risk analytics as Spark jobs.

The package registers itself for by-value pickling, so the functions and classes that
executor-side code uses (the contribution kernel inside ``mapInPandas``) travel with the
task closure: executors need no copy of this package installed.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with spark.submit.pyFiles instead
    pass
