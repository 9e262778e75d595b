"""corpusmill: a Spark-native engine for preparing and evaluating corpora of
paired code text (assembly and C source)."""

import sys as _sys

try:  # ship helper functions used inside Python UDFs by value, so executors
    # need no installed copy of this package
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
