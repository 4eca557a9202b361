"""Training-data operators.  Nothing else in the library imports this subpackage.

Functions that run in Python workers are pickled by value, so executors need
no copy of this package on their import path.
"""

import importlib.util

from pyspark import cloudpickle

_WORKER_MODULES = (
    "common",
    "topk",
    "secret_scan",
    "toxicity",
    "simhash",
    "copies",
    "nbsvm",
    "suffix",
    "packing",
    "outliers",
)

for _name in (m for m in _WORKER_MODULES if importlib.util.find_spec(f"{__name__}.{m}")):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
