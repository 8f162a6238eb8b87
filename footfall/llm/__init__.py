"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. Its functions travel to the
executors by value, so a cluster needs no copy of the package on its machines.
"""

import importlib

from pyspark import cloudpickle

MODULES = (
    "common",
    "bpe",
    "packing",
    "rules",
    "neighbours",
    "simhash",
    "forest",
    "suffixes",
    "pii",
    "chat",
    "licences",
    "negatives",
    "idstore",
    "whitening",
)

for _name in MODULES:
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
