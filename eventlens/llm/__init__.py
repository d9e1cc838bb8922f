"""Operators for building training corpora from the ``documents``, ``pages`` and ``embeddings`` tables.

Nothing outside this subpackage imports it."""

import importlib
import pkgutil

from pyspark import cloudpickle

# Task-side helpers travel with the tasks, so executors need not have the package installed.
for _info in pkgutil.iter_modules(__path__):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_info.name}"))
