"""Make Python code that runs inside tasks independent of the workers' import path."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Send a module's functions and classes by value, so that workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)  # modules that are sent whole hold this function
