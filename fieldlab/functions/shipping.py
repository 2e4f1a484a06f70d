"""Task functions that travel inside the job."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Functions of the module are sent by value, so executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)
