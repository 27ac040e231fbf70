"""Send the package's own functions with the task, so that executors need no copy of the package."""
from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
