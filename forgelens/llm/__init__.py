"""Operators of a training-data pipeline; nothing outside this subpackage imports it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in tasks are shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
