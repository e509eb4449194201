"""Prepare, profile, split, train and compare supervised models on Spark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from modelloom.plans.compare import (  # noqa: E402
    Comparison,
    classification,
    compare,
    regression,
)

__all__ = ["Comparison", "classification", "compare", "regression"]
