"""What each task of a fit of many short jobs does first."""

from __future__ import annotations

import gc
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANY = 20_000   # objects that a worker would visit after every task


def settle() -> None:
    """Keep what this Python worker has imported out of its later garbage collections.

    Spark has a worker collect all garbage after each task, before it takes the next one. That
    visits each object of the imported libraries, which here took as long as a short pass.
    """
    if len(gc.get_objects(2)) > MANY:
        gc.freeze()
