"""Values for all tasks, in a form that needs no installed package on executors."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast ``value`` as bytes that hold its class; call the result inside tasks.

    A broadcast object of a class of this package would name its module instead. The list
    around the bytes is kept by a worker between its tasks, so it loads them once."""
    held = spark.sparkContext.broadcast([cloudpickle.dumps(value)])

    def load() -> Any:
        kept = held.value
        if len(kept) == 1:
            kept.append(pickle.loads(kept[0]))
        return kept[1]

    return load
