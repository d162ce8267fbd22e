"""Counts and timings of runs, taken while the run goes on anyway."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows with metrics (a row count by default) collected by the action that reads them."""
    observation = Observation(name)
    wanted = metrics or {"n_rows": F.count(F.lit(1))}
    return df.observe(observation, *[column.alias(key) for key, column in wanted.items()]), observation


class Timings:
    """Wall-clock seconds of driver functions, by function name."""

    def __init__(self):
        self.seconds: dict[str, list[float]] = defaultdict(list)

    def measure(self, fn: Callable) -> Callable:
        @wraps(fn)
        def run(*args, **kwargs):
            started = time.perf_counter()
            try:
                return fn(*args, **kwargs)
            finally:
                self.seconds[fn.__name__].append(time.perf_counter() - started)

        return run

    def summary(self) -> dict[str, dict[str, float]]:
        return {
            name: {"calls": len(taken), "total": sum(taken), "mean": sum(taken) / len(taken)}
            for name, taken in self.seconds.items()
        }
