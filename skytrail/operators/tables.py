"""Table functions and functions that are chosen by name."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="pose int, x double, y double, z double, yaw double")
class DescentPoses:
    """SELECT * FROM marks, LATERAL descent_poses(x, y, high, low, step): poses straight down to a landmark."""

    def eval(self, x: float, y: float, high: float, low: float, step: float) -> Iterator[tuple]:
        if None in (x, y, high, low, step) or step <= 0:
            return
        n = int(math.floor((high - low) / step))
        for i in range(n + 1):
            yield i, x, y, high - i * step, 0.0
        if high - low - n * step > 1e-4:
            yield n + 1, x, y, low, 0.0


def register(spark: SparkSession) -> None:
    spark.udtf.register("descent_poses", DescentPoses)


Distance = Callable[[list[Column], list[Column]], Column]
DISTANCES: dict[str, Distance] = {
    "euclid": lambda a, b: F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))),
    "plane": lambda a, b: F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[:2], b[:2], strict=True)), F.lit(0.0))),
    "city": lambda a, b: sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)),
}


def distance_by_name(name: str) -> Distance:
    """A distance that is chosen at run time; a function of the caller's own is a pandas_udf in its place."""
    if name not in DISTANCES:
        raise KeyError(f"no distance {name!r}; there are {', '.join(sorted(DISTANCES))}")
    return DISTANCES[name]


def with_error(value: Callable[[pd.Series], float], missing: float = math.nan) -> Callable[[pd.Series], tuple[float, str | None]]:
    """A kernel that gives (value, error): what it raises becomes the missing value and its text."""

    def run(x: pd.Series) -> tuple[float, str | None]:
        try:
            return float(value(x)), None
        except (ArithmeticError, LookupError, TypeError, ValueError) as e:
            return missing, f"{type(e).__name__}: {e}"

    return run


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df with a count of its rows, and of those that meet each condition, as the job that runs it goes
    along; `get` of the second waits for that job.  No pass of its own over the data."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]), seen
