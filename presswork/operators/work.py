"""Work queues, breakers and caches (X7-X9): retries of tasks, a stop after failures in a row, results that live for a while."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_retries(tasks: DataFrame, works: Callable[[Column], Column], most: int = 3) -> DataFrame:
    """tasks with attempts and done: a task goes back to the queue until it works or `most` attempts are used up.

    works: from the number of the attempt to whether it works. Workers need no say: Spark deals tasks to executors, and
    what an executor loses is run again.
    """
    tries = F.sequence(F.lit(1), F.lit(most))
    first = F.get(F.filter(tries, works), F.lit(0))
    return tasks.withColumn("attempts", F.coalesce(first, F.lit(most))).withColumn("done", first.isNotNull())


def broken_off(calls: DataFrame, key: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """calls with status processed, failed or skipped: after `most` failures in a row a key's later calls are skipped."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = calls.withColumn("_failed", failed.cast("int")).withColumn("_good", F.sum(1 - F.col("_failed")).over(upto))
    in_run = F.sum("_failed").over(Window.partitionBy(key, "_good").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tripped = run.withColumn("_run", F.when(F.col("_failed") == 1, in_run).otherwise(0)).withColumn("_open", F.coalesce(F.max((F.col("_run") >= most).cast("int")).over(before), F.lit(0)))
    status = F.when(F.col("_open") == 1, "skipped").when(F.col("_failed") == 1, "failed").otherwise("processed")
    return tripped.withColumn("status", status).drop("_failed", "_good", "_run", "_open")


class ResultCache:
    """Results of queries that are kept for `seconds` and then asked for anew (X7). make gives a DataFrame, which is persisted."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock = seconds, clock
        self.kept: dict[object, tuple[float, DataFrame]] = {}

    def get(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        if key not in self.kept or now - self.kept[key][0] >= self.seconds:
            self.drop(key)
            self.kept[key] = now, make().persist()
        return self.kept[key][1]

    def drop(self, key: object) -> None:
        if key in self.kept:
            self.kept.pop(key)[1].unpersist()
