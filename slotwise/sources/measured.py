"""What a query costs while it is written: rows and tokens a second, peak execution memory, CPU time, shuffle and spill."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import tokens


@dataclass(frozen=True)
class Cost:
    """rows and tokens that were written, seconds of wall clock, and of all tasks: the largest peak memory of one, CPU seconds, bytes shuffled and spilled."""

    rows: int
    tokens: int
    seconds: float
    peak_task_bytes: int
    cpu_seconds: float
    shuffle_bytes: int
    spilled_bytes: int

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds > 0 else 0.0

    @property
    def tokens_per_second(self) -> float:
        return self.tokens / self.seconds if self.seconds > 0 else 0.0

    def report(self) -> dict[str, float]:
        return asdict(self) | {"rows_per_second": self.rows_per_second, "tokens_per_second": self.tokens_per_second}


def _write_nowhere(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def measured(df: DataFrame, write: Callable[[DataFrame], None] = _write_nowhere, text_col: str | None = None) -> Cost:
    """Run write(df) and report its cost. Rows and tokens are observed as they pass, so nothing is read twice; text_col: the column whose tokens count.

    What df's plan has already computed and stored costs nothing here. Task figures are of all jobs that this thread
    starts meanwhile; a stage that a retry ran again counts with its last attempt.
    """
    spark, seen, group = df.sparkSession, Observation(), f"measured-{uuid.uuid4().hex}"
    counted = F.coalesce(F.sum(F.size(tokens(F.col(text_col)))), F.lit(0)) if text_col else F.lit(0)
    context = spark.sparkContext
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, "a measured query")
    began = time.perf_counter()
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("rows"), counted.cast("bigint").alias("tokens")))
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)
    seconds = time.perf_counter() - began
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for s in info.stageIds}
    ran = [d for s in stages if (d := store.lastStageAttempt(s)).numCompleteTasks()]
    peaks = [store.taskList(d.stageId(), d.attemptId(), d.numTasks()) for d in ran]
    most = max((t.taskMetrics().get().peakExecutionMemory() for tasks in peaks for t in (tasks.apply(i) for i in range(tasks.size())) if t.taskMetrics().isDefined()), default=0)
    return Cost(seen.get["rows"], seen.get["tokens"], seconds, most, sum(d.executorCpuTime() for d in ran) / 1e9, sum(d.shuffleWriteBytes() for d in ran), sum(d.diskBytesSpilled() for d in ran))
