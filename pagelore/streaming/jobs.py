"""Jobs that carry state from page to page.

A job's pages arrive in any order and any number of batches. Each one adds to the job's state; when as many pages were seen as the job has, the
result is given out and the state goes. A job whose next page doesn't come within ``patience`` of event time is abandoned: a timer fires, what
there is goes, and a row says so. Pages that come after either are a new job's."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "doc_id bigint, outcome string, pages bigint, chars bigint"


class PageJob(StatefulProcessor):
    """State of a job: pages seen, characters, pages in all."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "seen bigint, chars bigint, total bigint")

    def _forget(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, chars, total = self.job.get() if self.job.exists() else (0, 0, 0)
        last = 0
        for batch in rows:
            seen += len(batch)
            chars += int(batch["chars"].sum())
            total = max(total, int(batch["total"].max()))
            last = max(last, int(batch["at"].max().timestamp() * 1000))
        self._forget()
        if seen >= total:
            self.job.clear()
            yield pd.DataFrame([(key[0], "finished", seen, chars)], columns=["doc_id", "outcome", "pages", "chars"])
            return
        self.job.update((int(seen), int(chars), int(total)))
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.job.exists():
            return
        seen, chars, _ = self.job.get()
        self.job.clear()
        yield pd.DataFrame([(key[0], "abandoned", seen, chars)], columns=["doc_id", "outcome", "pages", "chars"])

    def close(self) -> None:
        pass


def page_jobs(pages: DataFrame, late: str, patience_ms: int) -> DataFrame:
    """A stream of pages (doc_id, total, chars, at: a time) as job results."""
    return pages.withWatermark("at", late).groupBy("doc_id").transformWithStateInPandas(PageJob(patience_ms), RESULT, "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS) -> Iterator[None]:
    """State with timers needs this store; what was set before is set again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
