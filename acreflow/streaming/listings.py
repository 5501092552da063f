"""Streams of scraper runs and listings: alerts, upserts, work batches, limits, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from acreflow.operators import relational
from acreflow.operators.storage import materialize


def alerts(runs: DataFrame, history: DataFrame) -> DataFrame:
    """source, alert of a stream of runs against a table of earlier ones (a stream-static join)."""
    return relational.anomalies(runs, history)


def upsert_batches(path: str, key: str, update: list[str], last: str | None = None, buckets: int = 64):
    """A foreachBatch function that puts each batch into a table of buckets by key's hash.

    Only the buckets that the batch touches are read and written.  Of a
    batch's rows with one key the greatest by column ``last``, then by all
    columns, stands, so a batch that runs again writes the same rows.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        one = relational.one_each(batch, key, last)
        touched = [r[0] for r in one.select(bucket).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        try:
            old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
        except AnalysisException:
            old = spark.createDataFrame([], batch.schema)
        after = materialize(relational.upsert(old.select(*batch.columns), one, key, update).withColumn("bucket", bucket))
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return put


def on_tick(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 minute"):
    """A query that runs a batch at each tick, or once over all there is if ``every`` is None; one batch ends before the next begins."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Progress(StreamingQueryListener):
    """Counts of the batches and rows of queries by name, for those who ask; register with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.batches[name] = self.batches.get(name, 0) + 1
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(self._names.get(str(event.id), str(event.id)))


def first_seen(requests: DataFrame, key: str, at: str, lateness: str = "1 hour") -> DataFrame:
    """Requests whose key was not seen within the lateness."""
    return requests.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def _limit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, most: int, seconds: float) -> Iterator[pd.DataFrame]:
    begin, n = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches), ignore_index=True).sort_values("at", kind="stable")
    allowed = []
    for at in rows["at"]:
        now = at.timestamp()
        if begin is None or now > begin + seconds:
            begin, n = now, 0
        n += 1
        allowed.append(n <= most)
    state.update((begin, n))
    yield pd.DataFrame({"client": [key[0]] * len(rows), "at": rows["at"], "allowed": allowed})


def limited(requests: DataFrame, most: int, seconds: float) -> DataFrame:
    """client, at, allowed of requests (client, at): at most ``most`` in a window that begins with a
    client's first request and begins anew with the first one after it."""

    def run(key, batches, state):
        yield from _limit(key, batches, state, most, seconds)

    return requests.select("client", "at").groupBy("client").applyInPandasWithState(run, "client string, at timestamp, allowed boolean", "begin double, n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Counts by window and kind, closed once the watermark has passed."""
    counted = events.withWatermark(at, lateness).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), by, "n")


def work_batches(handle: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], retries: int = 2):
    """A foreachBatch function of a work queue of rows (id, priority, ...).

    An id is taken once, at its highest priority; high, normal and low ones go
    one after the other.  ``handle`` gives id and ok; rows not ok are handled
    again up to ``retries`` times; ``write`` gets id, status, attempts.
    """

    def level(rows: DataFrame) -> None:
        for attempt in range(1, retries + 2):
            done = handle(rows).select("id", "ok").persist()
            ends = F.col("ok") | F.lit(attempt > retries)
            write(done.filter(ends).select("id", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"), F.lit(attempt).alias("attempts")))
            again = materialize(done.filter(~ends))
            done.unpersist()
            if again.isEmpty():
                return
            rows = rows.join(again, "id", "left_semi")

    def run(batch: DataFrame, batch_id: int) -> None:
        rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).otherwise(2)
        others = [c for c in batch.columns if c != "id"]
        once = batch.withColumn("__rank", rank).groupBy("id").agg(F.min(F.struct("__rank", *others)).alias("r")).select("id", "r.*")
        for wanted in range(3):
            level(once.filter(F.col("__rank") == wanted).drop("__rank"))

    return run
