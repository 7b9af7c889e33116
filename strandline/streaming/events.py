"""Structured Streaming over fetch events: counts in windows, host sessions, resumable crawls, retries with state.

Each transformation takes a DataFrame, streaming or not, so that the stream and the batch share one plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Event files as a stream; ts as a timestamp, as watermarks need one."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """Events and their summed value for each tumbling window and type."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = LATE) -> DataFrame:
    """Sessions of each user: events with no gap of that length."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_seen(events: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """Rows whose key has not come before: a crawl resumed from its checkpoint fetches nothing twice.

    A key is kept for good, in the state store (RocksDB, on disk, where the session is set so). With `late`, a key is forgotten
    once the watermark has passed it by that time, for streams whose repeats come close together."""
    if events.isStreaming and late:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


def attempts(events: DataFrame, most: int = 3, wait: str = "1 minute", late: str = LATE, idle: str = "30 days") -> DataFrame:
    """A running count of errors for each user, whether its next attempt is allowed, and from when: the wait doubles with
    each error. Events later than the watermark (`late`) are dropped by the engine and not counted. State is two numbers a key, and goes once the watermark is `idle` beyond the key's last event."""
    first, rest = pd.Timedelta(wait), pd.Timedelta(idle)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        errors, last = state.get if state.exists else (0, 0)
        for batch in batches:
            errors += int((batch["event_type"] == "error").sum())
            last = max(last, micros(batch["ts"].max()))
        state.update((errors, last))
        state.setTimeoutTimestamp(max(last // 1000 + rest // pd.Timedelta("1ms"), state.getCurrentWatermarkMs() + 1))
        delay = first * 2 ** (min(errors, 20) - 1) if errors else pd.Timedelta(0)
        yield pd.DataFrame({"user_id": [key[0]], "errors": [errors], "may_retry": [errors < most], "retry_at": [pd.Timestamp(last, unit="us") + delay]})

    kept = events.withWatermark("ts", late).select("user_id", "event_type", "ts")
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id long, errors int, may_retry boolean, retry_at timestamp", "errors int, last long", "update", GroupStateTimeout.EventTimeTimeout)


def deadlines(events: DataFrame, limit: str = "12 hours", late: str = LATE) -> DataFrame:
    """A row for each time that a user gave no event for `limit`: when that was up, and how many events came before it.

    A row comes when the watermark has passed its deadline, by a timer or with a later batch; until then an event that is
    late, but within `late`, may still come between, so rows don't depend on how events are dealt into batches. State is the
    key's runs of events (first, last, number) whose deadlines are ahead of the watermark, and ends with the last of them."""
    gap = pd.Timedelta(limit)
    width = gap.value // 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            runs += [(t, t, 1) for t in (micros(t) for batch in batches for t in batch["ts"])]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted(runs):
            if merged and first - merged[-1][1] < width:
                merged[-1] = (merged[-1][0], max(last, merged[-1][1]), merged[-1][2] + n)
            else:
                merged.append((first, last, n))
        passed = state.getCurrentWatermarkMs()
        out = [r for r in merged if (r[1] + width) // 1000 < passed]
        rest = merged[len(out) :]
        if rest:
            state.update(tuple([r[k] for r in rest] for k in range(3)))
            state.setTimeoutTimestamp(max((rest[0][1] + width) // 1000, passed + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "deadline": [pd.Timestamp(t, unit="us") + gap for _, t, _ in out], "events": [c for *_, c in out]})

    kept = events.withWatermark("ts", late).select("user_id", "ts")
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id long, deadline timestamp, events int", "firsts array<long>, lasts array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def identical_stop(steps: DataFrame, by: str, order: str, fingerprint: str, stop: int = 3) -> DataFrame:
    """A row for each key whose last `stop` fingerprints or more were equal, as of each batch: the crawl of that key is to end.

    State is the last fingerprint, its place and its streak; a step at or before the last place is a repeat of one seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, place, streak, ended = state.get if state.exists else (None, None, 0, False)
        rows = pd.concat(list(batches)).sort_values(order)
        for at, value in zip(rows[order], rows[fingerprint], strict=True):
            if place is not None and at <= place:
                continue
            streak = streak + 1 if place is not None and value == last else 1
            last, place = value, int(at)
            ended = ended or streak >= stop
        state.update((last, place, streak, ended))
        yield pd.DataFrame({by: [key[0]], "streak": [streak], "loop_detected": [ended]})

    return steps.select(by, order, fingerprint).groupBy(by).applyInPandasWithState(step, f"`{by}` long, streak int, loop_detected boolean", "last string, place long, streak int, ended boolean", "update", GroupStateTimeout.NoTimeout)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def add_new(rows: DataFrame, path: str, keys: list[str], version: str | int) -> None:
    """Adds the rows whose keys the table at path lacks, in a folder named by the version, which a repeated write replaces.

    One writer at a time: that of a stream's query, or a task's owner. Only the key columns of the table are read."""
    spark, new = rows.sparkSession, rows.dropDuplicates(keys)
    if exists(spark, path):
        mine = F.col("version") == str(version)
        old = spark.read.option("mergeSchema", False).schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.select(*keys).schema)}, version string").parquet(path)
        new = new.join(old.filter(~mine).select(*keys), keys, "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/version={version}")


def upsert_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A query that adds rows whose keys the table at path lacks. A batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        add_new(batch, path, keys, f"batch-{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The stream's result once all that is there has been read; for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
