"""Structured Streaming jobs over the same contracts.

Watermarks need a zoned event time, while contracts carry wall-clock (NTZ) stamps.
``event_time`` reads the wall clock as if it were UTC and ``wall_clock`` undoes
exactly that, so results do not depend on the session time zone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pitrank.functions.clock import PREMARKET_CUTOFF_MINUTES, decision_time
from pitrank.operators.monitor import KILL_WINDOW_DAYS, STOP_DRIFT_HITS, STOP_WINDOW_DAYS
from pitrank.session import scratch_path


def event_time(ts: str) -> Column:
    return F.to_timestamp_ltz(F.concat(F.col(ts).cast("string"), F.lit("Z")))


def wall_clock(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def minute_bars(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One-minute OHLCV from (ts, ticker, price, size, seq); a bar is emitted once its minute is sealed.

    A tick without ticker (an end mark, see ``run_to_end``) moves the watermark and is in no bar.
    """
    timed = ticks.withColumn("_t", event_time("ts")).withWatermark("_t", delay)
    order = F.struct("ts", "seq")
    bars = timed.groupBy(F.window("_t", "1 minute"), "ticker").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
        F.count("ticker").cast("double").alias("trade_count"),
    )
    # On an aggregate, not on the ticker: the optimizer would move that below the watermark.
    bars = bars.where("trade_count > 0")
    minute = wall_clock(F.col("window.start"))
    return bars.select(
        F.to_date(minute).alias("trade_date"), "ticker", minute.alias("minute"), "open", "high", "low", "close",
        "volume", "trade_count", minute.alias("as_of"),
    )


def premarket_totals(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Premarket accumulators per (date, ticker), emitted once 09:25 has passed; later events never enter.

    The day window runs from 09:25 to 09:25, so append mode seals a date exactly at
    the decision time.  The cut-off filter comes after the watermark: later ticks
    must still advance it.
    """
    timed = ticks.withColumn("_t", event_time("ts")).withWatermark("_t", delay)
    # Phrased on the event-time column: the optimizer would move a filter on
    # any other column below the watermark, and late-day ticks could not close the window.
    clock = wall_clock(F.col("_t"))
    minute_of_day = F.hour(clock) * 60 + F.minute(clock)
    early = timed.where(minute_of_day < PREMARKET_CUTOFF_MINUTES)
    money = (F.col("price") * F.col("size")).cast("decimal(28,6)")
    day = F.window("_t", "24 hours", "24 hours", f"{PREMARKET_CUTOFF_MINUTES} minutes")
    sums = early.groupBy(day, "ticker").agg(
        F.max_by("price", F.struct("ts", "seq")).alias("last_price"),
        F.max("price").alias("high_price"),
        F.sum("size").alias("total_volume"),
        F.sum(money).cast("double").alias("premarket_dollar_volume"),
        F.count(F.lit(1)).alias("premarket_trade_count"),
        F.min("ts").alias("first_tick"),
    )
    return sums.select(
        F.to_date(wall_clock(F.col("window.end"))).alias("trade_date"), "ticker", "last_price", "high_price",
        "total_volume", "premarket_dollar_volume", "premarket_trade_count", "first_tick",
    )


def _drain(stream: DataFrame, out: str, mode: str) -> StreamingQuery:
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_available(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a Parquet table in the shared folder and read it back."""
    out = scratch_path(spark, label)
    _drain(stream, out, mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_to_end(spark: SparkSession, ticks: DataFrame, job: Callable[[DataFrame], DataFrame], label: str,
               delay: str = "10 minutes") -> DataFrame:
    """Drain a finite input whole: what the watermark still holds back after a drain is flushed by an end mark.

    The mark is one row without ticker, dated ``delay`` and a minute after the newest tick, in a second source of
    the same query; a second drain reads it, the watermark passes the last windows, and the job drops it.  Later
    ticks may still follow from where the input ended.
    """
    out = scratch_path(spark, label)
    marks = f"{out}/marks"
    blank = spark.createDataFrame([], ticks.schema)
    blank.write.parquet(marks)

    def stream() -> DataFrame:
        return job(ticks.unionByName(spark.readStream.schema(ticks.schema).parquet(marks)))

    first = _drain(stream(), out, "append")
    seen = [p["eventTime"]["max"] for p in first.recentProgress if p["eventTime"].get("max")]
    if seen:
        newest = F.to_timestamp(F.lit(max(seen))) + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 MINUTE 1 SECOND")
        mark = spark.range(1).select(*[
            (wall_clock(newest) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in ticks.schema])
        mark.write.mode("append").parquet(marks)
        _drain(stream(), out, "append")
    return spark.read.schema(stream().schema).parquet(f"{out}/data")


def quarantine_split(stream: DataFrame, task: str, accepted: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Route rows stamped after their decision time (or unstamped) to a side table.

    Each micro-batch owns a ``batch_id`` folder in both tables and replaces it when
    replayed, so a restart neither loses nor doubles rows.
    """
    late = F.coalesce(F.col("as_of") > decision_time(task), F.lit(True))

    def split(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("_late", late).persist()
        tagged.where("not _late").drop("_late").write.mode("overwrite").parquet(f"{accepted}/batch_id={batch_id}")
        tagged.where("_late").drop("_late").write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        tagged.unpersist()

    return (
        stream.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def claim(spark: SparkSession, path: str, owner: str) -> str:
    """Create the file ``path`` with the owner's name if it is absent, in one step of the file system; whose it is.

    Of any number of runs that claim a path at once exactly one creates it.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    if system.getScheme() == "file":
        # Hadoop's local file system looks before it creates; a link appears whole or not at all.
        local = Path(target.toUri().getPath())
        intent = local.with_name(f"{local.name}.{owner}")
        intent.write_text(owner)
        try:
            local.hardlink_to(intent)
        except FileExistsError:
            pass
        return local.read_text()
    try:
        out = system.create(target, False)
        out.write(bytearray(owner.encode()))
        out.close()
        return owner
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
    held = system.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def prediction_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write-once predictions: a published date can never be written again, whatever the checkpoint.

    Rows lie by run (digest of the checkpoint's path) and batch.  Before it writes, a batch claims each of its dates
    by creating that date's file, which only one run and batch can do, even when several run at once; a batch that
    does not get all its dates writes nothing.  A replay of the same batch finds its own claims and replaces its
    rows.  The dates of a batch are calendar-sized.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark, owner = batch.sparkSession, f"{run}-{batch_id}"
        dates = sorted(str(r[0]) for r in batch.select("trade_date").distinct().collect())
        taken = [d for d in dates if claim(spark, f"{path}/_dates/{d}", owner) != owner]
        if taken:
            raise FileExistsError(f"predictions already published for {taken[:5]}")
        batch.write.mode("overwrite").parquet(f"{path}/run_id={run}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


MONITOR_OUTPUT = "model string, trade_date date, stop boolean, kill boolean"


class _RunLengths(StatefulProcessor):
    """Per model: the days seen so far with whether each falls short, in date order."""

    def __init__(self, expectation: float, stop_window: int, kill_window: int, drift: float) -> None:
        self.expectation, self.drift = expectation, drift
        self.stop_window, self.kill_window = stop_window, kill_window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day int", "short boolean, below boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        came = set()
        for frame in rows:
            for day, live, base in zip(frame["trade_date"], frame["live_hits"], frame["baseline_hits"], strict=True):
                short = bool(pd.notna(live) and self.expectation - live > self.drift)
                below = bool(pd.notna(live) and pd.notna(base) and live < base)
                number = pd.Timestamp(day).toordinal()
                self.days.updateValue((number,), (short, below))
                came.add(number)
        held = sorted((k[0], *v) for k, v in self.days.iterator())
        # A late day changes the verdicts of the days that follow it within a window: they are given again.
        reach = max(self.stop_window, self.kill_window)
        at = {number: i for i, (number, _, _) in enumerate(held)}
        changed = sorted({i for number in came for i in range(at[number], min(at[number] + reach, len(held)))})
        out = []
        for i in changed:
            verdict = [i + 1 >= n and all(d[field] for d in held[i + 1 - n:i + 1]) for n, field in ((self.stop_window, 1), (self.kill_window, 2))]
            out.append((key[0], pd.Timestamp.fromordinal(held[i][0]).date(), *verdict))
        yield pd.DataFrame(out, columns=["model", "trade_date", "stop", "kill"])

    def close(self) -> None:
        pass


def monitor_stream(hits: DataFrame, expectation: float, stop_window: int = STOP_WINDOW_DAYS,
                   kill_window: int = KILL_WINDOW_DAYS, drift: float = STOP_DRIFT_HITS) -> DataFrame:
    """Stop / kill verdict per day of (model, trade_date, live_hits, baseline_hits), as days arrive in any order.

    State per model is its days in order (calendar-sized).  A day that arrives late is put in its place, and the
    verdicts it changes follow as new rows of their days (``latest_verdicts`` keeps the last ones).  The stream
    needs a state store with column families (``spark.sql.streaming.stateStore.providerClass`` RocksDB).
    """
    return hits.groupBy("model").transformWithStateInPandas(
        _RunLengths(expectation, stop_window, kill_window, drift), MONITOR_OUTPUT, "Update", "None")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_monitor(hits: DataFrame, table: str, checkpoint: str, **rules) -> StreamingQuery:
    """``monitor_stream`` into a table whose batches are folders; a replayed batch replaces its own."""
    spark = hits.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (monitor_stream(hits, **rules).writeStream.foreachBatch(keep).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_verdicts(spark: SparkSession, table: str) -> DataFrame:
    """The last verdict of every model and day."""
    rows = spark.read.schema(f"{MONITOR_OUTPUT}, batch_id long").parquet(table)
    return rows.groupBy("model", "trade_date").agg(F.max_by(F.struct("stop", "kill"), "batch_id").alias("v")).select("model", "trade_date", "v.*")
