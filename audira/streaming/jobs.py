"""Streaming jobs over an event stream (event_id, ts, user_id, event_type, value).

Each ``stream_*`` function takes and returns a streaming (or batch) DataFrame; sources, sinks, triggers and
checkpoints are set where the query is started.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from audira.operators import ordering

PARTITION = "source_file"
# Local hours of the refresh.
REFRESH_HOURS = (0, 9, 12, 18)
EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_time(c: str = "ts") -> Column:
    """Event time as an instant; the session runs in UTC."""
    return F.col(c).cast("timestamp")


def stream_daily_views(events: DataFrame, key: str, value: str = "value", lag: str = "48 hours") -> DataFrame:
    """Views per day and key. In append mode a day comes out once it is older than ``lag``; later rows are dropped."""
    timed = events.withColumn("_t", event_time())
    if events.isStreaming:
        timed = timed.withWatermark("_t", lag)
    out = timed.groupBy(F.window("_t", "1 day").alias("_w"), key).agg(F.sum(value).alias("views"), F.count("*").alias("events"))
    return out.select(F.to_date(F.col("_w.start")).alias("day"), key, "views", "events")


def confirmed_days(daily: DataFrame, as_of: dt.datetime, lag_hours: int = 48) -> DataFrame:
    """Days that ended at least ``lag_hours`` before a moment: what the stream has emitted by then."""
    last = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {lag_hours} HOURS")
    return daily.where(F.date_add("day", 1).cast("timestamp_ntz") <= last)


def stream_catalog_dedup(videos: DataFrame, key: str = "id", rescan: str = "7 days") -> DataFrame:
    """First row of each id within the re-scan period; state older than that is forgotten."""
    timed = videos.withColumn("_t", event_time("published_at"))
    if not videos.isStreaming:
        first = F.min_by(F.struct(*videos.columns), F.struct("published_at", F.xxhash64(*videos.columns)))
        return videos.groupBy(key).agg(first.alias("_row")).select("_row.*")
    return timed.withWatermark("_t", rescan).dropDuplicatesWithinWatermark([key]).drop("_t")


def stream_user_sessions(events: DataFrame, idle: str = "120 minutes", lag: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by ``idle`` without an event."""
    timed = events.withColumn("_t", event_time())
    if events.isStreaming:
        timed = timed.withWatermark("_t", lag)
    out = timed.groupBy(F.session_window("_t", idle).alias("_w"), "user_id").agg(F.count("*").alias("events"))
    start, end = F.col("_w.start").cast("timestamp_ntz"), F.col("_w.end").cast("timestamp_ntz")
    return out.select("user_id", start.alias("session_start"), end.alias("session_end"), "events")


def stream_capped_ingest(
    stream: DataFrame, path: str, checkpoint: str, total: int, order: list[str]
) -> StreamingQuery:
    """Append source batches until the sink holds ``total`` rows; the batch that crosses the cap is kept whole.

    The cap counts whole batches, so what is kept depends on how the source cuts them (``maxFilesPerTrigger`` and the
    like fix that). One row per batch beside the sink says how many rows it has held; the sink itself is never counted again.
    A replayed batch overwrites its own folders, so it is not counted or written twice.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        held = 0
        if batch_id:
            sizes = spark.read.schema("rows long, batch long").parquet(f"{checkpoint}-sizes")
            held = sizes.where(F.col("batch") < batch_id).agg(F.sum("rows")).first()[0] or 0
        kept = batch if held < total else batch.limit(0)
        out = kept.sortWithinPartitions(*order).withColumn("batch", F.lit(batch_id).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        size = kept.agg(F.count(F.lit(1)).alias("rows")).withColumn("batch", F.lit(batch_id).cast("bigint"))
        size.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{checkpoint}-sizes")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def scheduled_refresh(
    stream: DataFrame, path: str, ledger: str, checkpoint: str, as_of: dt.datetime, hours: tuple[int, ...] = REFRESH_HOURS, key: str = "id"
) -> StreamingQuery | None:
    """One refresh run at a refresh hour: merge everything that arrived since the last run into the catalogue, and stop.

    An outside scheduler calls it; at other hours it does nothing and returns None. Each batch takes the latest row per
    (source_file, key) by ``updated_at``, lets it replace the catalogue's row of that key, and rewrites only the partitions
    that the batch touches. The catalogue's versions are folders by batch: a batch reads the version before it and writes its
    own, then a ledger row (batch, rows, touched partitions, time) names it. A replayed batch finds its ledger row and
    changes nothing; one that failed half-way has none and is written anew.
    """
    if not is_refresh_hour(as_of, hours):
        return None
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        done = read_ledger(spark, ledger)
        if not done.where(F.col("batch") == batch_id).isEmpty():
            return
        fresh = ordering.settle(ordering.latest_per_key(ordering.settle(batch), [PARTITION, key], [F.col("updated_at")]))
        touched = [r[0] for r in fresh.select(PARTITION).distinct().collect()]  # partitions of the catalogue
        old = read_refreshed(spark, path, ledger, stream.schema).where(F.col(PARTITION).isin(touched))
        kept = old.join(fresh.select(PARTITION, key), [PARTITION, key], "left_anti")
        merged = kept.select(*fresh.columns).unionByName(fresh)
        merged.write.mode("overwrite").partitionBy(PARTITION).parquet(f"{path}/v{batch_id}")
        row = fresh.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(batch_id).cast("long").alias("batch"), "rows", F.lit(touched).cast("array<string>").alias("touched"), F.lit(as_of).alias("as_of"))
        row.write.mode("append").parquet(ledger)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LEDGER = "batch long, rows long, touched array<string>, as_of timestamp"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per merged batch; empty before the first run."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def read_refreshed(spark: SparkSession, path: str, ledger: str, schema: T.StructType) -> DataFrame:
    """The catalogue as the ledger has it: each partition from the last version that wrote it."""
    last: dict[str, int] = {}
    for r in read_ledger(spark, ledger).orderBy("batch").collect():  # one row per refresh
        last.update(dict.fromkeys(r.touched, r.batch))
    out = spark.createDataFrame([], schema)
    for batch in sorted(set(last.values())):
        mine = [k for k, v in last.items() if v == batch]
        rows = spark.read.schema(schema).parquet(f"{path}/v{batch}").where(F.col(PARTITION).isin(mine))
        out = out.unionByName(rows.select(*out.columns))
    return out


def is_refresh_hour(as_of: dt.datetime, hours: tuple[int, ...] = REFRESH_HOURS) -> bool:
    """Whether a local time is one of the fixed refresh hours."""
    return as_of.hour in hours


def _millis(at: dt.datetime) -> int:
    """A worker's local time in whole milliseconds since 1970, rounded down."""
    return math.floor(at.timestamp()) * 1000 + at.microsecond // 1000


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstInHorizon(StatefulProcessor):
    """Per id: the rows that wait for the watermark, and when one was last let through.

    Rows are decided in event-time order once the watermark has reached them, so the result does not depend on how the stream
    is cut into batches. An id has one timer, at its earliest waiting row; when it fires, all rows that the watermark has
    passed are decided at once.
    """

    def __init__(self, horizon: dt.timedelta, rows: T.StructType, time: str):
        self.horizon, self.rows, self.time = horizon, rows, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp")
        self.waiting = handle.getListState("waiting", self.rows)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues):
        came = [tuple(r) for r in rows]
        if came:
            self.waiting.appendList(came)
            place = self.rows.names.index(self.time)
            self._wake(_millis(min(r[place] for r in came)) + 1)
        return iter(())

    def _wake(self, at: int) -> None:
        """Move the timer to ``at``, unless it is set to fire before."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        reached = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        place = self.rows.names.index(self.time)
        waiting = sorted(map(tuple, self.waiting.get()), key=lambda r: (r[place], tuple(repr(x) if i != place else "" for i, x in enumerate(r))))
        last = self.last.get()[0] if self.last.exists() else None
        out, kept = [], []
        for r in waiting:
            if _millis(r[place]) >= reached:
                kept.append(r)
            elif last is None or r[place] >= last + self.horizon:
                out.append(Row(**dict(zip(self.rows.names, r, strict=True))))
                last = r[place]
        if out:
            self.last.update((last,))
        if kept:
            self.waiting.put(kept)
            self._wake(_millis(kept[0][place]) + 1)
        else:
            self.waiting.clear()
        return iter(out)

    def handleInitialState(self, key, initialState, timerValues):
        if initialState["last"] is not None:
            self.last.update((initialState["last"],))

    def close(self) -> None:
        pass


def stream_catalog_news(videos: DataFrame, known: DataFrame, key: str = "id", time: str = "published_at", rescan: dt.timedelta = dt.timedelta(days=7), lag: str = "1 hour") -> DataFrame:
    """Rows of ids that were not let through within ``rescan`` before them, each id's known last time (key, last) counted in.

    Time is the rows' own: after a row of an id, further ones within the horizon are repeats; the first one behind it comes
    out again. Rows wait until the watermark (``lag`` behind the newest) reaches them; later ones are dropped. Per-id state
    that no built-in operator keeps, so it runs as a stateful Python processor, one id at a time.
    """
    spark = videos.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # The watermark never reaches a row without a time.
    timed = videos.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, lag)
    processor = FirstInHorizon(rescan, T.StructType([T.StructField(f.name, f.dataType) for f in timed.schema.fields]), time)
    start = known.select(F.col(key), F.col("last").cast("timestamp").alias("last")).groupBy(key)
    return timed.groupBy(key).transformWithState(processor, timed.schema, "Append", "EventTime", start)
