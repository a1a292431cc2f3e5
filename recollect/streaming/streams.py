"""Streams: cooldown of repeated fires, pages seen anew, debounced navigation, ingest that replays safely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooldown(events: DataFrame, seconds: float = 45 * 60) -> DataFrame:
    """Events (key, ts, event_id) with fires: an event fires unless its key fired within the last so many seconds; what is
    suppressed does not put off the next.

    Batch form: a key's events stream through one task in time order, nothing but the last fire being held."""

    def run(batches):
        import pyarrow as pa

        key, last = None, None
        for b in batches:
            out = []
            for k, us in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    key, last = k, None
                fires = last is None or us - last >= seconds * 1e6
                if fires:
                    last = us
                out.append(fires)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.bool_())], names=["key", "event_id", "us", "fires"])

    rows = events.select(F.col("key").cast("string"), F.col("event_id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInArrow(run, "key string, event_id long, us long, fires boolean")


def unmuted(events: DataFrame, muted: DataFrame) -> DataFrame:
    """Events (key, ...) whose key is not muted for good; muted: key."""
    return events.join(muted.select("key").distinct(), "key", "left_anti")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keeps_state(spark) -> None:
    """Let the session's streams keep their state where operators with timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def folded(key: str, value: str, fold, forget_ms: int, in_order: bool):
    """A processor for rows (key, event_id, us, ..., value): fold(last, us, value) gives (what to say of the row, what to keep as (us, value)).

    A key's state is that one value. It goes by a timer forget_ms after the value's time, once the watermark has passed. Rows of a trigger are taken
    in the order of (us, event_id). In order, they are held until the watermark has passed them, and so come in that order across
    triggers as well, however late they came within the delay; else each is answered in the trigger that brought it."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class Processor(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "us long, value string")
            self.held = handle.getListState("held", "event_id long, us long, value string") if in_order else None

        def _said(self, name, rows):
            last = tuple(self.last.get()) if self.last.exists() else None
            for us, event_id, v in rows:
                says, last = fold(last, us, v)
                yield Row(**{key: name, "event_id": event_id, "us": us, value: says})
            if rows:
                self.last.update(last)

        def _timer(self, at: int):
            """The one timer of this key: when something is to be done next."""
            for old in list(self.handle.listTimers()):
                if old != at:
                    self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

        def handleInputRows(self, key, rows, timerValues):
            new = sorted((r["us"], r["event_id"], r["value"]) for r in rows)
            if in_order:
                self.held.appendList([(e, us, v) for us, e, v in new])
                first = min([new[0][0] // 1000 + 1, *self.handle.listTimers()])
                self._timer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
                return iter(())
            out = list(self._said(key[0], new))
            self._timer(max(int(self.last.get()[0] // 1000) + forget_ms + 1, timerValues.getCurrentWatermarkInMs() + 1))
            return iter(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark = timerValues.getCurrentWatermarkInMs()
            out = []
            if in_order and self.held.exists():
                every = sorted((us, e, v) for e, us, v in map(tuple, self.held.get()))
                ripe = [r for r in every if r[0] // 1000 < mark]
                out = list(self._said(key[0], ripe))
                if len(ripe) < len(every):
                    self.held.put([(e, us, v) for us, e, v in every[len(ripe) :]])
                    self._timer(max(every[len(ripe)][0] // 1000 + 1, mark + 1))
                    return iter(out)
                self.held.clear()
            until = int(self.last.get()[0] // 1000) + forget_ms + 1 if self.last.exists() else 0
            if until > mark:
                self._timer(until)
            else:
                self.last.clear()
            return iter(out)

        def close(self):
            pass

    return Processor()


def _stateful(events: DataFrame, processor, out: str, delay: str) -> DataFrame:
    """events (key, event_id, us, value) through a processor, in event time."""
    keeps_state(events.sparkSession)
    timed = events.withColumn("_ts", F.timestamp_micros("us")).withWatermark("_ts", delay)
    return timed.groupBy("key").transformWithState(processor, out, "Append", "EventTime")


def cooldown_stream(events: DataFrame, seconds: float = 45 * 60, delay: str = "10 minutes", in_order: bool = False) -> DataFrame:
    """The same on a stream of (key, event_id, us): key, event_id, us, fires.

    The state of a key is its last fire. A timer takes it away once the watermark, which lags by delay, has passed the time in which it can suppress
    anything, so state grows with the keys of that time and not with all keys; events that come later than delay are dropped. Rows of one
    trigger are taken in time order; in_order holds them until the watermark has passed, which gives what cooldown() gives of the table."""

    def fold(last, us, value):
        on = last is None or us - last[0] >= seconds * 1e6
        return on, (us, None) if on else last

    rows = events.select(F.col("key").cast("string"), F.col("event_id").cast("long"), F.col("us").cast("long"), F.lit(None).cast("string").alias("value"))
    return _stateful(rows, folded("key", "fires", fold, int(seconds * 1000), in_order), "key string, event_id long, us long, fires boolean", delay)


def fresh_pages_stream(events: DataFrame, forget: float = 24 * 3600, delay: str = "10 minutes", in_order: bool = True) -> DataFrame:
    """fresh_pages() on a stream of (key, event_id, us, page): key, event_id, us, page of events whose page is another than the key's event before
    had. A key of which nothing has come for forget seconds starts anew."""

    def fold(last, us, value):
        return value if last is None or last[1] != value else None, (us, value)

    rows = events.select(F.col("key").cast("string"), F.col("event_id").cast("long"), F.col("us").cast("long"), F.concat(F.lit("="), F.coalesce(F.col("page").cast("string"), F.lit("\0"))).alias("value"))
    out = _stateful(rows, folded("key", "page", fold, int(forget * 1000), in_order), "key string, event_id long, us long, page string", delay).where("page is not null")
    return out.withColumn("page", F.nullif(F.substring("page", 2, 1 << 30), F.lit("\0")))


def fresh_pages(events: DataFrame) -> DataFrame:
    """Of events (key, ts, event_id, page) those whose page is another than the key's event before had."""
    from pyspark.sql import Window as W

    before = F.lag("page").over(W.partitionBy("key").orderBy("ts", "event_id"))
    first = F.row_number().over(W.partitionBy("key").orderBy("ts", "event_id")) == 1
    return events.withColumn("_new", first | ~F.col("page").eqNullSafe(before)).where("_new").drop("_new")


def debounce(events: DataFrame, gap: str = "1400 milliseconds") -> DataFrame:
    """The last event of each burst of a key (key, ts, event_id): works on tables and, with a watermark, on streams."""
    w = F.session_window("ts", gap)
    return events.groupBy("key", w).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"), F.count("*").alias("n")).select("key", "event_id", "ts", "n")


def ingest_stream(batches: DataFrame, table, merge, checkpoint: str):
    """Start a query that merges each micro-batch into table: an object with read() and write(df, version).

    merge(stored, batch) is idempotent (see library.upsert_items); a version is the micro-batch's number, so a replay after a
    failure writes the same version again."""

    def each(batch: DataFrame, version: int) -> None:
        table.write(merge(table.read(before=version), batch), version)

    return batches.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class VersionedTable:
    """Parquet versions in a folder that all executors share; the newest complete one counts."""

    def __init__(self, spark, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, schema

    def _versions(self) -> list[int]:
        jvm, path = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        own = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{own[-1]}") if own else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int) -> None:
        own = self._versions()
        if own and version < own[-1]:
            return
        df.select(*self.read().columns).write.mode("overwrite").parquet(f"{self.root}/{version}")


def on_progress(spark, tell):
    """Call tell(name, batch, rows, milliseconds) after each micro-batch of any query of the session; returns the listener, for
    spark.streams.removeListener(). What tell raises is its own: it stops no query."""
    import contextlib

    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            p = event.progress
            with contextlib.suppress(Exception):
                tell(p.name, p.batchId, p.numInputRows, p.batchDuration)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    listener = Progress()
    spark.streams.addListener(listener)
    return listener
