"""Change capture: debounced file events, and re-indexing per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemill.config import Config
from tidemill.operators import ingest, scan
from tidemill.sources.scratch import materialize
from tidemill.sources.store import IndexStore


def debounce(changes: DataFrame, gap: str = "2 seconds", watermark: str | None = None) -> DataFrame:
    """``changes(path, ts, op)`` folded to bursts: events of a path no further apart than ``gap``; the last op holds.

    The same function serves a batch and a stream; a stream needs a watermark.
    """
    rows = changes.withWatermark("ts", watermark) if watermark else changes
    burst = rows.groupBy("path", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("op", F.struct("ts", "op")).alias("op")).drop("w")


def file_changes(spark: SparkSession, folder: str, schema: str, format: str = "parquet", per_trigger: int = 256) -> DataFrame:
    """A stream of change rows from files that land in a folder, with bounded intake per trigger."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)


def reindex_on_change(
    changes: DataFrame,
    store: IndexStore,
    read_files: Callable[[], DataFrame],
    config: Config,
    checkpoint: str,
    available_now: bool = True,
    read_paths: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """For each micro-batch of ``changes(path, ...)``, brings the index up to date.

    With ``read_paths``, which gives the files of the paths that it gets, no other file or bucket is read.

    A change of content decides, not the event, so a batch that is replayed after a failure finds
    nothing to do: the sink is idempotent. Batches without an indexable path are skipped.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.where(scan.is_indexable_path(F.col("path"), config)).limit(1).count():
            if read_paths is None:
                ingest.update(store, read_files(), config)
            else:
                paths = materialize(batch.select("path").distinct(), "changed")
                ingest.update(store, read_paths(paths), config, only=paths)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def debounced_stream(changes: DataFrame, checkpoint: str, target: str, gap: str = "2 seconds", watermark: str = "10 seconds") -> StreamingQuery:
    """Bursts of a stream, appended to a table as they close."""
    out = debounce(changes, gap, watermark)
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def debounce_table(spark: SparkSession, changes: DataFrame, where: str, gap: str, per_trigger: int = 256) -> DataFrame:
    """All bursts of a table of changes, streamed through files below ``where``, in whatever order and batches they come.

    The watermark lies back by the table's whole span, so that no row is late; a last event, beyond
    all others by more than that, closes the bursts that are open. Its own burst never closes.
    """
    schema = "path string, ts timestamp, op string"
    changes.select("path", "ts", "op").write.parquet(f"{where}/in")
    rows = spark.read.schema(schema).parquet(f"{where}/in")
    seconds = rows.agg((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("span")).first()[0] or 0
    delay = f"{seconds + 1} seconds"

    def run():
        stream = file_changes(spark, f"{where}/in", schema, per_trigger=per_trigger)
        debounced_stream(stream, f"{where}/checkpoint", f"{where}/out", gap, delay).awaitTermination()

    run()
    end = F.max("ts") + F.expr(f"interval {gap}") + F.expr(f"interval {delay}") + F.expr("interval 1 hour")
    rows.agg(F.lit("").alias("path"), end.alias("ts"), F.lit("").alias("op")).where("ts is not null").write.mode("append").parquet(f"{where}/in")
    run()
    return spark.read.schema("path string, events long, first_ts timestamp, last_ts timestamp, op string").parquet(f"{where}/out")


# --- stateful capture -------------------------------------------------------------------------

CHANGE = "path string, ts timestamp, op string, seq long"
BURST = "path string, events long, first_ts timestamp, last_ts timestamp, op string, seq long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of paths, each with one state: what calls into the state cost doesn't grow with the number of paths.
BUCKETS = 512
_OPEN = ["path", "first_us", "last_us", "events", "op", "seq"]


def merged(bursts: pd.DataFrame, gap_us: int) -> pd.DataFrame:
    """Bursts of many paths, those of a path no further apart than the gap made one; the last event, by time and seq, gives op and seq."""
    rows = bursts.sort_values(["path", "first_us", "last_us", "seq"], kind="stable", ignore_index=True)
    until = rows.groupby("path", sort=False)["last_us"].cummax().shift(fill_value=0)
    rows["burst"] = ((rows["path"] != rows["path"].shift()) | (rows["first_us"] - until > gap_us)).cumsum()
    last = rows.sort_values(["burst", "last_us", "seq"], ascending=[True, False, False], kind="stable").drop_duplicates("burst")
    whole = rows.groupby("burst").agg(first_us=("first_us", "min"), events=("events", "sum"))
    return last.assign(first_us=whole["first_us"].to_numpy(), events=whole["events"].to_numpy())[_OPEN]


class Debounce(StatefulProcessor):
    """The open bursts of a bucket of paths. An event joins the burst of its path that it is no further than the gap from, and may join two.

    A bucket has one timer, just beyond the end of the first burst that closes. When the watermark has passed it, all bursts
    that it has passed are given out and forgotten, and the timer moves to the next one, so state is held for open bursts
    only (event-time timers take the place of a TTL, which Spark has in processing time only).
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "path string, first_us long, last_us long, events long, op string, seq long")

    def _held(self) -> pd.DataFrame:
        held = [tuple(b) for b in self.open.get()] if self.open.exists() else []
        return pd.DataFrame(held, columns=_OPEN).astype({"first_us": "int64", "last_us": "int64", "events": "int64", "seq": "int64"})

    def _keep(self, bursts: pd.DataFrame) -> None:
        if len(bursts):
            self.open.put(list(bursts.itertuples(index=False, name=None)))
        else:
            self.open.clear()
        wanted = {int(bursts["last_us"].min()) // 1000 + self.gap // 1000 + 2} if len(bursts) else set()
        present = set(self.handle.listTimers())
        for t in present - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - present:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self._held()
        for some in rows:
            us = some["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            new = pd.DataFrame({"path": some["path"].to_numpy(), "first_us": us, "last_us": us, "events": 1, "op": some["op"].to_numpy(), "seq": some["seq"].to_numpy().astype("int64")})
            found = merged(pd.concat([found, new]) if len(found) else new, self.gap)
        self._keep(found)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        bursts = self._held()
        closed = bursts["last_us"] + self.gap < now
        self._keep(bursts[~closed])
        done = bursts[closed]
        if len(done):
            when = lambda c: pd.to_datetime(done[c].to_numpy(), unit="us")
            yield pd.DataFrame({"path": done["path"].to_numpy(), "events": done["events"].to_numpy(), "first_ts": when("first_us"), "last_ts": when("last_us"), "op": done["op"].to_numpy(), "seq": done["seq"].to_numpy()})

    def close(self) -> None:
        pass


def captured(changes: DataFrame, gap_ms: int, late: str) -> DataFrame:
    """``changes(path, ts, op, seq)`` as a stream of closed bursts; rows later than ``late`` behind the newest are dropped."""
    rows = changes.where("path is not null and ts is not null").withWatermark("ts", late)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(Debounce(gap_ms), BURST, "Append", "EventTime")


def index_bursts(bursts: DataFrame, store: IndexStore, rows_of: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Fires each burst into the index: the rows of its path give way to those of ``rows_of(paths)``, or go where the last event is a removal.

    ``rows_of`` gets the last burst of each path that still exists and returns rows by table. A replayed batch
    writes the same rows again.
    """

    def fire(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("op", "seq", "last_ts"), F.struct("last_ts", "seq")).alias("b")).select("path", "b.*")
        last = materialize(last, "fired")
        if last.isEmpty():
            return
        with store.lock():
            store.upsert(rows_of(last.where("op <> 'remove'")), last.select("path"))

    return bursts.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _in_order(spark: SparkSession, folder: str) -> None:
    """Makes a folder's files as old as their order by name, the order in which the file source takes them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, name in enumerate(names):
        fs.setTimes(name, 1_000_000_000_000 + 1000 * i, -1)


def index_changes(spark: SparkSession, changes: DataFrame, store: IndexStore, rows_of: Callable[[DataFrame], dict[str, DataFrame]], where: str, gap_ms: int, files: int = 4, per_trigger: int = 1, late: str = "1 second") -> None:
    """Streams a table of changes into an index, in order of time, a file a trigger, and closes what is open at the end.

    Files are ranges of time, so no row is later than the delay, and state is held for the bursts that are open only.
    """
    changes.select("path", "ts", "op", "seq").where("path is not null and ts is not null").repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(f"{where}/in")
    _in_order(spark, f"{where}/in")

    def run() -> None:
        stream = file_changes(spark, f"{where}/in", CHANGE, per_trigger=per_trigger)
        index_bursts(captured(stream, gap_ms, late), store, rows_of, f"{where}/checkpoint").awaitTermination()

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        run()
        end = spark.read.schema(CHANGE).parquet(f"{where}/in").agg(F.max("ts").alias("ts")).where("ts is not null")
        last = end.select(F.lit("").alias("path"), (F.col("ts") + F.expr(f"interval {gap_ms + 60_000} milliseconds") + F.expr(f"interval {late}")).alias("ts"), F.lit("remove").alias("op"), F.lit(0).cast("long").alias("seq"))
        last.write.mode("append").parquet(f"{where}/in")
        run()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
