"""Snapshots compared, change history, and debounced change streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, op (upsert or delete), size: what turns the old listing into the new one. Listings hold path, content_hash, size."""
    a = old.select("path", F.col("content_hash").alias("old_hash"))
    b = new.select("path", F.col("content_hash").alias("new_hash"), "size")
    both = a.join(b, "path", "full")
    op = F.when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("new_hash")), "upsert")
    return both.select("path", op.alias("op"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size")).filter("op IS NOT NULL")


def apply_diff(old: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    """The old listing with the changes; equals the new one."""
    rest = old.join(changes.select("path"), "path", "left_anti")
    return rest.unionByName(new.join(changes.filter("op = 'upsert'").select("path"), "path", "left_semi"), allowMissingColumns=True)


def since(history: DataFrame, seq: int) -> DataFrame:
    """All changes of the last rebuild if it came after seq, else none."""
    last = history.agg(F.max("seq").alias("last"))
    return history.join(F.broadcast(last), (F.col("seq") == F.col("last")) & (F.col("last") > seq)).drop("last")


def sessions(events: DataFrame, gap: str = "1500 milliseconds", ts: str = "ts", late: str | None = None, *by: str) -> DataFrame:
    """start, end, events of runs of events without a pause of `gap`: the debounce of a watcher. Batch or stream (late: watermark)."""
    if late:
        events = events.withWatermark(ts, late)
    window = F.session_window(ts, gap)
    # a stream's session windows need a key beside them: without one, all events share it
    events = events.withColumn("all", F.pmod(F.xxhash64(ts), F.lit(1)))
    return events.groupBy(window, *(by or ("all",))).agg(F.count("*").alias("events")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def gap_sessions(events: DataFrame, gap_ms: int, key: str, ts: str = "ts") -> DataFrame:
    """The same for a table: key, start, last event and count of each run of events of a key."""
    order = Window.partitionBy(key).orderBy(ts)
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    fresh = (ms - F.lag(ms).over(order) >= gap_ms) | F.lag(ms).over(order).isNull()
    numbered = events.withColumn("run", F.sum(fresh.cast("int")).over(order))
    return numbered.groupBy(key, "run").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("events"))


def watched(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)


def watch(stream: DataFrame, on_quiet, checkpoint: str, gap: str = "1500 milliseconds", late: str = "10 seconds"):
    """Calls on_quiet(batch of closed sessions, batch id) once events pause; the checkpoint makes it resume after a loss."""
    quiet = sessions(stream, gap, "ts", late)
    return quiet.writeStream.outputMode("append").foreachBatch(on_quiet).option("checkpointLocation", checkpoint).start()


def latest_state(changes: DataFrame) -> DataFrame:
    """Current listing from an append-only change history (path, op, size, seq)."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("op", "size"), "seq").alias("s"))
    return last.filter("s.op = 'upsert'").select("path", "s.size")
