"""Structured Streaming versions of the time-bound operators.

Each takes and returns a streaming DataFrame; sinks and triggers are the caller's. ``run_batched``
drives one to the end of its input and hands back what it wrote, for tests and backfills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from fieldtally.session import shared_folder
from fieldtally.streaming.timed import late_entries, stream_outcomes, stream_track  # noqa: F401  the flows with timers


def with_closing(rows: DataFrame, time: str, at: str = "2200-01-01") -> tuple[DataFrame, Callable[[], None]]:
    """``rows`` with a second source for a closing row, and what writes that row.

    Once written, the row moves the watermark past all others, so what still waits for it comes out.
    Its columns but ``time`` are null; it waits itself for ever and is never given out.
    """
    spark = rows.sparkSession
    folder, schema = shared_folder(spark, "stream-closing"), rows.schema
    nullable = StructType([StructField(f.name, f.dataType) for f in schema])
    spark.createDataFrame([], nullable).write.parquet(folder)
    marker = spark.range(1).select(*[(F.lit(at) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in nullable])
    both = rows.unionByName(spark.readStream.schema(nullable).parquet(folder))
    return both, lambda: marker.write.mode("append").parquet(folder)


def run_batched(stream: DataFrame, *, mode: str = "append", handle: Callable[[DataFrame], DataFrame] | None = None,
                close: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over all available input and read back its output.

    Every micro-batch owns a folder named by its id and overwrites it, so a batch repeated after
    a failure leaves no duplicates. In complete mode the last batch is the answer. ``close`` (of
    ``with_closing``) ends a bounded input: it is called when all of it has been read, and the stream
    goes on from its progress to give out what it still holds.
    """
    spark = stream.sparkSession
    out, progress = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-progress")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if handle is None else handle(batch)
        folder = out if mode == "complete" else f"{out}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(folder)

    def run() -> None:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", progress).trigger(
            availableNow=True).start().awaitTermination()

    run()
    if close:
        close()
        run()
    result = spark.read.parquet(out)
    return result.drop("batch") if mode != "complete" else result


# --- double saves -------------------------------------------------------------------------

DEDUP_OUT = "occurrence_id string, cluster_id string, position int, suppressed boolean"
DEDUP_STATE = ("waiting array<struct<at:bigint,occurrence_id:string,what:string,batch_id:string,event:string>>, "
               "tails array<struct<event:string,what:string,at:bigint,batch_id:string,cluster_id:string,position:int>>")


def _dedup(window_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, tails = state.get if state.exists else ([], [])
        waiting = [tuple(w) for w in (waiting or [])]
        last = {tuple(t[:2]): tuple(t[2:]) for t in (tails or [])}
        if not state.hasTimedOut:
            for pdf in batches:
                waiting += [
                    (int(a), o, w, None if pd.isna(b) else b, None if pd.isna(e) else e)
                    for a, o, w, b, e in zip(pdf["at"], pdf["occurrence_id"], pdf["what"], pdf["batch_id"], pdf["event"])
                ]
        now = state.getCurrentWatermarkMs()
        ready = sorted((w for w in waiting if w[0] <= now), key=lambda w: tuple((v is not None, v) for v in w))
        waiting = [w for w in waiting if w[0] > now]
        rows = []
        for at, occurrence, what, batch, event in ready:
            before, batch_before, cluster, position = last.get((event, what), (None, None, None, 0))
            chained = before is not None and at - before <= window_ms and not (batch and batch == batch_before)
            cluster, position = (cluster, position + 1) if chained else (occurrence, 1)
            rows.append((occurrence, cluster, position, position > 1))
            last[event, what] = (at, batch, cluster, position)
        last = {what: t for what, t in last.items() if now <= t[0] + window_ms}
        if waiting or last:
            state.update((waiting, [(*key, *t) for key, t in last.items()]))
            due = min([w[0] for w in waiting] + [t[0] + window_ms for t in last.values()])
            state.setTimeoutTimestamp(max(due, now) + 1)
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["occurrence_id", "cluster_id", "position", "suppressed"])

    return step


def stream_dedup(occurrences: DataFrame, *, window_s: int = 60, watermark: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """Second and later saves of the same thing within ``window_s`` of the one before.

    Rows wait for the watermark, so the order of arrival does not matter; the chain rule is the
    one of ``duplicate_clusters``. State lives one window beyond its rows; it is kept for ``buckets`` of
    events, as a call of the function for each event costs more than its few rows.
    A bounded input is closed with ``with_closing``, or its last rows keep waiting.
    """
    subject = F.coalesce(F.col("taxon_id").cast("string"), F.col("verbatim_taxon"), F.lit("?"))
    rows = (
        occurrences.filter(F.col("deleted_at").isNull())
        .withWatermark("created_at", watermark)
        .select(F.pmod(F.xxhash64("event_id"), F.lit(buckets)).alias("bucket"), F.col("event_id").cast("string").alias("event"), F.concat_ws("|", subject, "record_type").alias("what"), "occurrence_id", "batch_id", "created_at",
                F.unix_millis("created_at").alias("at"))
    )
    return rows.groupBy("bucket").applyInPandasWithState(
        _dedup(window_s * 1000), DEDUP_OUT, DEDUP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --- field days -----------------------------------------------------------------------------

def stream_field_day(records: DataFrame, *, by: list[str], time: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Live counts per field day (04:00 to 04:00) and ``by`` columns."""
    day = F.window(F.col(time), "1 day", startTime="4 hours")
    return records.withWatermark(time, watermark).groupBy(day.alias("w"), *by).agg(F.count(F.lit(1)).alias("records")).select(
        F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("field_day"), *by, "records")
