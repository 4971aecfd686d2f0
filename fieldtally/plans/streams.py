"""Streaming flows run over the tables' files as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.plans import views
from fieldtally.plans.registry import Tables, register
from fieldtally.plans.reports import _DUP, _ENTRIES, TRACK_SQL, _entries
from fieldtally.streaming import flows as W


class _Streamed(Tables):
    """The same views over file streams of the same tables."""

    def __init__(self, tables: Tables, streamed: str):
        object.__setattr__(self, "spark", _Reader(tables, streamed))
        object.__setattr__(self, "sf_dir", tables.sf_dir)


class _Reader:
    """Stands in for a session in the views: one table is read as a stream."""

    def __init__(self, tables: Tables, streamed: str):
        self._tables, self._streamed = tables, streamed

    @property
    def read(self):
        return self

    def parquet(self, path: str):
        session = self._tables.spark
        if not path.endswith(f"/{self._streamed}.parquet"):
            return session.read.parquet(path)
        # A pattern takes a table of one file and a folder of many alike.
        return session.readStream.schema(session.read.parquet(path).schema).parquet(f"{path}*")


def streamed(t: Tables, table: str) -> Tables:
    return _Streamed(t, table)




def _timed(flow, rows, time):
    """A flow with timers over all rows of a table's stream, closed behind the last one."""
    open_rows, close = W.with_closing(rows, time)
    return W.run_batched(flow(open_rows), close=close)


def _tracks(t):
    points = streamed(t, "events").track_point.withColumn("at_time", F.timestamp_seconds("t_s"))
    return _timed(lambda rows: W.stream_track(rows, idle="40000 days"), points, "at_time")


register("stream_track", lambda t: _tracks(t).filter("closed_at is null").select("track_id", "point_id", "accepted", "reason"), TRACK_SQL)
register("stream_track_closed", lambda t: _tracks(t).filter("closed_at is not null").select(
    "track_id", "points", F.floor(F.col("length_m") + 0.5).cast("bigint").alias("length_m"), F.timestamp_millis("closed_at").alias("closed_at")),
    f"""SELECT track_id, count(*) AS points, CAST(floor(coalesce(sum(step),0)+5e-1) AS BIGINT) AS length_m,
    make_timestamp((max(t_s)+CAST(40000 AS BIGINT)*86400)*1000000) AS closed_at FROM (
    SELECT track_id, t_s, CASE WHEN accepted THEN 2*6371000e0*asin(sqrt(pow(sin((radians(lat)-radians(before))/2),2))) END AS step FROM (
      SELECT *, last_value(CASE WHEN accepted THEN lat END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t_s, point_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({TRACK_SQL}) JOIN track_point USING (track_id, point_id)))
    GROUP BY track_id""")
register("stream_field_day", lambda t: W.run_batched(W.stream_field_day(
    views.read(streamed(t, "events").spark, t.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), by=["event_type"]), mode="complete"),
    "SELECT strftime(ts-INTERVAL 4 HOUR,'%Y-%m-%d') AS field_day, event_type, count(*) AS records FROM events GROUP BY ALL")


def _deduplicated(t):
    rows, close = W.with_closing(streamed(t, "lineitem").occurrence.select(
        "occurrence_id", "event_id", "taxon_id", "verbatim_taxon", "record_type", "batch_id", "created_at", "deleted_at"), "created_at")
    return W.run_batched(W.stream_dedup(rows), close=close)


register("stream_dedup", _deduplicated,
         """SELECT occurrence_id, first_value(occurrence_id) OVER w AS cluster_id, CAST(row_number() OVER w AS INT) AS position, row_number() OVER w>1 AS suppressed
    FROM dup WINDOW w AS (PARTITION BY event_id, subject, record_type, c ORDER BY created_s, occurrence_id)""", dup=_DUP)


def _late(t, asked):
    """Visits are saved on their day, sightings written down at ``asked``; both come as streams of the orders."""
    source = streamed(t, "orders")
    visits = source.event.filter("deleted_at is null").select(
        "station_id", "method", "event_date", F.lit(False).alias("removed"), F.col("event_date").cast("timestamp").alias("at"))
    entries = _entries(source).withColumn("at", asked)
    both, close = W.with_closing(entries, "at")
    return W.run_batched(W.late_entries(both, visits), close=close).filter("entry_id is not null").select("entry_id", "mode", "final_method", "deferred")


register("late_entries", lambda t: _late(t, F.lit("2150-01-01").cast("timestamp")),
         """SELECT entry_id, CASE WHEN x.station_id IS NULL THEN 'normal' WHEN same_day THEN CASE WHEN late THEN 'olvido' ELSE 'normal' END
      WHEN n=0 THEN CASE WHEN late THEN 'olvido' ELSE 'normal' END WHEN late THEN 'otro_dia' ELSE 'quizas_replica' END AS mode,
    CASE WHEN mode IN ('otro_dia','quizas_replica') THEN 'registro_oportunista' ELSE x.method END AS final_method, mode<>'quizas_replica' AND late AS deferred
    FROM (SELECT en.*, sighting_date<>today AS late,
      (SELECT count(*) FROM live_event e WHERE e.station_id=en.station_id AND e.method=en.method) AS n,
      EXISTS(SELECT 1 FROM live_event e WHERE e.station_id=en.station_id AND e.method=en.method AND e.event_date=en.sighting_date) AS same_day FROM entries en) x""",
         entries=_ENTRIES)
_FOLDED = """WITH a AS (SELECT item_id, seq, queued_at, outcome, seq%17=0 AND op='upsert' AS gone FROM outbox_item),
    g AS (SELECT *, coalesce(sum((gone OR outcome='ok')::INT) OVER (PARTITION BY item_id ORDER BY queued_at, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a),
    n AS (SELECT *, CAST(coalesce(sum((NOT gone)::INT) OVER (PARTITION BY item_id, run ORDER BY queued_at, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INT) AS attempt FROM g),
    r AS (SELECT *, CASE WHEN gone THEN 'skipped' WHEN outcome='ok' THEN 'synced' WHEN outcome='conflict' THEN 'conflict'
      WHEN outcome='error' OR attempt>=8 THEN 'error' ELSE 'retry' END AS result FROM n),
    f AS (SELECT item_id, seq, queued_at, attempt, result, CAST(CASE WHEN result IN ('conflict','error') THEN 365*24*3600
      WHEN result='retry' THEN least(pow(2,attempt), 900) END AS BIGINT) AS wait_s FROM r)"""


def _outcomes(t, kind):
    answers = streamed(t, "events").outbox_item.withColumns({"at": F.col("queued_at"), "entity_exists": F.col("seq") % 17 != 0})
    return _timed(W.stream_outcomes, answers, "at").filter(F.col("kind") == kind)


register("stream_outcomes", lambda t: _outcomes(t, "answer").select("item_id", "seq", "attempt", "result", "wait_s"),
    f"SELECT * FROM ({_FOLDED} SELECT item_id, seq, attempt, result, wait_s FROM f)")
register("stream_outbox_log", lambda t: _outcomes(t, "log").select("item_id", "seq", F.timestamp_millis("at_ms").alias("at"), "attempt", F.col("result").alias("outcome")),
    f"""SELECT * FROM ({_FOLDED} SELECT item_id, seq, date_trunc('millisecond', queued_at) AS at, attempt,
    CASE result WHEN 'synced' THEN 'ok' ELSE result END AS outcome FROM f WHERE result<>'skipped')""")
register("stream_outbox_due", lambda t: _outcomes(t, "due").select("item_id", "seq", F.timestamp_millis("at_ms").alias("due_at"), "attempt"),
    f"""SELECT item_id, seq, due_at, attempt FROM ({_FOLDED} SELECT item_id, seq, attempt, date_trunc('millisecond', queued_at)+to_seconds(wait_s) AS due_at,
      date_trunc('millisecond', lead(queued_at) OVER (PARTITION BY item_id ORDER BY queued_at, seq)) AS next_at FROM f)
    WHERE due_at IS NOT NULL AND (next_at IS NULL OR next_at>=due_at)""")
_SAVED = """SELECT entry_id, CASE WHEN x.station_id IS NULL THEN 'normal' WHEN same_day THEN CASE WHEN late THEN 'olvido' ELSE 'normal' END
      WHEN n=0 THEN CASE WHEN late THEN 'olvido' ELSE 'normal' END WHEN late THEN 'otro_dia' ELSE 'quizas_replica' END AS mode,
    CASE WHEN mode IN ('otro_dia','quizas_replica') THEN 'registro_oportunista' ELSE x.method END AS final_method, mode<>'quizas_replica' AND late AS deferred
    FROM (SELECT en.*, sighting_date<>today AS late,
      (SELECT count(*) FROM live_event e WHERE e.station_id=en.station_id AND e.method=en.method AND e.event_date<=en.today) AS n,
      EXISTS(SELECT 1 FROM live_event e WHERE e.station_id=en.station_id AND e.method=en.method AND e.event_date=en.sighting_date) AS same_day FROM entries en) x"""
register("late_entries_as_saved", lambda t: _late(t, F.to_timestamp(F.concat("today", F.lit(" 23:59:59")))), _SAVED, entries=_ENTRIES)
