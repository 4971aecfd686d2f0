"""Keyed streams with timers: GPS tracks that close, outbox items that wake, late sightings against visits saved in the stream.

Each processor lets rows wait until the watermark has passed them, so that order of arrival and the cut into
micro-batches don't matter, then takes them in order of time. One event-time timer a key says when there is
something to do next; a key with nothing to wait for has no timer, and one that has ended has no state.
The state store must be one with timers (RocksDB); ``keyed`` sets it where the session has the default.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldtally.operators.changes import MAX_ATTEMPTS, MAX_BACKOFF_S, PARK_S
from fieldtally.operators.coverage import route_entry
from fieldtally.operators.effort import judge_point, metres_between

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


READ = {"long": int, "double": float, "boolean": bool, "string": str}


def _plain(value, kind: str):
    """A cell of a pandas frame as a value of a state row."""
    return None if value is None or value != value else READ[kind](value)


class Ordered(StatefulProcessor):
    """Rows of a key in order of time, each once the watermark has passed it. ``WAITING`` begins with ``at`` (ms)."""

    WAITING = "at long"
    OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.timer = handle.getValueState("timer", "at long")
        self.columns = [tuple(c.split()) for c in self.WAITING.split(", ")]
        self.out = [c.split()[0] for c in self.OUT.split(", ")]
        self.whole = [c.split()[0] for c in self.OUT.split(", ") if c.split()[1] in ("long", "int")]
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Makes the processor's own states."""

    def take(self, key: tuple, rows: list[tuple], now: int) -> Iterator[tuple]:
        """Output of the rows up to ``now``, in order, and of what falls due by then."""
        raise NotImplementedError

    def next_due(self) -> int | None:
        """When the key has something to do even if no row comes."""
        return None

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for pdf in rows:
            if len(pdf):
                own = list(zip(*([_plain(v, kind) for v in pdf[c]] for c, kind in self.columns)))
                self.waiting.appendList(own)
                least = min(row[0] for row in own)
                first = least if first is None else min(first, least)
        known = self.timer.get()
        if first is not None and (known is None or first + 1 < known[0]):
            self._wake(max(first, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()  # this one is gone when the call ends
        ready, later = [], []
        for row in self.waiting.get():
            (ready if row[0] <= now else later).append(tuple(row))
        ready.sort(key=lambda row: tuple((v is not None, v) for v in row))
        out = list(self.take(key, ready, now))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        dues = [d for d in (min((row[0] for row in later), default=None), self.next_due()) if d is not None]
        if dues:
            self._wake(max(min(dues), now) + 1)
        if out:
            frame = pd.DataFrame(out, columns=self.out)
            yield frame.astype({c: "Int64" for c in self.whole})

    def _wake(self, at: int) -> None:
        known = self.timer.get()
        if known is not None:
            self.handle.deleteTimer(known[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def _with_timers(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)


def keyed(rows: DataFrame, keys: list[str], processor: Ordered, time: str, watermark: str) -> DataFrame:
    """``rows`` through a processor, by ``keys``, on event time."""
    _with_timers(rows.sparkSession)
    # Whole numbers go as text: beside a null, pandas would hold them as floats.
    whole = {c: F.col(c).cast("string") for c, kind in map(str.split, processor.WAITING.split(", ")) if kind == "long" and c != "at"}
    timed = rows.withWatermark(time, watermark).withColumn("at", F.unix_millis(time)).withColumns(whole)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, processor.OUT, "append", "eventTime")


# --- GPS tracks ---------------------------------------------------------------------------


class FollowTrack(Ordered):
    """Accepts points against the last accepted one; a track silent for ``idle_ms`` closes and its state ends."""

    WAITING = "at long, point_id long, t double, lat double, lon double, acc double"
    OUT = "track_id long, point_id long, accepted boolean, reason string, length_m double, points long, closed_at long"

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def open(self, handle):
        self.track = handle.getValueState("track", "seen long, points long, t double, lat double, lon double, metres double")

    def take(self, key, rows, now):
        seen, points, *last, metres = self.track.get() or (None, 0, None, None, None, 0.0)
        for at, point_id, t, lat, lon, acc in rows:
            if seen is not None and at - seen > self.idle_ms:
                yield key[0], None, None, None, metres, points, seen + self.idle_ms
                points, last, metres = 0, [None] * 3, 0.0
            reason = judge_point(None if last[0] is None else tuple(last), (t, lat, lon, acc))
            if reason is None:
                metres += 0.0 if last[0] is None else metres_between(last[1], last[2], lat, lon)
                last = [t, lat, lon]
            seen, points = at, points + 1
            yield key[0], point_id, reason is None, reason, metres, points, None
        if seen is not None and now - seen > self.idle_ms:
            yield key[0], None, None, None, metres, points, seen + self.idle_ms
            self.track.clear()
        elif seen is not None:
            self.track.update((seen, points, *last, metres))

    def next_due(self):
        known = self.track.get()
        return known and known[0] + self.idle_ms


def stream_track(points: DataFrame, *, idle: str = "12 hours", watermark: str = "10 minutes", time: str = "at_time") -> DataFrame:
    """Points (track_id, point_id, t_s, lat, lon, acc) as accepted or refused, and one row a track when it closes.

    The rule is that of ``filter_track``. Rows with ``closed_at`` (ms) end a track that was silent for ``idle``:
    its length and number of points. A later point opens it anew. The state of a track is its last accepted
    point, its totals, and the points the watermark hasn't passed.
    """
    rows = points if time in points.columns else points.withColumn(time, F.timestamp_seconds("t_s"))
    rows = rows.select("track_id", "point_id", F.col("t_s").cast("double").alias("t"), "lat", "lon", "acc", time)
    return keyed(rows, ["track_id"], FollowTrack(int(pd.Timedelta(idle).total_seconds() * 1000)), time, watermark)


# --- outbox -------------------------------------------------------------------------------


class FoldOutcomes(Ordered):
    """Attempts, result and wait of each answer, its log row, and a row when a waiting item falls due."""

    WAITING = "at long, seq long, outcome string, op string, entity_exists boolean"
    OUT = "item_id string, kind string, seq long, at_ms long, attempt int, result string, wait_s long"

    def open(self, handle):
        self.item = handle.getValueState("item", "attempts int, seq long, due long")

    def take(self, key, rows, now):
        attempts, last, due = self.item.get() or (0, None, None)
        for at, seq, outcome, op, exists in rows:
            if due is not None and due <= at:
                yield key[0], "due", last, due, attempts, None, None
            due, last, wait = None, seq, None
            if not exists and op == "upsert":
                yield key[0], "answer", seq, at, attempts, "skipped", None
                attempts = 0  # the item leaves the queue; queued again it starts over
                continue
            attempts += 1
            if outcome in ("ok", "conflict"):
                result, wait = ("synced", None) if outcome == "ok" else ("conflict", PARK_S)
            elif outcome == "error" or attempts >= MAX_ATTEMPTS:
                result, wait = "error", PARK_S
            else:
                result, wait = "retry", min(2**attempts, MAX_BACKOFF_S)
            yield key[0], "answer", seq, at, attempts, result, wait
            yield key[0], "log", seq, at, attempts, "ok" if result == "synced" else result, None
            due = None if wait is None else at + 1000 * wait
            attempts = 0 if result == "synced" else attempts
        if due is not None and due <= now:
            yield key[0], "due", last, due, attempts, None, None
            due = None
        if attempts or due is not None:
            self.item.update((attempts, last, due))
        else:
            self.item.clear()

    def next_due(self):
        known = self.item.get()
        return known and known[2]


def stream_outcomes(answers: DataFrame, *, watermark: str = "10 minutes", time: str = "at") -> DataFrame:
    """Answers (item_id, seq, at, op, outcome, entity_exists) folded by item; ``kind`` tells the rows apart.

    ``answer``: attempt count, result and wait in seconds. ``log``: what the sync log keeps of it; an item that
    was skipped leaves none. ``due``: the moment a retried or parked item wakes, unless an answer came before.
    An item that was synced or skipped has no state.
    """
    rows = answers.select("item_id", "seq", "outcome", "op", F.coalesce("entity_exists", F.lit(True)).alias("entity_exists"), F.col(time).cast("timestamp").alias("at_time"))
    return keyed(rows, ["item_id"], FoldOutcomes(), "at_time", watermark)


# --- late sightings -----------------------------------------------------------------------

#: Rows of which a task makes lots at once.
LOT_ROWS = 400_000
#: Days of a bucket lie in so many values, so that a few rows don't read the days of all its stations.
DRAWERS = 4
#: Rows without a time come before all others; no day is the same as one that isn't known.
NO_TIME = -(2**52)


def _lots(columns: list[str]):
    """Rows as lots: those of a bucket that a task meets close together, column by column in one packed value."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LOT_ROWS:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("bucket").combine_chunks()
        bucket, at = table["bucket"].to_numpy(), table["at"].to_numpy()
        begins = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        ends = [*begins[1:].tolist(), len(bucket)]
        cells = [table[c].chunk(0) for c in columns]
        rows = [_packed([c.slice(i, j - i).to_pylist() for c in cells]) for i, j in zip(begins.tolist(), ends)]
        return pa.RecordBatch.from_pydict({"bucket": bucket[begins], "least": np.minimum.reduceat(at, begins), "last": np.maximum.reduceat(at, begins), "rows": rows})

    return deal


class MeetVisits(Ordered):
    """Each sighting with what its station and method have seen so far: the last day, and whether its own day is one.

    A key is a bucket of stations and methods, and its rows come as lots, as a call for each row or station costs more
    than the row. Columns of a lot are place (station and method), at, then entry, sighting date and today of
    sightings, or day and ``removed`` of visits.
    """

    OUT = "entry_id long, station_id long, method string, sighting_date string, today string, last_date string, same_day boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.lots = handle.getListState("lots", "least long, rows binary")
        self.days = handle.getMapState("days", "drawer int", "days binary")

    def handleInputRows(self, key, rows, timerValues):
        lots = [lot for pdf in rows for lot in zip(pdf["least"].tolist(), pdf["rows"])]
        if lots:
            self.lots.appendList(lots)
            first, known = min(least for least, _ in lots), self.timer.get()
            if known is None or first + 1 < known[0]:
                self._wake(max(first, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()  # this one is gone when the call ends
        ready, later = {}, []
        for least, lot in self.lots.get():
            if least > now:
                later.append((least, lot))
                continue
            rest = []
            for row in zip(*_unpacked(lot)):
                place, at, *said = row
                if at > now:
                    rest.append(row)
                else:
                    ready.setdefault(place, []).append((4 * at + _turn(said), said))
            if rest:
                later.append((min(row[1] for row in rest), _packed([*zip(*rest)])))
        if later:
            self.lots.put(later)
            self._wake(max(min(least for least, _ in later), now) + 1)
        else:
            self.lots.clear()
        out = self._met(ready)
        if out:
            frame = pd.DataFrame(dict(zip([c.split()[0] for c in self.OUT.split(", ")], zip(*out))))
            yield frame.astype({"entry_id": "Int64", "station_id": "Int64"})

    def _met(self, ready: dict[str, list[tuple]]) -> list[tuple]:
        """Output of the rows of each place; the days are read and kept drawer by drawer."""
        drawers, out = {}, []
        for place in ready:
            drawers.setdefault(zlib.crc32(place.encode()) % DRAWERS, []).append(place)
        for drawer, places in drawers.items():
            known = self.days.getValue((drawer,))
            kept, moved = _unpacked(known[0]) if known else {}, False
            for place in places:
                station, method = json.loads(place)
                station = None if station is None else int(station)
                # A day with one visit stands alone, others with their number.
                days = dict(d if isinstance(d, list) else (d, 1) for d in kept.get(place, ()))
                rows, changed, last = ready[place], False, max(days, key=_day, default=None)
                rows.sort(key=itemgetter(0))
                for _, said in rows:
                    if len(said) == 3 or said[1] is None:
                        entry_id, sighting_date, today = said if len(said) == 3 else (None, None, None)
                        out.append((entry_id, station, method, sighting_date, today, last, True if sighting_date is not None and sighting_date in days else None))
                        continue
                    changed, day = True, said[0]
                    n = days.get(day, 0) + (-1 if said[1] else 1)
                    if n > 0:
                        days[day] = n
                        last = max(last, day, key=_day)
                    else:
                        days.pop(day, None)
                        last = max(days, key=_day, default=None) if day == last else last
                if changed:
                    moved = True
                    kept[place] = [d if n == 1 else (d, n) for d, n in days.items()]
                    if not days:
                        del kept[place]
            if moved and kept:
                self.days.updateValue((drawer,), (_packed(kept),))
            elif moved and known:
                self.days.removeKey((drawer,))
        return out


def _turn(said: list) -> int:
    """Of one moment, visits come before sightings, and saved ones before deleted ones; what has no id comes first."""
    if len(said) == 3:
        return 0 if said[0] is None else 3
    return 0 if said[1] is None else 2 if said[1] else 1


def _day(day: str | None) -> tuple:
    return day is not None, day or ""


def _packed(value) -> bytes:
    return zlib.compress(json.dumps(value, separators=(",", ":")).encode(), 1)


def _unpacked(packed: bytes):
    return json.loads(zlib.decompress(packed))


def late_entries(entries: DataFrame, visits: DataFrame, *, salts: int = 4, watermark: str = "10 minutes", time: str = "at", buckets: int = 4096) -> DataFrame:
    """The stream of late sightings, each routed against the visits saved before it; none is dropped.

    ``entries``: entry_id, station_id, method, sighting_date, today, at. ``visits``: station_id, method,
    event_date, at, removed (false for a visit saved, true for one deleted); both are streams. A visit of the same moment
    counts. State is kept for ``buckets`` of stations and methods. Sightings of one station and method are dealt over
    ``salts`` buckets, each with a copy of the visits' days, so that a crowded station isn't one task. Sightings without
    station or method need no visits and go past the state. A lot of rows is behind the watermark when all of its rows are.
    """
    unplaced = F.col("station_id").isNull() | F.col("method").isNull()
    station, copies = F.col("station_id").cast("long"), F.lit(min(salts, buckets))
    base = F.pmod(F.xxhash64(station, "method"), F.lit(buckets))
    place = F.to_json(F.array(station.cast("string"), "method")).alias("place")
    at = F.coalesce(F.unix_millis(F.col(time).cast("timestamp")), F.lit(NO_TIME)).alias("at")
    lots = "bucket long, least long, last long, rows binary"
    # A closing row (of ``with_closing``) has no values but its time; it must reach the watermark of the state.
    asked = entries.filter(~unplaced | F.col("entry_id").isNull()).select(
        F.pmod(base + F.pmod(F.xxhash64("entry_id"), copies), F.lit(buckets)).alias("bucket"), place, at,
        F.col("entry_id").cast("long").alias("entry_id"), "sighting_date", "today").mapInArrow(_lots(["place", "at", "entry_id", "sighting_date", "today"]), lots)
    # The copies of one station and method lie in different buckets, so a bucket has its visits once.
    saved = visits.filter(~unplaced).select(base.alias("bucket"), place, at, "event_date", "removed").mapInArrow(_lots(["place", "at", "event_date", "removed"]), lots)
    saved = saved.withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).select(F.pmod(F.col("bucket") + F.col("salt"), F.lit(buckets)).alias("bucket"), "least", "last", "rows")
    timed = asked.unionByName(saved).withColumn("at_time", F.timestamp_millis(F.nullif("last", F.lit(NO_TIME)))).drop("last").withWatermark("at_time", watermark)
    _with_timers(entries.sparkSession)
    met = timed.groupBy("bucket").transformWithStateInPandas(MeetVisits(), MeetVisits.OUT, "append", "eventTime")
    loose = entries.filter(unplaced).select(
        F.col("entry_id").cast("long"), station.alias("station_id"), "method", "sighting_date", "today",
        F.lit(None).cast("string").alias("last_date"), F.lit(None).cast("boolean").alias("same_day"))
    return route_entry(met.unionByName(loose))
