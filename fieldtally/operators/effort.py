"""Sampling effort, GPS tracks and relative abundance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.geo import EARTH_RADIUS_M, haversine_m, path_length_m
from fieldtally.functions.survey import effort_label, effort_unit, live
from fieldtally.functions.text import half_up
from fieldtally.operators.ordered import lag_by_bucket
from fieldtally.session import written


def effort_summary(events: DataFrame, *, now: Column | str = "2030-01-01 00:00:00") -> DataFrame:
    """Adds duration_min, effort_distance_m, unit, measured, incomplete and effort_label.

    Distance: the declared one, else the ``track`` array, else the ``waypoints`` array (two or
    more); both arrays are optional columns of ordered (lat, lon) structs.
    """
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    seconds = F.unix_timestamp(F.coalesce(F.col("ended_at"), moment)) - F.unix_timestamp("started_at")
    duration = F.greatest(F.lit(0), half_up(seconds / 60)).cast("bigint")
    duration = F.when(F.col("started_at").isNotNull(), duration)

    options = [F.col("distance_m").cast("double")]
    has_points = F.lit(False)
    if "track" in events.columns:
        options.append(F.when(F.size("track") > 0, path_length_m(F.col("track")).cast("double")))
        has_points = has_points | (F.size("track") > 0)
    if "waypoints" in events.columns:
        options.append(F.when(F.size("waypoints") > 1, path_length_m(F.col("waypoints")).cast("double")))
        has_points = has_points | (F.size("waypoints") > 0)
    distance = F.coalesce(*options)
    unit = effort_unit("method")

    measured = (
        F.col("started_at").isNotNull() | F.coalesce(has_points, F.lit(False))
        | F.col("effort_distance_m").isNotNull() | F.col("trap_nights").isNotNull()
    )
    incomplete = F.col("measured") & (
        ((F.col("unit") == "distancia") & F.col("effort_distance_m").isNull())
        | ((F.col("unit") == "trampas-noche") & F.col("trap_nights").isNull())
        | ((F.col("unit") == "duración") & F.col("duration_min").isNull())
    )
    return (
        events.withColumns({"duration_min": duration, "effort_distance_m": distance, "unit": unit})
        .withColumn("measured", measured)
        .withColumn("incomplete", incomplete)
        .withColumn(
            "effort_label",
            effort_label(
                F.col("unit"), F.col("measured"), F.col("duration_min"),
                F.col("effort_distance_m"), F.col("trap_nights"),
            ),
        )
    )


def relative_abundance(occurrences: DataFrame, events: DataFrame, *, now: str = "2030-01-01 00:00:00") -> DataFrame:
    """Individuals per km, per 100 trap-nights or per hour, for each event and taxon."""
    effort = effort_summary(events, now=now).select(
        "event_id", "unit", "effort_distance_m", "trap_nights", "duration_min"
    )
    totals = (
        live(occurrences)
        .groupBy("event_id", "taxon_id")
        .agg(F.sum(F.coalesce("individual_count", F.lit(0))).alias("individuals"))
    )
    base = (
        F.when(F.col("unit") == "distancia", F.col("effort_distance_m").cast("double"))
        .when(F.col("unit") == "trampas-noche", F.col("trap_nights").cast("double"))
        .when(F.col("unit") == "duración", F.col("duration_min").cast("double"))
    )
    scale = F.when(F.col("unit") == "distancia", 1000).when(F.col("unit") == "trampas-noche", 100).otherwise(60)
    label = (
        F.when(F.col("unit") == "distancia", "ind/km")
        .when(F.col("unit") == "trampas-noche", "ind/100 trampas-noche")
        .otherwise("ind/h")
    )
    usable = base.isNotNull() & (base != 0)
    return totals.join(effort, "event_id").select(
        "event_id", "taxon_id", "individuals",
        F.when(usable, half_up(F.col("individuals") / base * scale, 2)).alias("abundance"),
        F.when(usable, label).alias("abundance_unit"),
    )


def track_length(points: DataFrame, *, bucket_s: int = 86400) -> DataFrame:
    """Rounded metres per track out of long points (track_id, point_id, t_s, lat, lon).

    Long tracks are cut by time, so that one endless recording does not fill one task.
    """
    steps = lag_by_bucket(
        points.select("track_id", "t_s", "point_id", "lat", "lon"),
        ["track_id"], ["t_s", "point_id"], F.floor(F.col("t_s") / bucket_s), ["lat", "lon"],
    )
    metres = haversine_m("prev_lat", "prev_lon", "lat", "lon")
    # Whole micrometres make the sum independent of the order of partial sums.
    return (
        steps.groupBy("track_id")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.coalesce(F.sum(half_up(metres * 1e6).cast("bigint")), F.lit(0)).alias("_um"),
        )
        .select("track_id", "points", half_up(F.col("_um") / 1e6).cast("bigint").alias("length_m"))
    )


def waypoint_distance(points: DataFrame, *, bucket_s: int = 86400) -> DataFrame:
    """The same over marked points: null when a track has fewer than two."""
    return track_length(points, bucket_s=bucket_s).select(
        "track_id", F.when(F.col("points") >= 2, F.col("length_m")).alias("length_m")
    )


# --- accepting GPS points -----------------------------------------------------------------

MAX_ACCURACY_M = 30.0
MIN_STEP_M = 5.0
MAX_SPEED_MS = 5.0

FILTERED_SCHEMA = "track_id bigint, point_id bigint, t_s bigint, lat double, lon double, acc double, accepted boolean, reason string, chunk bigint, round int"
TAIL_SCHEMA = "track_id bigint, chunk bigint, tail struct<t_s double, lat double, lon double>"
CHUNK = ["track_id", "chunk"]
ENTRY = ["in_t", "in_lat", "in_lon"]


def metres_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    phi1, phi2 = math.radians(lat1), math.radians(lat2)
    h = (
        math.sin((phi2 - phi1) / 2) ** 2
        + math.cos(phi1) * math.cos(phi2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


def judge_point(last: tuple | None, point: tuple, limits: tuple = (MAX_ACCURACY_M, MIN_STEP_M, MAX_SPEED_MS)):
    """Reason to refuse a point (t, lat, lon, acc) given the last accepted one, or None."""
    t, lat, lon, acc = point
    max_acc, min_step, max_speed = limits
    if acc is not None and not math.isnan(acc) and acc > max_acc:
        return "precision"
    if last is None:
        return None
    step = metres_between(last[1], last[2], lat, lon)
    if step < min_step:
        return "sin-movimiento"
    seconds = t - last[0]
    if seconds > 0 and step / seconds > max_speed:
        return "salto-imposible"
    return None


def filter_track(points: DataFrame, *, chunk_s: int = 86400, max_rounds: int | None = None) -> DataFrame:
    """Accept or refuse each GPS point against the last *accepted* one.

    The rule is a sequential fold, so tracks are cut into time chunks that run in parallel, each entered with
    the last accepted point of the chunks before it. A first pass without entries tells each chunk's last
    accepted point and writes no point; then rounds follow, and each walks only the chunks whose entry has
    changed since they were walked. When no entry changes the answer is exactly the sequential one: every
    chunk's rows of the round that walked it last.
    """
    parts, walked = [], None
    for part, walked in track_rounds(points, chunk_s=chunk_s):
        parts.append(part)
        if max_rounds is not None and len(parts) > max_rounds:
            raise RuntimeError(f"track chunks did not settle in {max_rounds} rounds")
    judged = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        judged = judged.join(_keyed(walked.select(*CHUNK, "round")), _same_chunk() & (F.col("round") == F.col("k_round")), "left_semi")
    return judged.drop("chunk", "round")


def track_rounds(points: DataFrame, *, chunk_s: int = 86400) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Each round's walked points, and the round and entry with which every chunk was walked last."""
    rows = points.select("track_id", "point_id", "t_s", "lat", "lon", "acc").withColumn("chunk", F.floor(F.col("t_s") / chunk_s))
    alone = rows.withColumns({c: F.lit(None).cast("double") for c in ENTRY})
    tails = written(_in_order(alone).mapInPandas(_walk_tails, TAIL_SCHEMA), "track-tails")
    walked, number = None, 0
    while True:
        entry = _chunk_entries(tails)
        if walked is not None:
            before = _keyed(walked)
            entry = entry.join(before, _same_chunk()).filter(~F.struct(*ENTRY).eqNullSafe(F.struct(*[F.col(f"k_{c}").alias(c) for c in ENTRY]))).select(*CHUNK, *ENTRY)
        open_ = written(entry.withColumn("round", F.lit(number)), "track-open")
        if number and open_.isEmpty():
            return
        entered = rows.join(_keyed(open_), _same_chunk()).select(*rows.columns, *[F.col(f"k_{c}").alias(c) for c in (*ENTRY, "round")])
        part = written(_in_order(entered).mapInPandas(_walk_points, FILTERED_SCHEMA), "track-round")
        moment = F.when(F.col("accepted"), F.struct("t_s", "point_id"))
        new = part.groupBy(*CHUNK).agg(F.max_by(F.struct(F.col("t_s").cast("double").alias("t_s"), "lat", "lon"), moment).alias("tail"))
        settled = _keyed(open_.select(*CHUNK))
        tails = written(tails.join(settled, _same_chunk(), "left_anti").unionByName(new), "track-tails")
        walked = open_ if walked is None else written(walked.join(settled, _same_chunk(), "left_anti").unionByName(open_), "track-walked")
        yield part, walked
        number += 1


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"k_{c}") for c in df.columns])


def _same_chunk() -> Column:
    return F.col("track_id").eqNullSafe(F.col("k_track_id")) & F.col("chunk").eqNullSafe(F.col("k_chunk"))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CHUNK).sortWithinPartitions(*CHUNK, "t_s", "point_id")


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """Each batch of a sorted partition with its reasons, and the (track, chunk, last accepted) of the chunks it ends."""
    current = last = None
    for pdf in batches:
        reasons, ended = [], []
        for track, chunk, t, lat, lon, acc, in_t, in_lat, in_lon in zip(*(pdf[c] for c in ("track_id", "chunk", "t_s", "lat", "lon", "acc", *ENTRY))):
            key = (None if pd.isna(track) else track, None if pd.isna(chunk) else chunk)
            if key != current:
                if current is not None:
                    ended.append((*current, last))
                current = key
                last = None if pd.isna(in_t) else (in_t, in_lat, in_lon)
            reason = judge_point(last, (t, lat, lon, acc))
            reasons.append(reason)
            if reason is None:
                last = (t, lat, lon)
        yield pdf, reasons, ended
    if current is not None:
        yield pd.DataFrame(), [], [(*current, last)]


def _walk_tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, _, ended in _walk(batches):
        if ended:
            tails = [None if last is None else {"t_s": float(last[0]), "lat": last[1], "lon": last[2]} for *_, last in ended]
            yield pd.DataFrame({"track_id": pd.array([e[0] for e in ended], "Int64"), "chunk": pd.array([e[1] for e in ended], "Int64"), "tail": tails})


def _walk_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, reasons, _ in _walk(batches):
        if reasons:
            yield pdf[["track_id", "point_id", "t_s", "lat", "lon", "acc"]].assign(
                accepted=[r is None for r in reasons], reason=reasons, chunk=pdf["chunk"], round=pdf["round"])


def _chunk_entries(tails: DataFrame) -> DataFrame:
    """Last accepted point before each chunk: one row per chunk, carried over chunks without one."""
    from pyspark.sql import Window

    before = Window.partitionBy("track_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("tail", ignorenulls=True).over(before)
    return tails.select(*CHUNK, last["t_s"].alias("in_t"), last["lat"].alias("in_lat"), last["lon"].alias("in_lon"))
