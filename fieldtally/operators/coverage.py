"""Sampling plan: what was planned, done, not possible and still pending; late entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import vocab as V
from fieldtally.functions.survey import live, lookup, readable_date

CELL = ["station_id", "method"]


def plan_grid(stations: DataFrame, project_id=None) -> DataFrame:
    """One row per station and declared method."""
    rows = stations if project_id is None else stations.filter(F.col("project_id") == project_id)
    return rows.select("station_id", "station_code", "project_id", F.explode("methods").alias("method"))


def _campaign_events(events: DataFrame, campaign_id) -> DataFrame:
    rows = live(events)
    return rows if campaign_id is None else rows.filter(F.col("campaign_id") == campaign_id)


def chosen_events(events: DataFrame) -> DataFrame:
    """The event that speaks for each station and method.

    Read in id order, an event replaces the one before it when it was declared not performed
    or has a later date. Hence the winner is, among the events from the last not-performed one
    onwards, the first of the latest date: two mergeable aggregates instead of a fold.
    """
    last_refusal = (
        events.filter(~F.col("performed"))
        .groupBy(*CELL)
        .agg(F.max("event_id").alias("_from"))
    )
    relevant = events.join(last_refusal, CELL, "left").filter(
        F.col("_from").isNull() | (F.col("event_id") >= F.col("_from"))
    )
    payload = F.struct("event_id", "event_date", "performed", "not_performed_reason", "no_detections")
    per_day = relevant.groupBy(*CELL, "event_date").agg(F.min_by(payload, "event_id").alias("e"))
    return per_day.groupBy(*CELL).agg(F.max_by("e", "event_date").alias("e")).select(*CELL, "e.*")


def plan_coverage(stations: DataFrame, events: DataFrame, *, project_id=None, campaign_id=None) -> DataFrame:
    """Grid cells with their state: pendiente, realizado or no realizado."""
    chosen = chosen_events(_campaign_events(events, campaign_id))
    return plan_grid(stations, project_id).join(chosen, CELL, "left").select(
        "station_id", "station_code", "project_id", "method", "event_id", "event_date",
        F.when(F.col("event_id").isNull(), "pendiente")
        .when(~F.coalesce("performed", F.lit(True)), "no realizado")
        .otherwise("realizado")
        .alias("state"),
        F.col("not_performed_reason").alias("reason"),
        F.coalesce("no_detections", F.lit(False)).alias("no_detections"),
    )


def off_plan(stations: DataFrame, events: DataFrame, *, project_id=None, campaign_id=None,
             same_project_only: bool = False) -> DataFrame:
    """Live events outside the grid. ``same_project_only`` leaves other projects' events out."""
    rows = _campaign_events(events, campaign_id)
    if same_project_only and project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    return rows.join(plan_grid(stations, project_id).select(*CELL), CELL, "left_anti")


def plan_summary(coverage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Planned, done, not performed, pending and the share done, per group."""
    counted = lambda state: F.count_if(F.col("state") == state)
    return coverage.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("planned"),
        counted("realizado").alias("done"),
        counted("no realizado").alias("not_performed"),
        counted("pendiente").alias("pending"),
        F.coalesce(
            counted("realizado") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)
        ).alias("coverage"),
    )


def pending_plan(coverage: DataFrame) -> DataFrame:
    return coverage.filter(F.col("state") == "pendiente").orderBy("station_code", "method")


def resolve_entry(entries: DataFrame, events: DataFrame, *, current_year: int | None = None) -> DataFrame:
    """Where a sighting written down later belongs.

    ``entries``: entry_id, station_id, method, sighting_date, today. Adds mode, event_date,
    final_method, deferred, notice, alternative_label and alternative_method. History is
    reduced to one row per station and method, plus the exact days, before it is joined.
    """
    history = live(events)
    last_day = history.groupBy(*CELL).agg(F.max("event_date").alias("last_date"))
    days = history.select(*CELL, F.col("event_date").alias("sighting_date")).distinct().withColumn(
        "same_day", F.lit(True)
    )
    return route_entry(entries.join(last_day, CELL, "left").join(days, CELL + ["sighting_date"], "left"), current_year=current_year).select(
        *entries.columns, "mode", "event_date", "final_method", "deferred", "notice", "alternative_label", "alternative_method")


def route_entry(rows: DataFrame, *, current_year: int | None = None) -> DataFrame:
    """``resolve_entry`` for entries that know the ``last_date`` of their station and method, and whether they were
    visited the ``same_day``; a projection, so it holds for streams too."""
    columns = [c for c in rows.columns if c not in ("last_date", "same_day")]
    late = F.col("sighting_date") != F.col("today")
    unplaced = F.col("station_id").isNull() | F.col("method").isNull()
    year = F.year(F.col("today").cast("date")) if current_year is None else F.lit(current_year)
    name = lookup("method", V.METHOD_PHRASES, F.lit("muestreo"))
    said = readable_date("sighting_date", year)
    last = readable_date("last_date", year)

    mode = (
        F.when(unplaced, "normal")
        .when(F.col("same_day") & late, "olvido")
        .when(F.col("same_day"), "normal")
        .when(F.col("last_date").isNull() & late, "olvido")
        .when(F.col("last_date").isNull(), "normal")
        .when(late, "otro_dia")
        .otherwise("quizas_replica")
    )
    rows = rows.withColumn("mode", mode)
    outside = F.col("mode").isin("otro_dia", "quizas_replica")
    notice = (
        F.when(
            (F.col("mode") == "olvido") & F.col("same_day"),
            F.concat(F.lit("Se agrega al "), name, F.lit(" del "), said, F.lit(", anotado hoy.")),
        )
        .when(F.col("mode") == "olvido", F.concat(F.lit("Se guarda con fecha del "), said, F.lit(", no de hoy.")))
        .when(
            F.col("mode") == "otro_dia",
            F.concat(
                F.lit("El "), said, F.lit(" no hubo "), name, F.lit(" en esta estación (el último fue el "), last,
                F.lit("). Queda como registro oportunista del punto, fuera de ese muestreo."),
            ),
        )
        .when(
            F.col("mode") == "quizas_replica",
            F.concat(
                F.lit("El "), name, F.lit(" de esta estación fue el "), last,
                F.lit(", no hoy. Se guarda como registro oportunista del punto; si hoy volviste a hacer el"
                      " muestreo completo, cámbialo."),
            ),
        )
    )
    replica = F.col("mode") == "quizas_replica"
    return rows.select(
        *columns,
        "mode",
        F.col("sighting_date").alias("event_date"),
        F.when(outside, V.OPPORTUNISTIC).otherwise(F.coalesce("method", F.lit(V.OPPORTUNISTIC))).alias("final_method"),
        F.when(replica, F.lit(False)).otherwise(late).alias("deferred"),
        notice.alias("notice"),
        F.when(replica, F.concat(F.lit("Es un "), name, F.lit(" nuevo de hoy"))).alias("alternative_label"),
        F.when(replica, F.col("method")).alias("alternative_method"),
    )


def assign_events(drafts: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Give each draft the live event of its campaign, station, site, method and date.

    Missing events are created once per key with an id hashed from the key, so that a rerun
    after a lost executor gives the same ids. Returns ``drafts`` with event_id and ``created``.
    """
    keys = ["campaign_id", "station_id", "site_id", "method", "event_date"]
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined_key = F.concat_ws("|", *[as_text(k) for k in keys])
    existing = (
        live(events).select(joined_key.alias("event_key"), F.col("event_id").cast("string").alias("found_id"))
        .groupBy("event_key").agg(F.min("found_id").alias("found_id"))
    )
    keyed = drafts.withColumn("event_key", joined_key)
    matched = keyed.join(existing, "event_key", "left").withColumn(
        "event_id", F.coalesce("found_id", F.sha1("event_key"))
    )
    created = (
        matched.filter(F.col("found_id").isNull())
        .groupBy("event_id", *keys)
        .agg(F.min("event_time").alias("event_time"), F.count(F.lit(1)).alias("drafts"))
    )
    return {"drafts": matched.drop("event_key", "found_id"), "created": created}
