"""Change data: audit differences, folding a change log, effort closing and the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.survey import live


def audit_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str],
               ignore: tuple[str, ...] = ("track",)) -> DataFrame:
    """Changed fields per row as map(field -> struct(before, after)); unchanged rows give nothing.

    Values travel as JSON text so that nested columns compare like flat ones.
    """
    compared = [f for f in fields if f not in ignore]
    as_map = lambda: F.create_map(
        *[x for f in compared for x in (F.lit(f), F.get_json_object(F.to_json(F.struct(F.col(f).alias("v"))), "$.v"))]
    )
    b = before.select(key, as_map().alias("b"))
    a = after.select(key, as_map().alias("a"))
    zipped = F.map_zip_with("b", "a", lambda _, x, y: F.struct(x.alias("before"), y.alias("after")))
    changed = F.map_filter(zipped, lambda _, v: ~v["before"].eqNullSafe(v["after"]))
    return a.join(b, key).select(key, changed.alias("changes")).filter(F.size("changes") > 0)


def audit_rows(diff: DataFrame, key: str) -> DataFrame:
    """The same differences in long form: key, field, before, after."""
    return diff.select(key, F.explode("changes").alias("field", "v")).select(
        key, "field", F.col("v.before").alias("before"), F.col("v.after").alias("after")
    )


def apply_changes(log: DataFrame) -> DataFrame:
    """Fold a change log (entity_id, at, seq, op, payload) into one current row per entity.

    Every change adds one revision. A delete marks the row, later changes do not unmark it.
    A review sets the state, an update resets nothing. Only mergeable aggregates: an entity with
    a third of all changes is reduced before the shuffle.
    """
    order = F.struct("at", "seq")
    at_if = lambda op, c: F.max_by(F.when(F.col("op") == op, F.col(c)), F.when(F.col("op") == op, order))
    return log.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("revision"),
        F.max_by("payload", F.when(F.col("op").isin("create", "update"), order)).alias("payload"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        F.max(F.when(F.col("op") == "delete", F.col("at"))).alias("deleted_at"),
        F.when(F.count_if(F.col("op") == "review") > 0, "revisado").otherwise("terreno").alias("review_state"),
        at_if("review", "at").alias("reviewed_at"),
    )


def set_review_state(occurrences: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply (occurrence_id, state, by, at, seq): the newest request wins; terreno clears the reviewer."""
    newest = requests.groupBy("occurrence_id").agg(
        F.max_by(F.struct("state", "by", "at"), F.struct("at", "seq")).alias("q")
    )
    back = F.col("q.state") == "terreno"
    return occurrences.join(newest, "occurrence_id", "left").select(
        "occurrence_id",
        F.coalesce("q.state", "review_state").alias("review_state"),
        F.when(~back, F.col("q.by")).alias("reviewed_by"),
        F.when(~back, F.col("q.at")).alias("reviewed_at"),
    )


def duplicate_records(occurrences: DataFrame, requests: DataFrame) -> DataFrame:
    """Copies of records (occurrence_id, request_no, time): new id and time, no media, no utterance."""
    new_id = F.sha1(F.concat_ws("|", "occurrence_id", F.col("request_no").cast("string")))
    copied = occurrences.join(requests, "occurrence_id")
    keep = [c for c in occurrences.columns
            if c not in ("occurrence_id", "dwc_occurrence_id", "media_ids", "occurrence_time", "source", "utterance")]
    return copied.select(
        new_id.alias("occurrence_id"),
        F.concat(F.regexp_replace("dwc_occurrence_id", r":occ:.*$", ":occ:"), new_id).alias("dwc_occurrence_id"),
        F.array().cast("array<string>").alias("media_ids"),
        F.col("time").alias("occurrence_time"),
        F.lit("duplicado").alias("source"),
        F.lit(None).cast("string").alias("utterance"),
        *keep,
    )


def undo_batch(occurrences: DataFrame, batches: DataFrame) -> DataFrame:
    """Soft-delete every live record of the given batches (batch_id, at)."""
    return (
        occurrences.join(batches.select("batch_id", F.col("at").alias("_at")).dropDuplicates(["batch_id"]), "batch_id", "left")
        .withColumn("deleted_at", F.coalesce("deleted_at", "_at"))
        .drop("_at")
    )


def attach_media(occurrences: DataFrame, media: DataFrame) -> DataFrame:
    """Append media (media_id, occurrence_id, seq) to their records; each addition is a revision."""
    added = media.groupBy("occurrence_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "media_id"))).alias("_new")
    )
    return occurrences.join(added, "occurrence_id", "left").select(
        "occurrence_id",
        F.concat("media_ids", F.coalesce(F.col("_new.media_id"), F.array().cast("array<string>"))).alias("media_ids"),
        F.coalesce(F.size("_new"), F.lit(0)).alias("added"),
    )


def close_effort(events: DataFrame, occurrences: DataFrame, requests: DataFrame) -> DataFrame:
    """Close sampling (event_id, ended_at, no_detections): without an explicit answer, an event
    with no live record is marked as having no detections."""
    seen = live(occurrences).select("event_id").distinct().withColumn("_seen", F.lit(True))
    closing = requests.select(
        "event_id", F.col("ended_at").alias("_end"), F.col("no_detections").alias("_said"), F.lit(True).alias("_close")
    )
    rows = events.join(closing, "event_id", "left").join(seen, "event_id", "left")
    said = F.coalesce("_said", F.col("_seen").isNull())
    return rows.select(
        "event_id",
        F.when(F.col("_close"), F.col("_end")).otherwise(F.col("ended_at")).alias("ended_at"),
        F.when(F.col("_close"), said).otherwise(F.coalesce("no_detections", F.lit(False))).alias("no_detections"),
    )


def patch_events(events: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Keyed upsert of event attributes: the newest non-null value per field wins.

    ``patches``: event_id, seq and any of ``fields``. Serves both a not-performed report
    (performed, not_performed_reason) and a point header (weather, slope_aspect).
    """
    newest = patches.groupBy("event_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields]
    )
    rows = events.join(newest, "event_id", "left")
    return rows.select(
        *[c if c not in fields else F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in events.columns]
    )


def commit_tables(drafts: DataFrame, namespace: str = "survey", project_code: str = "project_code") -> dict[str, DataFrame]:
    """Accepted drafts with their event (see ``assign_events``) as the four tables they are stored in.

    Drafts with a blocker (``can_save`` false) or without project, campaign, station or method
    are left out. Ids hash the utterance and the position, so that reruns give the same rows.
    """
    from fieldtally.functions.survey import dwc_id, evidence_kind

    complete = F.lit(True)
    for c in ("project_id", "campaign_id", "station_id", "method"):
        complete = complete & F.col(c).isNotNull()
    kept = drafts.filter(F.col("can_save") & complete)
    oid = F.sha1(F.concat_ws("|", F.col("utterance_id").cast("string"), F.col("obs_no").cast("string")))
    occurrence = kept.select(
        oid.alias("occurrence_id"),
        dwc_id(namespace, project_code, "occ", oid).alias("dwc_occurrence_id"),
        "event_id", "occurrence_time", "taxon_id",
        F.when(F.col("taxon_id").isNull(), F.col("verbatim_taxon")).alias("verbatim_taxon"),
        F.coalesce("record_type", F.lit("Individuo")).alias("record_type"),
        evidence_kind("record_type").alias("evidence_kind"),
        "individual_count", "sex", "life_stage", "behaviour", "notes", "pending_fields",
        F.lit("voz").alias("source"),
        F.col("utterance_id").cast("string").alias("batch_id"),
        F.lit("terreno").alias("review_state"), F.lit(1).alias("revision"),
        F.lit("pending").alias("sync_state"), "playback_response",
    )
    measurement = occurrence.filter(F.col("playback_response").isNotNull()).select(
        "occurrence_id", F.lit("respuestaPlayback").alias("measurement_type"),
        F.col("playback_response").alias("measurement_value"),
    )
    audit = occurrence.select(
        F.lit("occurrence").alias("entity"), F.col("occurrence_id").alias("entity_id"), F.lit("create").alias("action")
    )
    outbox = occurrence.select(
        F.concat(F.lit("occurrence:"), F.col("occurrence_id")).alias("item_id"), F.lit("upsert").alias("op"),
        F.col("revision"),
    )
    return {"occurrence": occurrence.drop("playback_response"), "measurement": measurement, "audit": audit, "outbox": outbox}


# --- outbox -------------------------------------------------------------------------------

MAX_ATTEMPTS = 8
MAX_BACKOFF_S = 900
PARK_S = 365 * 24 * 3600


def compact_outbox(queue: DataFrame) -> DataFrame:
    """One row per item, the newest; it starts over with no attempts."""
    newest = F.max_by(F.struct("entity", "entity_id", "op", "queued_at", "seq"), F.struct("queued_at", "seq"))
    return queue.groupBy("item_id").agg(newest.alias("q")).select("item_id", "q.*")


def due_items(queue: DataFrame, now) -> DataFrame:
    """Items whose retry moment has come, events before anything else."""
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return queue.filter(F.col("next_attempt_at") <= moment).orderBy(
        (F.col("entity") == "event").desc(), "item_id"
    )


def backoff_s(attempt):
    """2, 4, 8 ... seconds, at most a quarter of an hour."""
    return F.least(F.pow(F.lit(2.0), attempt).cast("bigint"), F.lit(MAX_BACKOFF_S).cast("bigint"))


def _answered(queue: DataFrame) -> DataFrame:
    """The queue with what each answer comes to, and the number of the attempt."""
    attempt = F.col("attempts") + 1
    gone = ~F.coalesce("entity_exists", F.lit(True)) & (F.col("op") == "upsert")
    exhausted = (attempt >= MAX_ATTEMPTS) | (F.col("outcome") == "error")
    result = (
        F.when(gone, "skipped")
        .when(F.col("outcome") == "ok", "synced")
        .when(F.col("outcome") == "conflict", "conflict")
        .when(exhausted, "error")
        .otherwise("retry")
    )
    return queue.withColumns({"result": result, "attempt": attempt})


def fold_outcomes(queue: DataFrame, *, now) -> DataFrame:
    """Next state of each attempted item (item_id, op, attempts, outcome, entity_exists).

    The network call lies outside: its answer is the ``outcome`` column.
    """
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    rows = _answered(queue)
    wait = F.when(F.col("result").isin("conflict", "error"), F.lit(PARK_S).cast("bigint")).when(
        F.col("result") == "retry", backoff_s(F.col("attempt"))
    )
    return rows.select(
        "item_id", "attempt", "result",
        F.col("result").isin("skipped", "synced").alias("removed"),
        F.when(F.col("result") == "synced", "synced").when(F.col("result") == "retry", "pending")
        .when(F.col("result").isin("conflict", "error"), "error").alias("sync_state"),
        F.when(wait.isNotNull(), F.timestamp_seconds(F.unix_timestamp(moment) + wait)).alias("next_attempt_at"),
    )


def sync_log(queue: DataFrame, *, now) -> DataFrame:
    """The log row that each answer leaves (at, direction, entity, entity_id, outcome, attempt, message); a skipped item leaves none.

    ``message`` is what the other side said where it refused, from the queue's ``message`` if it has one.
    """
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    said = F.col("message") if "message" in queue.columns else F.lit(None).cast("string")
    refused = F.col("result") != "synced"
    return _answered(queue).filter(F.col("result") != "skipped").select(
        moment.alias("at"), F.lit("push").alias("direction"), "entity", "entity_id",
        F.when(refused, F.col("result")).otherwise("ok").alias("outcome"), "attempt", F.when(refused, said).alias("message"))


def sync_report(folded: DataFrame) -> DataFrame:
    return folded.agg(
        F.count_if(F.col("result") != "skipped").alias("attempted"),
        F.count_if(F.col("result") == "synced").alias("synced"),
        F.count_if(F.col("result") == "conflict").alias("conflicts"),
        F.count_if(F.col("result").isin("retry", "error")).alias("failed"),
        F.count_if(F.col("result") == "skipped").alias("skipped"),
    )


def sync_status(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count_if(F.col("last_error").isNull()).alias("pending"),
        F.count_if(F.col("last_error").isNotNull() & (F.col("last_error") != "conflicto")).alias("errored"),
        F.count_if(F.col("last_error") == "conflicto").alias("conflicts"),
    )


def retry_failed(queue: DataFrame, now) -> DataFrame:
    """Rows with an error start over: no attempts, due now."""
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    failed = F.col("last_error").isNotNull()
    return queue.withColumns(
        {
            "retried": failed,
            "attempts": F.when(failed, F.lit(0)).otherwise(F.col("attempts")),
            "next_attempt_at": F.when(failed, moment).otherwise(F.col("next_attempt_at")),
            "last_error": F.when(~failed, F.col("last_error")),
        }
    )
