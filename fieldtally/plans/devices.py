"""Several devices: merging, change logs and the outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators import changes as H
from fieldtally.operators import merge as M
from fieldtally.operators import quality as Q
from fieldtally.plans.registry import register
from fieldtally.plans.views import epoch_us

NOW = "2024-01-20 00:00:00"

_PAIR = """SELECT coalesce(l.id, r.id) AS id, l.id AS lid, r.id AS rid, l.amount AS la, r.amount AS ra,
  l.station_id AS ls, r.station_id AS rs, l.event_date AS ld, r.event_date AS rd, l.recorded_by AS lo, r.recorded_by AS ro
  FROM backup_local l FULL OUTER JOIN backup_incoming r ON l.id=r.id"""

register("merge_preview", lambda t: M.merge_preview(t.backup("local"), t.backup("incoming")),
         """SELECT count(*) FILTER (lid IS NULL) AS new_rows, count(*) FILTER (lid IS NOT NULL) AS already_there,
    count(*) FILTER (lid IS NOT NULL AND la<>ra) AS in_conflict
    FROM (SELECT r.id, l.id AS lid, l.amount AS la, r.amount AS ra FROM backup_incoming r LEFT JOIN backup_local l USING (id)
      WHERE r.deleted_at IS NULL)""")
for _mode in ("fusionar", "reemplazar"):
    _first, _second = ("l", "r") if _mode == "fusionar" else ("r", "l")
    _both = ("CASE WHEN la<>ra THEN 'conflict' ELSE 'skipped' END" if _mode == "fusionar" else "'replaced'")
    register(f"merge_backups_{_mode}", lambda t, mode=_mode: M.merge_backups(t.backup("local"), t.backup("incoming"), mode=mode).select(
        "id", "station_id", "amount", "action"),
        f"""SELECT id, coalesce({_first}s,{_second}s) AS station_id, coalesce({_first}a,{_second}a) AS amount,
    CASE WHEN rid IS NULL THEN 'local' WHEN lid IS NULL THEN 'inserted' ELSE {_both} END AS action FROM paired""", paired=_PAIR)
register("merge_report", lambda t: M.merge_report(M.merge_backups(t.backup("local"), t.backup("incoming"))),
         """SELECT count(*) FILTER (lid IS NULL) AS inserted, count(*) FILTER (lid IS NOT NULL AND rid IS NOT NULL) AS skipped,
    count(*) FILTER (la<>ra) AS conflicts FROM paired""", paired=_PAIR)
register("merge_reach", lambda t: M.merge_reach(t.backup("incoming")),
         """SELECT DISTINCT 'day' AS what, event_date AS value FROM backup_incoming WHERE deleted_at IS NULL
    UNION SELECT DISTINCT 'station', CAST(station_id AS VARCHAR) FROM backup_incoming WHERE deleted_at IS NULL
    UNION SELECT DISTINCT 'observer', recorded_by FROM backup_incoming WHERE recorded_by IS NOT NULL""")

_DEV = """SELECT o.occurrence_id, o.taxon_id, o.verbatim_taxon, o.occurrence_minute AS m, o.occurrence_time, e.station_id,
  substr(e.event_date,1,7) AS ym, coalesce(e.recorded_by,'') AS obs, o.event_id%2 AS side
  FROM live_occ o JOIN event e USING (event_id)"""
register("double_counts", lambda t: M.double_counts(t.device("a"), t.device("b")).select(
    "taxon", "station_id", "local_id", "incoming_id", "local_observer", "incoming_observer"),
    """SELECT coalesce(CAST(a.taxon_id AS VARCHAR), a.verbatim_taxon) AS taxon, a.station_id, b.occurrence_id AS local_id,
    a.occurrence_id AS incoming_id, CASE WHEN b.obs='' THEN 'sin observador' ELSE b.obs END AS local_observer,
    CASE WHEN a.obs='' THEN 'sin observador' ELSE a.obs END AS incoming_observer
    FROM (SELECT x.*, unnest([x.m//30-1, x.m//30, x.m//30+1]) AS slot FROM dev x WHERE side=0) a
    JOIN (SELECT *, m//30 AS own FROM dev WHERE side=1) b ON a.station_id=b.station_id AND a.ym=b.ym AND a.slot=b.own AND a.taxon_id=b.taxon_id
    WHERE abs(a.m-b.m)<=30 AND NOT (a.obs<>'' AND a.obs=b.obs)
    UNION ALL SELECT coalesce(CAST(a.taxon_id AS VARCHAR), a.verbatim_taxon), a.station_id, b.occurrence_id, a.occurrence_id,
    CASE WHEN b.obs='' THEN 'sin observador' ELSE b.obs END, CASE WHEN a.obs='' THEN 'sin observador' ELSE a.obs END
    FROM (SELECT x.*, unnest([x.m//30-1, x.m//30, x.m//30+1]) AS slot FROM dev x WHERE side=0) a
    JOIN (SELECT *, m//30 AS own FROM dev WHERE side=1) b ON a.station_id=b.station_id AND a.ym=b.ym AND a.slot=b.own AND a.verbatim_taxon=b.verbatim_taxon
    WHERE (a.taxon_id IS NULL OR b.taxon_id IS NULL) AND abs(a.m-b.m)<=30 AND NOT (a.obs<>'' AND a.obs=b.obs)""", dev=_DEV)


def _candidates(t):
    k = F.col("p_partkey")
    return t.raw("part").select(
        k.alias("candidate_no"), F.concat(F.lit("em"), F.lpad((k % 150).cast("string"), 4, "0")).alias("station_code"),
        (k % 3).alias("project_id"), (-33.0 - (k % 50) * 0.001).alias("lat"), (-71.0 - (k % 40) * 0.001).alias("lon"),
        F.when(k % 2 == 0, -33.1 - (k % 50) * 0.001).alias("end_lat"), F.when(k % 2 == 0, -71.1).cast("double").alias("end_lon"),
    )


register("upsert_stations", lambda t: M.upsert_stations(t.station, _candidates(t)).select(
    F.lower("station_code").alias("code"), "project_id", "lat", "lon", "action"),
    """SELECT coalesce(lower(s.station_code), c.code) AS code, coalesce(s.project_id, c.k%3) AS project_id,
    CASE WHEN c.code IS NULL THEN s.lat ELSE -33e0-(c.k%50)*1e-3 END AS lat,
    CASE WHEN c.code IS NULL THEN s.lon ELSE -71e0-(c.k%40)*1e-3 END AS lon,
    CASE WHEN s.station_id IS NULL THEN 'inserted' WHEN c.code IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM station s FULL OUTER JOIN (SELECT 'em'||lpad(CAST(p_partkey%150 AS VARCHAR),4,'0') AS code, max(p_partkey) AS k
      FROM part GROUP BY p_partkey%150) c ON c.code=lower(s.station_code)""")


def _site_rows(t):
    return t.station.select("station_id", F.explode("sites").alias("s")).select("station_id", "s.kind", "s.name")


register("upsert_sites", lambda t: M.upsert_sites(_site_rows(t), t.event.select(
    "station_id", F.lit("trampa_sherman").alias("kind"), F.concat(F.lit("LINEA "), (F.col("event_id") % 6).cast("string")).alias("name"))),
    """SELECT station_id, 'camara_trampa' AS kind, 'Linea '||(station_id%4) AS name, false AS added FROM station
    UNION ALL SELECT DISTINCT station_id, 'trampa_sherman', 'LINEA '||(event_id%6), true FROM event WHERE event_id%6<>station_id%4""")


def _species(t):
    k = F.col("p_partkey")
    return t.raw("part").select(
        k.alias("row_no"), F.col("p_name").alias("common_name"),
        F.when(k % 4 != 0, F.concat_ws(" ", "p_brand", "p_type")).alias("scientific_name"),
        F.when(k % 2 == 0, "otro").otherwise("aves").alias("tax_group"))


register("upsert_catalog", lambda t: M.upsert_catalog(
    t.taxon.filter("rce is not null").withColumn("other_names", F.array(F.col("family"))), _species(t)).select(
    "common_name", "scientific_name", "tax_group", "rce", "is_new", F.size("other_names").alias("n_names")),
    """SELECT p_name AS common_name, sci AS scientific_name, CASE WHEN p_partkey%2=0 THEN 'otros' ELSE 'aves' END AS tax_group,
    k.rce, k.taxon_id IS NULL AS is_new, CASE WHEN k.taxon_id IS NULL THEN 0 ELSE 1 END AS n_names FROM (
      SELECT *, CASE WHEN p_partkey%4<>0 THEN p_brand||' '||p_type END AS sci,
        trim(regexp_replace(lower(coalesce(sci, p_name)),'[^a-z0-9]+',' ','g')) AS key FROM part
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_partkey)=1) n
    LEFT JOIN (SELECT trim(regexp_replace(lower(scientific_name),'[^a-z0-9]+',' ','g')) AS key, min(taxon_id) AS taxon_id,
      arg_min(rce, taxon_id) AS rce FROM taxon WHERE rce IS NOT NULL GROUP BY 1) k ON k.key=n.key""")

# --- change data ---
_FIELDS = ["station_id", "event_date", "amount", "recorded_by"]
register("audit_diff", lambda t: H.audit_rows(H.audit_diff(t.backup("local"), t.backup("incoming"), "id", _FIELDS), "id").select(
    "id", "field", F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after")),
    "SELECT id, 'amount' AS field, la AS before, ra AS after FROM paired WHERE la<>ra", paired=_PAIR)
register("apply_changes", lambda t: H.apply_changes(t.change_log).select(
    "entity_id", "revision", "payload", "review_state", epoch_us("deleted_at").alias("deleted_us"), epoch_us("updated_at").alias("updated_us")),
    """SELECT entity_id, count(*) AS revision, arg_max(payload, epoch_us(moment)::HUGEINT*1000000000+seq) FILTER (op IN ('create','update')) AS payload,
    CASE WHEN bool_or(op='review') THEN 'revisado' ELSE 'terreno' END AS review_state,
    epoch_us(max(moment) FILTER (op='delete')) AS deleted_us, epoch_us(max(moment)) AS updated_us FROM change_log GROUP BY entity_id""")


def _reviews(t):
    k = F.col("event_id")
    state = F.element_at(F.array(F.lit("terreno"), F.lit("revisado"), F.lit("validado")), (k % 3 + 1).cast("int"))
    return t.event.join(t.occurrence.select("event_id", "occurrence_id"), "event_id").filter("performed").select(
        "occurrence_id", state.alias("state"), F.lit("jefe").alias("by"), F.col("event_date").alias("at"), k.alias("seq"))


register("set_review_state", lambda t: H.set_review_state(t.occurrence, _reviews(t)).select("occurrence_id", "review_state", "reviewed_by"),
         """SELECT occurrence_id, CASE WHEN performed THEN (['terreno','revisado','validado'])[o.event_id%3+1] ELSE review_state END AS review_state,
    CASE WHEN performed AND o.event_id%3<>0 THEN 'jefe' END AS reviewed_by FROM occurrence o JOIN event e ON e.event_id=o.event_id""")
register("duplicate_records", lambda t: H.duplicate_records(t.occurrence, t.occurrence.filter("recapture").select(
    "occurrence_id", F.lit(1).alias("request_no"), F.lit("12:00").alias("time"))).select(
    "event_id", "taxon_id", "occurrence_time", "source", F.size("media_ids").alias("media"),
    F.col("dwc_occurrence_id").startswith("urn:survey:occ:").alias("urn_ok"), "utterance"),
    """SELECT event_id, taxon_id, '12:00' AS occurrence_time, 'duplicado' AS source, 0 AS media, true AS urn_ok,
    CAST(NULL AS VARCHAR) AS utterance FROM occurrence WHERE recapture""")
register("undo_batch", lambda t: H.undo_batch(t.occurrence, t.occurrence.select("batch_id").distinct().filter("batch_id in ('0', '1')").select(
    "batch_id", F.lit("2030-01-01").cast("timestamp").alias("at"))).groupBy("batch_id").agg(
    F.count_if(F.col("deleted_at").isNull()).alias("live")),
    """SELECT batch_id, count(*) FILTER (deleted_at IS NULL AND coalesce(batch_id,'') NOT IN ('0','1')) AS live
    FROM occurrence GROUP BY batch_id""")
register("attach_media", lambda t: H.attach_media(t.occurrence, t.occurrence.filter("notes is not null").select(
    "occurrence_id", F.lit(1).alias("seq"), F.lit("nueva").alias("media_id"))).select("occurrence_id", F.size("media_ids").alias("n"), "added"),
    """SELECT occurrence_id, media_count+CASE WHEN notes IS NOT NULL THEN 1 ELSE 0 END AS n, CASE WHEN notes IS NOT NULL THEN 1 ELSE 0 END AS added FROM occurrence""")
register("close_effort", lambda t: H.close_effort(t.event, t.occurrence, t.event.filter("performed").select(
    "event_id", F.lit("2030-01-01").cast("timestamp").alias("ended_at"), F.when(F.col("weather") == "Lluvia", F.lit(False)).alias("no_detections"))).select(
    "event_id", "no_detections"),
    """SELECT event_id, CASE WHEN performed AND weather='Lluvia' THEN false WHEN performed THEN event_id NOT IN (SELECT event_id FROM live_occ)
    ELSE no_detections END AS no_detections FROM event""")
register("not_performed", lambda t: H.patch_events(t.event, t.event.filter("weather = 'Lluvia'").select(
    "event_id", F.col("event_id").alias("seq"), F.lit(False).alias("performed"), F.lit("sin acceso").alias("not_performed_reason")),
    ["performed", "not_performed_reason"]).select("event_id", "performed", "not_performed_reason"),
    """SELECT event_id, CASE WHEN weather='Lluvia' THEN false ELSE performed END AS performed,
    CASE WHEN weather='Lluvia' THEN 'sin acceso' ELSE not_performed_reason END AS not_performed_reason FROM event""")
register("point_header", lambda t: H.patch_events(t.event, t.event.select(
    "event_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 == 0, "Neblina").alias("weather")), ["weather"]).select("event_id", "weather"),
    "SELECT event_id, CASE WHEN event_id%9=0 THEN 'Neblina' ELSE weather END AS weather FROM event")

# --- outbox ---
register("compact_outbox", lambda t: H.compact_outbox(t.outbox_item).select("item_id", "seq", "op"),
         "SELECT item_id, seq, op FROM outbox_item QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY queued_at DESC, seq DESC)=1")
register("due_items", lambda t: H.due_items(t.outbox_item, NOW).select("item_id", "seq"),
         f"SELECT item_id, seq FROM outbox_item WHERE next_attempt_at<='{NOW}'::TIMESTAMP")
register("fold_sync_outcomes", lambda t: _folded(t).select(
    "seq", "attempt", "result", "removed", "sync_state", (F.unix_timestamp("next_attempt_at") - F.unix_timestamp(F.lit(NOW).cast("timestamp"))).alias("wait_s")),
    f"""SELECT seq, attempts+1 AS attempt, result, result IN ('skipped','synced') AS removed,
    CASE result WHEN 'synced' THEN 'synced' WHEN 'retry' THEN 'pending' WHEN 'skipped' THEN NULL ELSE 'error' END AS sync_state,
    CASE WHEN result IN ('conflict','error') THEN 31536000
      WHEN result='retry' THEN least(CAST(pow(2,attempts+1) AS BIGINT),900) END AS wait_s FROM folded""",
    folded=(_FOLD := """SELECT *, CASE WHEN seq%17=0 AND op='upsert' THEN 'skipped' WHEN outcome='ok' THEN 'synced'
      WHEN outcome='conflict' THEN 'conflict' WHEN outcome='error' OR attempts+1>=8 THEN 'error' ELSE 'retry' END AS result FROM outbox_item"""))
register("sync_log", lambda t: H.sync_log(t.outbox_item.withColumns({"entity_exists": F.col("seq") % 17 != 0, "message": F.concat(F.lit("respuesta "), "outcome")}), now=NOW),
         f"""SELECT '{NOW}'::TIMESTAMP AS at, 'push' AS direction, entity, entity_id, CASE result WHEN 'synced' THEN 'ok' ELSE result END AS outcome,
    attempts+1 AS attempt, CASE WHEN result<>'synced' THEN 'respuesta '||outcome END AS message FROM folded WHERE result<>'skipped'""", folded=_FOLD)
register("sync_report", lambda t: H.sync_report(_folded(t)),
         """SELECT count(*) FILTER (result<>'skipped') AS attempted, count(*) FILTER (result='synced') AS synced,
    count(*) FILTER (result='conflict') AS conflicts, count(*) FILTER (result IN ('retry','error')) AS failed,
    count(*) FILTER (result='skipped') AS skipped FROM folded""", folded=_FOLD)
register("sync_status", lambda t: H.sync_status(t.outbox_item),
         """SELECT count(*) FILTER (last_error IS NULL) AS pending, count(*) FILTER (last_error<>'conflicto') AS errored,
    count(*) FILTER (last_error='conflicto') AS conflicts FROM outbox_item""")
register("retry_failed", lambda t: H.retry_failed(t.outbox_item, NOW).select("seq", "retried", "attempts"),
         "SELECT seq, last_error IS NOT NULL AS retried, CASE WHEN last_error IS NULL THEN attempts ELSE 0 END AS attempts FROM outbox_item")


def _folded(t):
    rows = t.outbox_item.withColumn("entity_exists", F.col("seq") % 17 != 0)
    folded = H.fold_outcomes(rows.withColumnsRenamed({"item_id": "_item", "seq": "item_id"}), now=NOW)
    return folded.withColumnRenamed("item_id", "seq")


def _warned(t):
    """What a backup without photographs warns of, and one without any sampling."""
    media = t.backup("incoming").select((F.col("id") % 5 == 0).alias("blob_omitted"))
    whole = M.merge_warnings(M.merge_reach(t.backup("incoming")), media).select(F.lit("photos").alias("backup"), "warning")
    none = M.merge_reach(t.backup("incoming").filter("deleted_at is not null"))
    return whole.unionByName(M.merge_warnings(none).select(F.lit("empty").alias("backup"), "warning"))


register("merge_warnings", _warned,
         """SELECT 'photos' AS backup, 'El respaldo se exportó sin las fotografías: se van a unir los registros, pero las imágenes de tu compañero no vienen.' AS warning
    WHERE EXISTS (SELECT 1 FROM backup_incoming WHERE id%5=0)
    UNION ALL SELECT 'empty', 'El respaldo no trae ningún muestreo.'""")


def _declared(t):
    """Declared counts of three tables: one right, one too high, one that was not read at all."""
    read = t.backup("incoming").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("events").alias("table"), "rows").unionByName(
        t.backup("local").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("audit").alias("table"), "rows"))
    declared = read.select("table", (F.col("rows") + F.when(F.col("table") == "audit", 3).otherwise(0)).alias("rows")).unionByName(
        t.backup("local").agg(F.lit("settings").alias("table"), F.count(F.lit(1)).alias("rows")))
    return M.declared_count_gaps(read, declared)


register("declared_count_gaps", _declared,
         """SELECT 'audit' AS "table", count(*)+3 AS declared, count(*) AS read FROM backup_local UNION ALL SELECT 'settings', count(*), 0 FROM backup_local""")
register("conservation_sources", lambda t: Q.conservation_sources(t.taxon),
         "SELECT DISTINCT conservation_source FROM flag WHERE level<>'sin-clasificar' AND conservation_source IS NOT NULL AND conservation_source<>''")
