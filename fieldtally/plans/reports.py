"""Reports: star join, coverage, effort, quality, conservation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions import survey as S
from fieldtally.operators import coverage as C
from fieldtally.operators import effort as E
from fieldtally.operators import quality as Q
from fieldtally.operators import star
from fieldtally.plans.registry import register

register("live", lambda t: S.live(t.occurrence).select("occurrence_id", "event_id", "record_type"),
         "SELECT occurrence_id, event_id, record_type FROM live_occ")

register("flatten", lambda t: t.flat.select(
    "occurrence_id", "event_date", "occurrence_time", "station_code", "site_name", "project_name", "campaign_name",
    "common_name", "record_type", "individual_count"),
    """SELECT occurrence_id, event_date, occurrence_time, station_code,
    CASE WHEN site_id IS NOT NULL THEN 'Linea '||(station_id%4) END AS site_name,
    project_name, campaign_name, common_name, record_type, individual_count FROM flat""")

register("species_tally", lambda t: Q.species_tally(t.occurrence, t.taxon),
         """SELECT o.taxon_id, coalesce(max(t.common_name), max(o.verbatim_taxon), 'Sin identificar') AS name,
    max(t.scientific_name) AS scientific_name, count(*) AS records,
    CAST(sum(coalesce(individual_count,0)) AS BIGINT) AS individuals,
    coalesce(bool_or(t.threatened),false) AS threatened, coalesce(bool_or(t.exotic),false) AS exotic
    FROM live_occ o LEFT JOIN flag t ON t.taxon_id=o.taxon_id
    GROUP BY o.taxon_id, CASE WHEN o.taxon_id IS NULL THEN o.verbatim_taxon END""")

register("quality_summary", lambda t: Q.quality_summary(t.event, t.occurrence, t.taxon),
         """SELECT (SELECT count(*) FROM event) AS events, (SELECT count(*) FROM live_occ) AS occurrences,
    (SELECT count(DISTINCT taxon_id) FROM live_occ) AS species,
    (SELECT count(*) FROM event WHERE no_detections OR event_id NOT IN (SELECT event_id FROM live_occ)) AS empty_events,
    (SELECT count(*) FROM live_occ JOIN flag USING (taxon_id) WHERE threatened) AS threatened_records,
    (SELECT count(*) FROM live_occ JOIN flag USING (taxon_id) WHERE exotic) AS exotic_records""")

register("daily_stats", lambda t: Q.daily_stats(t.occurrence, t.event),
         """SELECT event_date, count(DISTINCT station_id) AS stations, count(*) AS records,
    count(DISTINCT taxon_id) AS species, CAST(sum(CASE WHEN pending_text<>'' THEN 1 ELSE 0 END) AS BIGINT) AS pending,
    CAST(sum(CASE WHEN media_count=0 THEN 1 ELSE 0 END) AS BIGINT) AS without_photo,
    CAST(sum(CASE WHEN evidence_kind='Directo' AND individual_count IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS direct_without_count
    FROM live_occ JOIN event USING (event_id) GROUP BY event_date""")

register("methods_done", lambda t: Q.methods_done(t.event).select(
    "event_date", "station_id", F.array_join("methods", ",").alias("methods")),
    """SELECT event_date, station_id, string_agg(DISTINCT method, ',' ORDER BY method) AS methods
    FROM live_event GROUP BY event_date, station_id""")

register("records_by_date", lambda t: star.records_by_date(t.occurrence, t.event, only_pending=True),
         """SELECT event_date, count(*) AS records FROM live_occ JOIN event USING (event_id)
    WHERE pending_text<>'' GROUP BY event_date""")

register("recent_records", lambda t: star.recent_records(t.occurrence).select("occurrence_id", "event_id"),
         "SELECT occurrence_id, event_id FROM live_occ ORDER BY created_s DESC, occurrence_id DESC LIMIT 200")

register("active_event", lambda t: star.active_event(t.event),
         """SELECT station_id, method, event_date, arg_max(event_id, minute_of_day*1000000000+event_id) AS event_id
    FROM live_event GROUP BY ALL""")

register("one_per_key", lambda t: star.one_per_key(t.flat, "event_id").select("event_id", "occurrence_id", "common_name"),
         """SELECT event_id, occurrence_id, common_name FROM flat QUALIFY row_number() OVER
    (PARTITION BY event_id ORDER BY event_date, occurrence_time, created_s, occurrence_id)=1""")

register("derive_catalogs", lambda t: _derived(t)["stations"].select(
    "project_id", "station_code", "region", "season", F.array_join("methods", ",").alias("methods"),
    F.size("sites").alias("n_sites"), S.half_up(F.col("lat"), 6).alias("lat"), S.half_up(F.col("lon"), 6).alias("lon")),
    """SELECT * FROM (WITH k AS (SELECT 6378137e0 AS a, 0.9996e0 AS k0, (1/298.257223563e0)*(2-1/298.257223563e0) AS e2),
    g AS (SELECT *, e2/(1-e2) AS ep2, (1-sqrt(1-e2))/(1+sqrt(1-e2)) AS e1 FROM k),
    m AS (SELECT s.*, g.*, (utm_north-10000000)/k0/(a*(1-e2/4-3*pow(e2,2)/64-5*pow(e2,3)/256)) AS mu FROM station s, g),
    f AS (SELECT *, mu+(3*e1/2-27*pow(e1,3)/32)*sin(2*mu)+(21*pow(e1,2)/16-55*pow(e1,4)/32)*sin(4*mu)+151*pow(e1,3)/96*sin(6*mu)+1097*pow(e1,4)/512*sin(8*mu) AS phi FROM m),
    w AS (SELECT *, 1-e2*pow(sin(phi),2) AS w, pow(tan(phi),2) AS t, ep2*pow(cos(phi),2) AS c FROM f),
    d AS (SELECT *, a/sqrt(w) AS nu, a*(1-e2)/pow(w,1.5e0) AS rho, (utm_east-500000)/(a/sqrt(w)*k0) AS d FROM w)
    SELECT 'proj_region-'||(station_id%3) AS project_id, station_code, region, season, concat_ws(',', 'transecto', CASE WHEN station_id%2=0 THEN 'camara_trampa' END,
      CASE WHEN station_id%3=0 THEN 'trampa_sherman' END, CASE WHEN station_id%5=0 THEN 'playback_aves' END, CASE WHEN station_id%7=0 THEN 'punto_conteo' END) AS methods,
    1 AS n_sites,
    floor(degrees(phi-nu*tan(phi)/rho*d*d*(5e-1-(5+3*t+10*c-4*c*c-9*ep2)/24*d*d+(61+90*t+298*c+45*t*t-252*ep2-3*c*c)/720*pow(d,4)))*1e6+5e-1)/1e6 AS lat,
    floor(degrees(radians(-69e0)+d*(1-(1+2*t+c)/6*d*d+(5-2*c+28*t-3*c*c+8*ep2+24*t*t)/120*pow(d,4))/cos(phi))*1e6+5e-1)/1e6 AS lon FROM d)""")

register("derive_campaigns", lambda t: _derived(t)["campaigns"],
         """SELECT DISTINCT 'camp_proj_region-'||(s_suppkey%3)||'_'||lower(CASE WHEN s_suppkey%2=0 THEN 'Verano' ELSE 'Invierno' END) AS campaign_id,
    'proj_region-'||(s_suppkey%3) AS project_id,
    CASE WHEN s_suppkey%2=0 THEN 'Verano' ELSE 'Invierno' END||' Region '||(s_suppkey%3) AS campaign_name,
    CASE WHEN s_suppkey%2=0 THEN 'Verano' ELSE 'Invierno' END AS campaign_season FROM supplier""")

register("derive_projects", lambda t: _derived(t)["projects"].select("project_id", "project_code", "region"),
         """SELECT 'proj_region-'||(station_id%3) AS project_id, 'Region '||(station_id%3) AS project_code,
    arg_min(coalesce(region,'∅'), station_id) AS region FROM station GROUP BY station_id%3""".replace(
             "arg_min(coalesce(region,'∅'), station_id)", "nullif(arg_min(coalesce(region,'∅'), station_id),'∅')"))


def _derived(t):
    rows = t.station.select(
        F.col("station_id").alias("row_no"),
        F.concat(F.lit("Region "), (F.col("station_id") % 3).cast("string")).alias("project"),
        "region", "season", "station_code", "final_code", "habitat", "slope_aspect", "utm_east", "utm_north", "methods",
        F.col("sites.name").alias("camara_trampa"),
    )
    return star.derive_catalogs(rows)


register("guarded_delete", lambda t: star.guarded_delete(t.taxon, t.occurrence, "taxon_id")["deletable"].select("taxon_id"),
         "SELECT taxon_id FROM taxon ANTI JOIN occurrence USING (taxon_id)")

# --- coverage ---
_CHOSEN = """SELECT station_id, method, arg_min(event_id, event_id) FILTER (event_date=d) AS event_id FROM (
  SELECT *, max(event_date) OVER (PARTITION BY station_id, method) AS d FROM (
    SELECT *, max(CASE WHEN performed=false THEN event_id END) OVER (PARTITION BY station_id, method) AS cut
    FROM live_event) WHERE cut IS NULL OR event_id>=cut) GROUP BY station_id, method"""
_COVER = """SELECT g.station_id, g.station_code, g.project_id, g.method, e.event_id, e.event_date,
  CASE WHEN e.event_id IS NULL THEN 'pendiente' WHEN e.performed=false THEN 'no realizado' ELSE 'realizado' END AS state,
  e.not_performed_reason AS reason, coalesce(e.no_detections,false) AS no_detections
  FROM grid g LEFT JOIN chosen c USING (station_id, method) LEFT JOIN event e ON e.event_id=c.event_id"""

register("plan_coverage", lambda t: C.plan_coverage(t.station, t.event), "SELECT * FROM cover", chosen=_CHOSEN, cover=_COVER)
register("plan_summary", lambda t: C.plan_summary(C.plan_coverage(t.station, t.event), ["project_id"]),
         """SELECT project_id, count(*) AS planned, count(*) FILTER (state='realizado') AS done,
    count(*) FILTER (state='no realizado') AS not_performed, count(*) FILTER (state='pendiente') AS pending,
    count(*) FILTER (state='realizado')/count(*) AS coverage FROM cover GROUP BY project_id""", chosen=_CHOSEN, cover=_COVER)
register("off_plan", lambda t: C.off_plan(t.station, t.event).select("event_id", "station_id", "method"),
         "SELECT event_id, station_id, method FROM live_event ANTI JOIN grid USING (station_id, method)")
register("pending_plan", lambda t: C.pending_plan(C.plan_coverage(t.station, t.event, campaign_id=0)).select(
    "station_code", "method"),
    """SELECT station_code, method FROM grid WHERE (station_id, method) NOT IN
    (SELECT (station_id, method) FROM live_event WHERE campaign_id=0)""")


def _entries(t):
    """Sightings to place: one per event, dated up to two days off, seen from a later day."""
    e = t.event
    seen = F.date_add(F.col("event_date").cast("date"), (F.col("event_id") % 3).cast("int") - 1)
    today = F.when(F.col("event_id") % 2 == 0, seen).otherwise(F.date_add(seen, 1))
    return e.select(
        F.col("event_id").alias("entry_id"), F.when(F.col("event_id") % 13 != 0, F.col("station_id")).alias("station_id"),
        "method", F.date_format(seen, "yyyy-MM-dd").alias("sighting_date"), F.date_format(today, "yyyy-MM-dd").alias("today"),
    )


_ENTRIES = """SELECT event_id AS entry_id, CASE WHEN event_id%13<>0 THEN station_id END AS station_id, method,
  strftime(CAST(event_date AS DATE)+CAST(event_id%3-1 AS INTEGER),'%Y-%m-%d') AS sighting_date,
  strftime(CAST(event_date AS DATE)+CAST(event_id%3-1+event_id%2 AS INTEGER),'%Y-%m-%d') AS today FROM event"""

register("resolve_entry", lambda t: C.resolve_entry(_entries(t), t.event).select(
    "entry_id", "mode", "event_date", "final_method", "deferred", "alternative_method"),
    """SELECT entry_id,
    CASE WHEN x.station_id IS NULL THEN 'normal' WHEN same_day THEN CASE WHEN late THEN 'olvido' ELSE 'normal' END
      WHEN n=0 THEN CASE WHEN late THEN 'olvido' ELSE 'normal' END WHEN late THEN 'otro_dia' ELSE 'quizas_replica' END AS mode,
    sighting_date AS event_date,
    CASE WHEN mode IN ('otro_dia','quizas_replica') THEN 'registro_oportunista' ELSE x.method END AS final_method,
    mode<>'quizas_replica' AND late AS deferred,
    CASE WHEN mode='quizas_replica' THEN x.method END AS alternative_method
    FROM (SELECT en.*, sighting_date<>today AS late,
      (SELECT count(*) FROM live_event e WHERE e.station_id=en.station_id AND e.method=en.method) AS n,
      EXISTS(SELECT 1 FROM live_event e WHERE e.station_id=en.station_id AND e.method=en.method
             AND e.event_date=en.sighting_date) AS same_day FROM entries en) x""", entries=_ENTRIES)


def _drafts(t):
    """Drafts for half of the visits' keys, shifted by a day for a third of them."""
    return t.event.select(
        F.col("event_id").alias("draft_id"), "campaign_id", "station_id", "site_id", "method",
        F.date_format(F.date_add(F.col("event_date").cast("date"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)), "yyyy-MM-dd").alias("event_date"),
        "event_time",
    )


register("assign_events", lambda t: C.assign_events(_drafts(t), t.event)["drafts"].select(
    "draft_id", F.when(F.length("event_id") < 40, F.col("event_id")).alias("existing_event_id")),
    """SELECT d.event_id AS draft_id, min(CAST(e.event_id AS VARCHAR)) AS existing_event_id
    FROM event d LEFT JOIN live_event e ON e.campaign_id=d.campaign_id AND e.station_id=d.station_id
      AND e.site_id IS NOT DISTINCT FROM d.site_id AND e.method=d.method
      AND CAST(e.event_date AS DATE)=CAST(d.event_date AS DATE)+CASE WHEN d.event_id%3=0 THEN 1 ELSE 0 END
    GROUP BY d.event_id""")
register("assign_events_created", lambda t: C.assign_events(_drafts(t), t.event)["created"].agg(
    F.count(F.lit(1)).alias("events"), F.sum("drafts").alias("drafts")),
    """SELECT count(*) AS events, CAST(sum(n) AS BIGINT) AS drafts FROM (
      SELECT count(*) AS n FROM (SELECT *, CAST(event_date AS DATE)+CASE WHEN event_id%3=0 THEN 1 ELSE 0 END AS dd FROM event) d
      WHERE NOT EXISTS (SELECT 1 FROM live_event e WHERE e.campaign_id=d.campaign_id AND e.station_id=d.station_id
        AND e.site_id IS NOT DISTINCT FROM d.site_id AND e.method=d.method AND CAST(e.event_date AS DATE)=d.dd)
      GROUP BY campaign_id, station_id, site_id, method, dd)""")

# --- effort ---
register("effort_summary", lambda t: E.effort_summary(t.event).select(
    "event_id", "unit", "duration_min", F.col("effort_distance_m").cast("bigint").alias("distance_m"), "trap_nights",
    "measured", "incomplete", "effort_label"),
    "SELECT event_id, unit, duration_min, distance_m, trap_nights, measured, incomplete, effort_label FROM effort")
register("relative_abundance", lambda t: E.relative_abundance(t.occurrence, t.event),
         """SELECT event_id, taxon_id, CAST(ind AS BIGINT) AS individuals,
    CASE WHEN base<>0 THEN floor(ind/base*k*1e2+5e-1)/1e2 END AS abundance,
    CASE WHEN base<>0 THEN CASE unit WHEN 'distancia' THEN 'ind/km' WHEN 'trampas-noche' THEN 'ind/100 trampas-noche'
      ELSE 'ind/h' END END AS abundance_unit
    FROM (SELECT o.event_id, o.taxon_id, sum(coalesce(individual_count,0)) AS ind, any_value(unit) AS unit,
      any_value(CAST(CASE unit WHEN 'distancia' THEN distance_m WHEN 'trampas-noche' THEN trap_nights
        WHEN 'duración' THEN duration_min END AS DOUBLE)) AS base,
      any_value(CASE unit WHEN 'distancia' THEN 1000 WHEN 'trampas-noche' THEN 100 ELSE 60 END) AS k
      FROM live_occ o JOIN effort USING (event_id) GROUP BY o.event_id, o.taxon_id)""")

_STEPS = """SELECT track_id, floor(coalesce(2*6371000e0*asin(sqrt(pow(sin(radians(lat-plat)/2),2)
  +cos(radians(plat))*cos(radians(lat))*pow(sin(radians(lon-plon)/2),2))),0)*1e6+5e-1) AS um FROM (
  SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM track_point
  WINDOW w AS (PARTITION BY track_id ORDER BY t_s, point_id))"""
register("track_length", lambda t: E.track_length(t.track_point),
         "SELECT track_id, count(*) AS points, CAST(floor(sum(um)/1e6+5e-1) AS BIGINT) AS length_m FROM steps GROUP BY track_id",
         steps=_STEPS)
register("waypoint_distance", lambda t: E.waypoint_distance(t.track_point),
         """SELECT track_id, CASE WHEN count(*)>1 THEN CAST(floor(sum(um)/1e6+5e-1) AS BIGINT) END AS length_m
    FROM steps GROUP BY track_id""", steps=_STEPS)
register("trap_nights", lambda t: t.event.select("event_id", S.trap_nights_between(
    F.lit(4), F.col("event_date"), F.date_add(F.col("event_date").cast("date"), (F.col("event_id") % 9).cast("int") - 2)).alias("nights")),
    "SELECT event_id, 4*greatest(0, event_id%9-2) AS nights FROM event")
#: The sequential rule: each step judges the next point of every track against the last accepted one.
TRACK_SQL = """SELECT * FROM (WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_s, point_id) AS k FROM track_point),
  walk AS (SELECT track_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS point_id, CAST(NULL AS VARCHAR) AS reason,
      CAST(NULL AS BIGINT) AS t, CAST(NULL AS DOUBLE) AS la FROM p WHERE k=1
    UNION ALL SELECT track_id, k, point_id, reason, CASE WHEN reason IS NULL THEN t_s ELSE t END, CASE WHEN reason IS NULL THEN lat ELSE la END FROM (
      SELECT p.track_id, p.k, p.point_id, p.t_s, p.lat, w.t, w.la,
        CASE WHEN p.acc>30 THEN 'precision' WHEN w.t IS NULL THEN NULL WHEN step<5 THEN 'sin-movimiento'
          WHEN p.t_s>w.t AND step/(p.t_s-w.t)>5 THEN 'salto-imposible' END AS reason
      FROM walk w JOIN p ON p.track_id=w.track_id AND p.k=w.k+1,
        LATERAL (SELECT 2*6371000e0*asin(sqrt(pow(sin((radians(p.lat)-radians(w.la))/2),2))) AS step)))
  SELECT track_id, point_id, reason IS NULL AS accepted, reason FROM walk WHERE k>0)"""
register("filter_track", lambda t: E.filter_track(t.track_point).select("track_id", "point_id", "accepted", "reason"), TRACK_SQL)

# --- quality ---
_DUP = """SELECT *, sum(new) OVER (PARTITION BY event_id, subject, record_type ORDER BY created_s, occurrence_id) AS c FROM (
  SELECT *, CASE WHEN created_s-lag(created_s) OVER w<=60 AND NOT coalesce(batch_id=lag(batch_id) OVER w,false) THEN 0 ELSE 1 END AS new
  FROM (SELECT *, coalesce(CAST(taxon_id AS VARCHAR), verbatim_taxon, '?') AS subject FROM live_occ)
  WINDOW w AS (PARTITION BY event_id, subject, record_type ORDER BY created_s, occurrence_id))"""
_CLUSTER = """SELECT occurrence_id, event_id, taxon_id, verbatim_taxon, record_type,
  count(*) OVER w AS cluster_size, first_value(occurrence_id) OVER (w ORDER BY created_s, occurrence_id) AS cluster_id
  FROM dup WINDOW w AS (PARTITION BY event_id, subject, record_type, c)"""
register("find_duplicates", lambda t: Q.duplicate_clusters(t.occurrence).select("cluster_id", "cluster_size", "occurrence_id", "event_id"),
         "SELECT cluster_id, cluster_size, occurrence_id, event_id FROM clustered WHERE cluster_size>1", dup=_DUP, clustered=_CLUSTER)
_QDUP = """SELECT 'duplicado' AS kind, 'alta' AS severity, cluster_size||' registros de '||
    coalesce(CASE WHEN taxon_id IS NULL THEN verbatim_taxon ELSE t.common_name END,'—')||' ('||record_type||') en '||e.event_time||
    ' con menos de un minuto entre sí. ¿Es un doble guardado?' AS message, c.event_id, occurrence_id, cluster_size AS n_records
    FROM clustered c JOIN event e USING (event_id) LEFT JOIN taxon t USING (taxon_id)
    WHERE cluster_size>1 AND occurrence_id=cluster_id"""
_QEFF = """SELECT 'sin-esfuerzo' AS kind, CASE WHEN n>0 THEN 'media' ELSE 'baja' END AS severity,
    'Muestreo del '||event_date||' '||event_time||': se activó la medición de esfuerzo pero quedó a medias ('||unit||').' AS message,
    event_id, CAST(NULL AS VARCHAR) AS occurrence_id, coalesce(n,0) AS n_records
    FROM effort LEFT JOIN (SELECT event_id, count(*) AS n FROM live_occ GROUP BY event_id) USING (event_id)
    WHERE deleted_at IS NULL AND incomplete"""
_NAMED = """SELECT o.*, coalesce(t.common_name, o.verbatim_taxon, 'registro') AS name,
    coalesce(t.threatened,false) AS threatened, t.mobility,
    CASE WHEN t.threatened THEN 'especie en categoría de conservación'
      WHEN record_type IN ('Fecas','Huella','Madriguera','Nido') THEN lower(record_type)||': la evidencia queda en un punto fijo'
      WHEN t.mobility='baja' THEN 'especie de baja movilidad' END AS why
    FROM live_occ o LEFT JOIN flag t ON t.taxon_id=o.taxon_id"""
_WEAK = {
    "q_no_evidence": ("sin-evidencia", "alta", "threatened AND media_count=0",
                      "name||' está en categoría de amenaza y no tiene fotografía. Es el registro que más se va a cuestionar en la revisión.'"),
    "q_doubtful_id": ("identificacion-dudosa", "media", "confidence<>'seguro' AND media_count=0",
                      "name||' quedó como identificación \"'||confidence||'\" y sin evidencia que permita confirmarla.'"),
    "q_no_fix": ("sin-coordenada", "media", "why IS NOT NULL AND fix_lat IS NULL",
                 "name||' sin coordenada propia ('||why||').'"),
    "q_no_count": ("sin-abundancia", "media", "evidence_kind='Directo' AND individual_count IS NULL",
                   "name||': registro directo sin abundancia.'"),
    "q_validated_pending": ("sin-revisar", "alta", "review_state='validado' AND pending_text<>''",
                            "name||' está marcado como validado pero conserva campos pendientes: '||pending_text||'.'"),
}
register("q_duplicate", lambda t: Q.q_duplicate(t.occurrence, t.event, t.taxon), _QDUP, dup=_DUP, clustered=_CLUSTER)
register("q_effort_gap", lambda t: Q.q_effort_gap(t.event, t.occurrence), _QEFF)


def _weak_sql(kind, severity, where, message):
    return (f"SELECT '{kind}' AS kind, '{severity}' AS severity, {message} AS message, event_id, occurrence_id,"
            f" 1 AS n_records FROM named WHERE {where}")


for _name, _rule in _WEAK.items():
    register(_name, lambda t, kind=_rule[0]: Q.q_weak_records(t.occurrence, t.taxon, [kind]), _weak_sql(*_rule), named=_NAMED)

register("issues_by_severity", lambda t: Q.issues_by_severity(Q.quality_issues(t.event, t.occurrence, t.taxon)),
         " UNION ALL ".join([_QDUP, _QEFF] + [_weak_sql(*r) for r in _WEAK.values()]), dup=_DUP, clustered=_CLUSTER, named=_NAMED)

# --- conservation ---
register("conservation_coverage", lambda t: Q.conservation_coverage(t.taxon),
         """SELECT count(*) AS total, count(*) FILTER (level<>'sin-clasificar') AS classified,
    count(*) FILTER (threatened) AS threatened,
    count(DISTINCT CASE WHEN level<>'sin-clasificar' THEN conservation_source END) AS n_sources FROM flag""")
register("mark_ambiguous", lambda t: Q.mark_ambiguous(t.taxon).select("taxon_id", "common_name", "ambiguous"),
         """SELECT taxon_id, common_name, count(*) OVER (PARTITION BY common_name)>1 AS ambiguous FROM taxon""")


def _answers(t):
    k = F.col("p_partkey")
    name = F.concat_ws("  ", F.upper("p_brand"), "p_type")
    src = t.raw("part")
    red = src.filter(k % 3 == 0).select(name.alias("scientific_name"), F.when(k % 2 == 0, "VU").alias("category"),
                                        F.lpad(k.cast("string"), 9, "0").alias("loaded_at"))
    cached = src.filter(k % 5 == 0).select(name.alias("scientific_name"), F.when(k % 4 == 0, "NT").alias("category"),
                                           F.lpad(k.cast("string"), 9, "0").alias("consulted_at"))
    return red, cached


_ANS = """SELECT lower(p_brand||' '||p_type) AS k, p_partkey, CASE WHEN p_partkey%2=0 THEN 'VU' END AS r,
  CASE WHEN p_partkey%4=0 THEN 'NT' END AS c FROM part"""
register("conservation_lookup", lambda t: Q.conservation_lookup(t.taxon.select("taxon_id", "scientific_name"), *_answers(t)).select(
    "taxon_id", "category", "origin_of_status", "consulted"),
    """SELECT t.taxon_id, CASE WHEN rk IS NOT NULL THEN rv ELSE cv END AS category,
    CASE WHEN rk IS NOT NULL THEN 'nomina' WHEN ck IS NOT NULL THEN 'cache' END AS origin_of_status,
    rk IS NOT NULL OR ck IS NOT NULL AS consulted
    FROM taxon t LEFT JOIN (SELECT k AS rk, r AS rv FROM ans WHERE p_partkey%3=0
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY p_partkey DESC)=1) ON rk=lower(t.scientific_name)
    LEFT JOIN (SELECT k AS ck, c AS cv FROM ans WHERE p_partkey%5=0
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY p_partkey DESC)=1) ON ck=lower(t.scientific_name)""", ans=_ANS)
register("lookup_cache_status", lambda t: Q.lookup_cache_status(_answers(t)[1]),
         "SELECT count(DISTINCT k) AS species, lpad(CAST(min(p_partkey) AS VARCHAR),9,'0') AS oldest FROM ans WHERE p_partkey%5=0",
         ans=_ANS)
