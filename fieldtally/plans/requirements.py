"""Validation of drafts against requirement profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions import profiles as PR
from fieldtally.functions import vocab as V
from fieldtally.operators import validation as VA
from fieldtally.operators.effort import effort_summary
from fieldtally.plans.registry import register


def _config(t):
    return PR.builtin_config(t.spark)


def _prepared(t):
    return VA.prepare_drafts(t.draft, t.taxon, _config(t))


def _values(rows):
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


_CONF = f"SELECT * FROM (VALUES {_values([r[1:] for r in PR.builtin_rows() if r[0] == PR.STANDARD_ID])}) AS c(level, level_value, field, requirement)"
_FIELDS = f"SELECT * FROM (VALUES {_values(V.FIELD_LABELS.items())}) AS f(field, label)"
_REQ = """SELECT x.*, f.field, CASE WHEN x.threatened AND v<>'hidden' AND th.requirement IS NOT NULL AND
    list_position(['hidden','optional','recommended','required'], th.requirement)>list_position(['hidden','optional','recommended','required'], v)
    THEN th.requirement ELSE v END AS requirement
  FROM (SELECT DISTINCT method, tax_group, record_type, threatened FROM draft) x, reqfields f
  LEFT JOIN conf b ON b.level='base' AND b.field=f.field
  LEFT JOIN conf m ON m.level='method' AND m.level_value=x.method AND m.field=f.field
  LEFT JOIN conf r ON r.level='record_type' AND r.level_value=x.record_type AND r.field=f.field
  LEFT JOIN conf th ON th.level='threatened' AND th.field=f.field,
  LATERAL (SELECT CASE WHEN coalesce(m.requirement,'')<>'hidden' AND r.requirement IS NOT NULL THEN r.requirement
    ELSE coalesce(m.requirement, b.requirement, 'optional') END AS v) z"""
register("resolve_requirements", lambda t: VA.resolve_requirements(_prepared(t), _config(t)), "SELECT * FROM req",
         conf=_CONF, reqfields=_FIELDS, req=_REQ)

_PRESENT = {
    "eventDate": "true", "eventTime": "true", "station": "true", "method": "true", "recordedBy": "recorded_by IS NOT NULL",
    "weather": "weather IS NOT NULL", "taxon": "d.taxon_id IS NOT NULL", "trapNumber": "trap_number IS NOT NULL",
    "reproductiveCondition": "reproductive_condition IS NOT NULL", "flightHeightReference": "flight_height_reference IS NOT NULL",
    "flightType": "flight_type IS NOT NULL", "timeBlock": "time_block IS NOT NULL", "recordType": "NOT inferred",
    "individualCount": "individual_count IS NOT NULL", "sex": "sex IS NOT NULL", "lifeStage": "life_stage IS NOT NULL",
    "organismCondition": "organism_condition IS NOT NULL", "behaviour": "behaviour IS NOT NULL", "notes": "notes IS NOT NULL",
    "photos": "media_count>0", "occurrenceCoordinates": "fix_lat IS NOT NULL", "flightDirection": "flight_direction IS NOT NULL",
    "flightHeight": "coalesce(CAST(flight_height_m AS VARCHAR), flight_height_category) IS NOT NULL", "flightOrigin": "flight_origin IS NOT NULL",
    "flightDestination": "flight_destination IS NOT NULL", "playbackResponse": "playback_response IS NOT NULL",
    "detectionDistance": "detection_distance_m IS NOT NULL", "organismId": "organism_id IS NOT NULL",
}
_WHENS = " ".join(f"WHEN '{f}' THEN {c}" for f, c in _PRESENT.items())
_STATE = f"""SELECT d.draft_id, r.field, f.label, d.why, d.n_candidates,
  CASE WHEN r.field='occurrenceCoordinates' AND r.requirement<>'required' THEN CASE WHEN d.why IS NOT NULL THEN 'required' ELSE 'optional' END ELSE r.requirement END AS needed,
  (r.field='taxon' AND (d.n_candidates>1 OR corrected OR d.taxon_id IS NULL AND d.n_candidates=0 AND pk%9=3)) AS asked,
  r.field='behaviour' AND ack_behaviour AS acked
  FROM draft d JOIN req r ON r.method=d.method AND r.record_type=d.record_type AND r.tax_group IS NOT DISTINCT FROM d.tax_group AND r.threatened=d.threatened
  JOIN reqfields f ON f.field=r.field
  WHERE NOT (CASE r.field {_WHENS} ELSE true END)"""
_VIEWS = dict(conf=_CONF, reqfields=_FIELDS, req=_REQ, fstate=_STATE)

register("v_required_fields", lambda t: VA.draft_issues(_prepared(t), ["v_required_fields"]).select(
    "draft_id", "field", "severity", "level", "message"),
    """SELECT draft_id, field, CASE WHEN needed='required' THEN 'pending' ELSE 'info' END AS severity,
    CASE WHEN field IN ('eventDate','eventTime','station','method','recordedBy','weather') THEN 'event' ELSE 'occurrence' END AS level,
    CASE WHEN needed='required' THEN 'Falta '||lower(label)||CASE WHEN field='occurrenceCoordinates' AND why IS NOT NULL THEN ' ('||why||')' ELSE '' END||'.'
      ELSE 'Sin '||lower(label)||' (recomendado).' END AS message
    FROM fstate WHERE needed IN ('required','recommended') AND NOT asked AND NOT acked""", **_VIEWS)
register("pending_fields", lambda t: VA.draft_result(_prepared(t)).select(
    "draft_id", F.array_join(F.array_sort("pending_fields"), ",").alias("fields"), "can_save"),
    """SELECT d.draft_id, coalesce(s.fields,'') AS fields, NOT (taxon_id IS NULL AND n_candidates=0 AND pk%9=3) AS can_save
    FROM draft d LEFT JOIN (SELECT draft_id, string_agg(field, ',' ORDER BY field) AS fields FROM fstate
      WHERE needed IN ('required','recommended') AND (acked OR (asked AND n_candidates>0) OR (NOT asked AND needed='required')) GROUP BY draft_id) s
    ON s.draft_id=d.draft_id""", **_VIEWS)
register("can_save", lambda t: VA.draft_result(_prepared(t)).groupBy("can_save").agg(F.count(F.lit(1)).alias("n")),
         "SELECT NOT (taxon_id IS NULL AND n_candidates=0 AND pk%9=3) AS can_save, count(*) AS n FROM draft GROUP BY 1")

_RULES = {
    "v_no_taxon": ("taxon", "blocker", "occurrence", "taxon_id IS NULL AND n_candidates=0 AND pk%9=3",
                   "'No se reconoció ninguna especie. Dicta o escribe al menos el nombre común.'"),
    "v_ambiguous_taxon": ("taxonAmbiguity", "question", "occurrence", "n_candidates>1",
                          "'\"'||verbatim_taxon||'\" corresponde a más de una especie. ¿Cuál registraste?'"),
    "v_corrected_taxon": ("taxonAmbiguity", "question", "occurrence", "corrected", "'Escuché \"escrito asi\". ¿Es '||common_name||'?'"),
    "v_sex_scope": ("sexScope", "question", "occurrence", "individual_count>1 AND sex IN ('Macho','Hembra') AND sex_scope='sin_definir'",
                    "'¿Los '||individual_count||' individuos son '||lower(sex)||'?'"),
    "v_stage_scope": ("lifeStageScope", "question", "occurrence", "individual_count>1 AND life_stage IS NOT NULL AND life_stage_scope='sin_definir'",
                      "'¿Los '||individual_count||' individuos son '||lower(life_stage)||'?'"),
    "v_indirect_count": ("consistency", "question", "occurrence", "record_type IN ('Fecas','Huella','Nido','Madriguera') AND individual_count>0",
                         "'Registraste '||lower(record_type)||' con abundancia '||individual_count||'. ¿La abundancia se refiere a individuos o a signos encontrados?'"),
    "v_method_not_enabled": ("method", "info", "event",
                             "method<>'registro_oportunista' AND ((project_id=0 AND method NOT IN ('transecto','camara_trampa','trampa_sherman')) OR (project_id=1 AND method NOT IN ('transecto','playback_aves')))",
                             "'La metodología seleccionada no está habilitada para este proyecto.'"),
    "v_threatened": ("conservation", "info", "occurrence", "threatened",
                     "common_name||' está en categoría de conservación: '||badge||'. '||cat_label||coalesce(', '||rce_decree,'')||coalesce(' · fuente: '||conservation_source,'')"),
    "v_exotic": ("conservation", "info", "occurrence", "exotic", "common_name||' es exótica; se informa por separado en la línea base.'"),
    "v_photo_hint": ("photos", "info", "occurrence", "media_count=0 AND (threatened OR confidence<>'seguro' OR record_type IN ('Fecas','Huella','Nido','Madriguera'))",
                     "CASE WHEN threatened THEN 'Especie en categoría de conservación' WHEN confidence<>'seguro' THEN 'Identificación \"'||confidence||'\"' ELSE 'Registro por '||lower(record_type) END||': una fotografía permitiría verificarlo después.'"),
    "v_flight_outside_method": ("consistency", "info", "occurrence", "flight_direction IS NOT NULL AND method<>'transito_aereo'",
                                "'Se capturaron datos de vuelo fuera de la metodología de tránsito aéreo; se guardarán como hechos asociados.'"),
}
for _name, (_field, _sev, _lvl, _where, _msg) in _RULES.items():
    register(_name, lambda t, rule=_name: VA.draft_issues(_prepared(t), [rule]).select(
        "draft_id", "field", "severity", "level", "message"),
        f"SELECT draft_id, '{_field}' AS field, '{_sev}' AS severity, '{_lvl}' AS level, {_msg} AS message FROM draft WHERE {_where}")
register("v_ambiguous_options", lambda t: VA.ambiguous_options(t.draft, t.taxon),
         """SELECT draft_id, k.pos, (pk%40)+k.pos AS option_id, t.common_name||' — '||t.scientific_name AS label
    FROM draft JOIN (VALUES (0),(1)) AS k(pos) ON n_candidates>1 JOIN taxon t ON t.taxon_id=(pk%40)+k.pos""")
register("v_effort_incomplete", lambda t: VA.effort_issues(t.draft, effort_summary(t.event), _config(t)),
         """SELECT draft_id, 'v_effort_incomplete' AS rule, 'effort' AS field, 'info' AS severity, 'event' AS level,
    'Mediste esfuerzo pero falta '||CASE unit WHEN 'distancia' THEN 'la distancia recorrida' WHEN 'trampas-noche' THEN 'las trampas-noche'
      ELSE 'la duración del muestreo' END||'. Ciérralo para poder comparar con otras campañas.' AS message
    FROM draft d JOIN effort e ON e.event_id=d.event_id WHERE e.incomplete""")
register("v_station_drift", lambda t: VA.drift_issues(t.photo.withColumn("fix_id", F.col("file")), t.station).select("draft_id", "severity", "message"),
         """SELECT file AS draft_id, 'question' AS severity, 'Estás a '||x.d||' m de '||c.station_code||
    CASE WHEN nearest_m<x.d THEN '. La más cercana es '||nn.station_code ELSE '' END||'.' AS message
    FROM photo p JOIN photo_dist x USING (file) JOIN photo_near n USING (file) JOIN station c ON c.station_id=p.chosen_station_id
    JOIN station nn ON nn.station_id=n.nearest_station_id WHERE x.station_id=p.chosen_station_id AND x.d>200 AND x.d>coalesce(acc,0)""")
register("what_is_missing", lambda t: VA.what_is_missing(VA.draft_issues(_prepared(t))).groupBy("urgency", "field").agg(F.count(F.lit(1)).alias("n")),
         "SELECT urgency, field, count(*) AS n FROM (" + " UNION ALL ".join(
             f"SELECT '{f}' AS field, {0 if s == 'blocker' else 1} AS urgency FROM draft WHERE {w}"
             for f, s, _, w, _ in _RULES.values() if s in ("blocker", "question"))
         + " UNION ALL SELECT field, 2 FROM fstate WHERE needed='required' AND NOT asked AND NOT acked) GROUP BY ALL", **_VIEWS)
