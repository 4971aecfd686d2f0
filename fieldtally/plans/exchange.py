"""Export shapes: fields, sheets and Darwin Core tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import fields as FL
from fieldtally.functions import survey as S
from fieldtally.functions.text import half_up
from fieldtally.operators import export as X
from fieldtally.operators.star import event_rows
from fieldtally.plans.registry import register
from fieldtally.sources import exchange_files as files


def _dims(t):
    return event_rows(t.event, t.station, t.project, t.campaign)


_FIRST = """SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY event_id
  ORDER BY event_date, occurrence_time, created_s, occurrence_id)=1"""

register("coordinates_of", lambda t: t.flat.select("occurrence_id", FL.coordinates_of().alias("c")).select(
    "occurrence_id", "c.source", half_up(F.col("c.lat"), 6).alias("lat"), half_up(F.col("c.lon"), 6).alias("lon"), "c.zone"),
    """SELECT occurrence_id, CASE WHEN fix_lat IS NOT NULL THEN 'avistamiento' WHEN station_code IS NOT NULL THEN 'estacion' ELSE 'ninguna' END AS source,
    floor(coalesce(fix_lat,lat)*1e6+5e-1)/1e6 AS lat, floor(coalesce(fix_lon,lon)*1e6+5e-1)/1e6 AS lon, 19 AS zone FROM flat""")
for _policy in X.POLICIES:
    _masked = "sensitive AND " + ("false" if _policy == "exacta" else "true")
    _deg = "NULL" if _policy == "omitida" else "floor(floor({c}/1e-2+5e-1)*1e-2*1e6+5e-1)/1e6"
    _unc = "NULL" if _policy == "omitida" else "greatest(coalesce(fix_accuracy_m,0),1100e0)"
    register(f"apply_sensitivity_{_policy}", lambda t, policy=_policy: t.flat.select("occurrence_id", X.apply_sensitivity(
        F.coalesce("fix_lat", "lat"), F.coalesce("fix_lon", "lon"), F.col("fix_accuracy_m"),
        S.is_sensitive("rce", "iucn", "endemic"), policy).alias("a")).select("occurrence_id", "a.lat", "a.lon", "a.uncertainty_m", "a.withheld"),
        f"""SELECT occurrence_id, CASE WHEN {_masked} THEN {_deg.format(c='coalesce(fix_lat,lat)')} ELSE floor(coalesce(fix_lat,lat)*1e6+5e-1)/1e6 END AS lat,
        CASE WHEN {_masked} THEN {_deg.format(c='coalesce(fix_lon,lon)')} ELSE floor(coalesce(fix_lon,lon)*1e6+5e-1)/1e6 END AS lon,
        CASE WHEN {_masked} THEN {_unc} ELSE fix_accuracy_m END AS uncertainty_m,
        CASE WHEN {_masked} THEN '{'Coordenadas omitidas: especie en categoría de conservación o endémica.' if _policy == 'omitida' else 'Coordenadas exactas disponibles para el titular del proyecto.'}' END AS withheld
        FROM flat""")
register("count_sensitive", lambda t: X.count_sensitive(t.flat), "SELECT count(*) FILTER (sensitive) AS sensitive_records FROM flat")

_CHECKED = ["trace.occurrenceId", "event.year", "event.month", "occurrence.amPm", "event.recordedBy", "event.period", "event.performed",
            "campaign.season", "station.region", "station.methodCamara", "occurrence.commonName", "occurrence.count",
            "occurrence.photos", "conservation.category", "effort.label", "trace.pendingFields", "trace.reviewState"]
register("export_fields", lambda t: FL.export_fields(t.flat, _CHECKED).toDF(*[c.replace(".", "_") for c in _CHECKED]),
         """SELECT f.dwc_occurrence_id AS "trace_occurrenceId", substr(f.event_date,1,4) AS event_year,
    CAST(CAST(substr(f.event_date,6,2) AS INTEGER) AS VARCHAR) AS event_month,
    CASE WHEN occurrence_minute>=720 THEN 'PM' ELSE 'AM' END AS "occurrence_amPm",
    coalesce(f.recorded_by, f.station_recorded_by,'') AS "event_recordedBy",
    CASE WHEN e.minute_of_day>=1260 OR e.minute_of_day<300 THEN 'Nocturno' WHEN e.minute_of_day<480 OR e.minute_of_day>=1140 THEN 'Crepuscular' ELSE 'Diurno' END AS event_period,
    CASE e.performed WHEN true THEN 'SI' WHEN false THEN 'NO' ELSE '' END AS event_performed,
    coalesce(f.campaign_season, f.season,'') AS campaign_season, coalesce(f.region, f.project_region,'') AS station_region,
    CASE WHEN f.station_id%2=0 THEN 'Sí' ELSE '' END AS "station_methodCamara",
    coalesce(f.common_name, f.verbatim_taxon,'') AS "occurrence_commonName", coalesce(CAST(f.individual_count AS VARCHAR),'') AS occurrence_count,
    CASE WHEN media_count>0 THEN media_count||' foto(s)' ELSE '' END AS occurrence_photos,
    coalesce(f.badge,'') AS conservation_category, e.effort_label AS effort_label, replace(pending_text,', ','; ') AS "trace_pendingFields",
    review_state AS "trace_reviewState" FROM flat f JOIN effort e ON e.event_id=f.event_id""")

register("photo_label_lines", lambda t: t.flat.select("occurrence_id", F.array_join(F.transform(
    FL.photo_label_lines(["station.code", "event.date", "occurrence.time", FL.LATLON_LINE, "occurrence.notes", "project.name"]),
    lambda line: F.concat_ws("=", line["label"], line["value"])), "|").alias("lines")),
    """SELECT occurrence_id, concat_ws('|', 'Punto='||station_code, 'Fecha='||event_date, 'Hora='||occurrence_time,
    'Coord.=-'||CAST(floor(abs(y)*1e5+5e-1)//100000 AS BIGINT)||'.'||lpad(CAST(CAST(floor(abs(y)*1e5+5e-1) AS BIGINT)%100000 AS VARCHAR),5,'0')||', -'
      ||CAST(floor(abs(x)*1e5+5e-1)//100000 AS BIGINT)||'.'||lpad(CAST(CAST(floor(abs(x)*1e5+5e-1) AS BIGINT)%100000 AS VARCHAR),5,'0'),
    CASE WHEN notes IS NOT NULL THEN 'Observaciones='||notes END, 'Proyecto='||project_name) AS lines
    FROM (SELECT *, coalesce(fix_lat,lat) AS y, coalesce(fix_lon,lon) AS x FROM flat)""")


def _media(t):
    """Every listed media id; each seventh record's files are audio."""
    return t.occurrence.select("event_id", F.explode("media_ids").alias("media_id")).select(
        "media_id", F.when(F.col("event_id") % 7 == 0, "audio").otherwise("foto").alias("kind"), F.lit(True).alias("has_content"))


register("photo_index", lambda t: X.photo_index(t.flat, _media(t)).select("media_id", "photo_index", "file_name"),
         """SELECT occurrence_id||'/'||i AS media_id, i AS photo_index, station_code||'_'||event_date||'_'||replace(occurrence_time,':','')||'_'||
    replace(coalesce(common_name, verbatim_taxon),' ','-')||'_'||i||'.jpg' AS file_name
    FROM flat, (VALUES (1),(2)) AS n(i) WHERE i<=media_count AND event_id%7<>0""")

# --- Darwin Core ---
register("dwca_event", lambda t: X.dwca_event(t.star, policy="generalizada").select(
    "eventID", "eventDate", "month", "samplingProtocol", "sampleSizeValue", "sampleSizeUnit", "samplingEffort", "locality",
    "stateProvince", "recordedBy", "fieldNotes", "parentEventID", "coordinateUncertaintyInMeters", "verbatimCoordinates", "eventRemarks"),
    """SELECT CAST(f.event_id AS VARCHAR) AS "eventID", f.event_date AS "eventDate", CAST(CAST(substr(f.event_date,6,2) AS INTEGER) AS VARCHAR) AS month,
    f.method AS "samplingProtocol", coalesce(CAST(CASE WHEN unit='distancia' AND distance_m IS NOT NULL THEN distance_m
      WHEN unit='trampas-noche' AND trap_nights IS NOT NULL THEN trap_nights ELSE duration_min END AS VARCHAR),'') AS "sampleSizeValue",
    CASE WHEN unit='distancia' AND distance_m IS NOT NULL THEN 'm' WHEN unit='trampas-noche' AND trap_nights IS NOT NULL THEN 'trap-nights'
      WHEN duration_min IS NOT NULL THEN 'minutes' ELSE '' END AS "sampleSizeUnit", effort_label AS "samplingEffort", station_code AS locality,
    coalesce(f.region,'') AS "stateProvince", coalesce(f.recorded_by, f.station_recorded_by,'') AS "recordedBy", coalesce(event_notes,'') AS "fieldNotes",
    CAST(f.campaign_id AS VARCHAR) AS "parentEventID", coalesce(CAST(device_accuracy_m AS VARCHAR),'') AS "coordinateUncertaintyInMeters",
    coalesce('19'||CAST(CAST(utm_east AS BIGINT) AS VARCHAR)||' '||CAST(CAST(utm_north AS BIGINT) AS VARCHAR),'') AS "verbatimCoordinates",
    concat_ws('; ', 'Clima: '||e.weather, 'Periodo: '||CASE WHEN e.minute_of_day>=1260 OR e.minute_of_day<300 THEN 'Nocturno'
      WHEN e.minute_of_day<480 OR e.minute_of_day>=1140 THEN 'Crepuscular' ELSE 'Diurno' END,
      'Temperatura: '||temperature_c||' °C', 'Viento Beaufort: '||wind_beaufort, 'Nubosidad: '||cloud_octas||'/8', 'Precipitación: '||precipitation,
      CASE WHEN no_detections THEN 'Muestreo sin detecciones' END, CASE WHEN incidental THEN 'Registro oportunista fuera de estación' END) AS "eventRemarks"
    FROM first_of f JOIN effort e ON e.event_id=f.event_id""", first_of=_FIRST)

_DWC_COLS = ["occurrenceID", "eventID", "basisOfRecord", "occurrenceStatus", "individualCount", "organismQuantityType", "reproductiveCondition",
             "recordedBy", "occurrenceRemarks", "coordinateUncertaintyInMeters", "vernacularName", "class", "identificationQualifier"]
register("dwca_occurrence", lambda t: X.dwca_occurrence(t.flat, t.event, t.occurrence, policy="omitida").select(*_DWC_COLS),
         """SELECT dwc_occurrence_id AS "occurrenceID", CAST(f.event_id AS VARCHAR) AS "eventID",
    CASE WHEN f.method='camara_trampa' THEN 'MachineObservation' ELSE 'HumanObservation' END AS "basisOfRecord", 'present' AS "occurrenceStatus",
    coalesce(CAST(individual_count AS VARCHAR),'') AS "individualCount", CASE WHEN individual_count IS NULL THEN '' ELSE 'individuos' END AS "organismQuantityType",
    coalesce(reproductive_condition,'') AS "reproductiveCondition", coalesce(recorded_by, station_recorded_by,'') AS "recordedBy",
    concat_ws('; ', 'tipoRegistro='||record_type, 'evidencia='||evidence_kind, CASE WHEN sex_scope='algunos' THEN 'sexoAplicaAAlgunosIndividuos' END,
      CASE WHEN life_stage_scope='algunos' THEN 'estadoAplicaAAlgunosIndividuos' END, CASE WHEN occurrence_time<>event_time THEN 'hora='||occurrence_time END,
      'distanciaDeteccion='||detection_distance_m||' m', CASE WHEN recapture THEN 'recaptura' END, 'conservacion='||badge,
      CASE WHEN review_state<>'terreno' THEN 'revision='||review_state END, notes) AS "occurrenceRemarks",
    CASE WHEN sensitive OR fix_accuracy_m IS NULL THEN '' ELSE CAST(CAST(fix_accuracy_m AS BIGINT) AS VARCHAR) END AS "coordinateUncertaintyInMeters",
    coalesce(common_name, verbatim_taxon,'') AS "vernacularName", coalesce(tax_class,'') AS class,
    CASE confidence WHEN 'probable' THEN 'cf.' WHEN 'posible' THEN '?' ELSE CASE WHEN is_placeholder THEN 'sp.' ELSE '' END END AS "identificationQualifier"
    FROM flat f
    UNION ALL SELECT event_id||':absent', CAST(event_id AS VARCHAR), CASE WHEN method='camara_trampa' THEN 'MachineObservation' ELSE 'HumanObservation' END,
    'absent', '0', '', '', coalesce(recorded_by,''), 'Muestreo realizado sin detecciones de fauna.', '', '', '', ''
    FROM live_event WHERE no_detections AND event_id NOT IN (SELECT event_id FROM live_occ)""")
register("absences", lambda t: X.absences(t.event, t.occurrence).select("occurrenceID", "recordedBy"),
         """SELECT event_id||':absent' AS "occurrenceID", coalesce(recorded_by,'') AS "recordedBy" FROM live_event
    WHERE no_detections AND event_id NOT IN (SELECT event_id FROM live_occ)""")
register("dwca_measurement", lambda t: X.dwca_measurement(t.flat, t.fact),
         """SELECT dwc_occurrence_id AS "occurrenceID", 'alturaDeVuelo' AS "measurementType", CAST(flight_height_m AS VARCHAR) AS "measurementValue",
      'm' AS "measurementUnit", 'estimación visual' AS "measurementMethod" FROM live_occ WHERE flight_height_m IS NOT NULL
    UNION ALL SELECT dwc_occurrence_id, 'categoriaAlturaDeVuelo', flight_height_category, '', 'categorías 1-5 de la planilla' FROM live_occ WHERE flight_height_category IS NOT NULL
    UNION ALL SELECT dwc_occurrence_id, 'direccionDeVuelo', flight_direction, '', '' FROM live_occ WHERE flight_direction IS NOT NULL
    UNION ALL SELECT dwc_occurrence_id, 'origenDeVuelo', flight_origin, '', '' FROM live_occ WHERE flight_origin IS NOT NULL
    UNION ALL SELECT dwc_occurrence_id, 'destinoDeVuelo', flight_destination, '', '' FROM live_occ WHERE flight_destination IS NOT NULL
    UNION ALL SELECT dwc_occurrence_id, 'respuestaPlayback', 'respuesta '||(occurrence_minute%3), '', '' FROM live_occ WHERE event_id%7=3""")

# --- sheets ---
_SCOPES = {
    "registros": "method NOT IN ('transito_aereo','transito_aereo_nocturno','trampa_sherman','camara_trampa')",
    "transito_aereo": "method='transito_aereo'", "transito_aereo_nocturno": "method='transito_aereo_nocturno'",
    "trampeo": "method IN ('trampa_sherman','camara_trampa')", "registros_todos": "true",
}
for _scope, _where in _SCOPES.items():
    register(f"sheet_{_scope}", lambda t, scope=_scope: X.sheet_rows(scope, t.flat).select("occurrence_id", "method"),
             f"SELECT occurrence_id, method FROM flat WHERE {_where}")
register("sheet_muestreos", lambda t: t.on_star(lambda star: X.sheet_rows("muestreos", star, events_dims=_dims(t)).select(
    "event_id", "station_code", "record_type", "occurrence_id")),
    """SELECT event_id, station_code, record_type, occurrence_id FROM first_of
    UNION ALL SELECT event_id, station_code, 'Otro', NULL FROM live_event JOIN station USING (station_id)
    WHERE event_id NOT IN (SELECT event_id FROM live_occ)""", first_of=_FIRST)
register("sheet_estaciones", lambda t: X.sheet_rows("estaciones", t.flat).select("station_code", "occurrence_id"),
         """SELECT station_code, occurrence_id FROM flat WHERE station_code IS NOT NULL QUALIFY row_number() OVER
    (PARTITION BY station_id ORDER BY event_date, occurrence_time, created_s, occurrence_id)=1""")

from fieldtally.plans.reports import _CHOSEN  # noqa: E402

register("sheet_plan", lambda t: t.on_star(lambda star: X.sheet_rows("plan", star, stations=t.station, events=t.event, events_dims=_dims(t)).select(
    "event_id", "station_code", "method", "record_type", "occurrence_id")),
    """SELECT w.event_id, station_code, w.method, coalesce(f.record_type,'Otro') AS record_type, f.occurrence_id FROM (
      SELECT c.event_id, g.station_id, g.method FROM grid g LEFT JOIN chosen c USING (station_id, method)
      UNION ALL SELECT event_id, station_id, method FROM live_event ANTI JOIN grid USING (station_id, method)) w
    JOIN station USING (station_id) LEFT JOIN first_of f ON f.event_id=w.event_id""".replace("coalesce(f.record_type", "coalesce(f.record_type").replace(
        "SELECT w.event_id, station_code", "SELECT w.event_id, station.station_code"), chosen=_CHOSEN, first_of=_FIRST)

_TRAP = X.NATIVE_TEMPLATE[2]
register("native_template", lambda t: X.build_sheet(_TRAP, X.sheet_rows(_TRAP.scope, t.flat)).select("c1", "c5", "c8", "c10", "c11", "c12", "c14", "c36"),
         """SELECT event_date AS c1, station_code AS c5, CASE method WHEN 'camara_trampa' THEN 'Cámara trampa' ELSE 'Trampas Sherman' END AS c8,
    CASE WHEN site_id IS NOT NULL THEN 'Linea '||(station_id%4) ELSE '' END AS c10, coalesce(trap_number,'') AS c11,
    coalesce(common_name, verbatim_taxon,'') AS c12, coalesce(CAST(individual_count AS VARCHAR),'') AS c14,
    dwc_occurrence_id AS c36 FROM flat WHERE method IN ('trampa_sherman','camara_trampa')""")
_OFFICIAL = [("occurrenceID", "trace.occurrenceId", None), ("basisOfRecord", None, "HumanObservation"), ("collectionCode", None, None),
             ("individualCount", "occurrence.count", None), ("recordedBy", "event.recordedBy", None)]
register("regulator_template", lambda t: X.build_sheet(X.sheet_from_table(_OFFICIAL, "Planilla"), t.flat),
         """SELECT dwc_occurrence_id AS c1, 'HumanObservation' AS c2, '' AS c3, coalesce(CAST(individual_count AS VARCHAR),'') AS c4,
    coalesce(recorded_by, station_recorded_by,'') AS c5 FROM flat""")

def _regulator(t):
    """The whole sheet: its known fields by name, all its constants, and how many cells its empty columns hold."""
    sheet = X.regulator_sheet()
    at = {c.header: f"c{i}" for i, c in enumerate(sheet.columns, start=1)}
    fixed = [at[c.header] for c in sheet.columns if c.constant]
    blank = [at[c.header] for c in sheet.columns if not c.constant and not c.field_id]
    named = ["occurrenceID", "recordedBy", "individualCount", "eventDate", "eventTime", "year", "month", "day", "locationID", "stateProvince", "scientificName",
             "vernacularName", "family", "genus", "sex", "eventID"]
    cells = F.array(*[F.col(c) for c in blank])
    return X.build_sheet(sheet, t.flat).select(
        *[F.col(at[h]).alias(h) for h in named], F.concat_ws("|", *fixed).alias("constants"), F.lit(len(at)).alias("n_columns"),
        F.lit(len(blank)).alias("n_empty"), F.size(F.filter(cells, lambda c: c != "")).alias("n_filled"))


register("regulator_sheet", _regulator,
         """SELECT dwc_occurrence_id AS "occurrenceID", coalesce(recorded_by, station_recorded_by,'') AS "recordedBy",
    coalesce(CAST(individual_count AS VARCHAR),'') AS "individualCount", event_date AS "eventDate", occurrence_time AS "eventTime", substr(event_date,1,4) AS "year",
    CAST(CAST(substr(event_date,6,2) AS INTEGER) AS VARCHAR) AS "month", CAST(CAST(substr(event_date,9,2) AS INTEGER) AS VARCHAR) AS "day", station_code AS "locationID",
    coalesce(region, project_region,'') AS "stateProvince", coalesce(scientific_name,'') AS "scientificName", coalesce(common_name, verbatim_taxon,'') AS "vernacularName",
    coalesce(family,'') AS family, coalesce(genus,'') AS genus, coalesce(sex,'') AS sex, CAST(event_id AS VARCHAR) AS "eventID",
    'HumanObservation|Event|es|Individuos|Presente|metros|South America|Chile|CL|UTM|WGS84|WGS84|species|ICZN' AS constants,
    170 AS n_columns, 103 AS n_empty, 0 AS n_filled FROM flat""")

# --- files: written to the shared folder and read back ---


def _folder(t, kind):
    from fieldtally.session import shared_folder

    return shared_folder(t.spark, kind)


def _dwca_files(t):
    path = _folder(t, "dwca")
    flat = t.star
    files.write_dwca(X.dwca_event(flat), X.dwca_occurrence(flat, t.event, t.occurrence), X.dwca_measurement(flat, t.fact), path)
    read = lambda name: t.spark.read.csv(f"{path}/{name}", sep="\t", header=True, quote="")
    return read("occurrence").select("occurrenceID", "occurrenceStatus", "vernacularName")


def _occurrence_csv(t):
    path = _folder(t, "occurrence-csv")
    files.write_occurrence_csv(X.dwca_present(t.flat), path)
    return t.spark.read.csv(path, header=True, escape='"').select("occurrenceID", "eventID", "recordedBy")


def _template_files(t):
    path = _folder(t, "template")
    rows = X.build_sheet(_TRAP, X.sheet_rows(_TRAP.scope, t.flat))
    files.write_template({_TRAP.name: rows}, {_TRAP.name: [c.header for c in _TRAP.columns]}, path)
    return t.spark.read.csv(f"{path}/{_TRAP.name}/rows", escape='"').select(F.col("_c0").alias("date"), F.col("_c35").alias("record"))


def _backup_files(t):
    """A backup with all columns of four tables, written, read again and counted against its own figures."""
    path = _folder(t, "backup")
    tables = {"events": t.event, "occurrences": t.occurrence, "audit": t.change_log, "outbox": t.outbox_item}
    files.write_backup(tables, path, marker="field-backup", device_id="d1", created_at="2026-01-01T00:00:00Z")
    out = files.read_backup_folder(t.spark, path, {n: df.schema.simpleString()[7:-1] for n, df in tables.items()}, marker="field-backup")
    keys = {"events": "event_id", "occurrences": "event_id", "audit": "seq", "outbox": "seq"}
    read = reduce(DataFrame.unionByName, [
        out[n].select(F.lit(n).alias("name"), F.col(k).alias("key"), (out[n][k].isNotNull() & (F.col("source_device") == "d1")).alias("whole"))
        for n, k in keys.items()])
    found = read.groupBy("name").agg(F.count_if("whole").alias("rows"), F.sum("key").alias("keys"))
    return found.join(out["counts"].select(F.col("table").alias("name"), F.col("rows").alias("declared")), "name")


def _backup_documents(t):
    """One backup document per station, as a device would leave it, then read as files."""
    path = _folder(t, "backup-files")
    rows = F.collect_list(F.struct(F.col("event_id").alias("id"), "method"))
    docs = t.event.groupBy("station_id").agg(rows.alias("events")).select(
        F.lit("field-backup").alias("format"), F.when(F.col("station_id") == 7, 9).otherwise(1).alias("version"),
        F.col("station_id").cast("string").alias("deviceId"), F.struct("events").alias("data"))
    # One document per file is the device's format: a partition of the writer per device. Tasks move their files
    # themselves, as there are too many for the driver to move one after another.
    docs.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("deviceId").json(path)
    out = files.read_backups(t.spark, f"{path}/*", {"events": "id: bigint, method: string"}, marker="field-backup")
    return out["events"].select("id", "method")


register("write_dwca", _dwca_files,
         """SELECT dwc_occurrence_id AS "occurrenceID", 'present' AS "occurrenceStatus", coalesce(common_name, verbatim_taxon) AS "vernacularName" FROM flat
    UNION ALL SELECT event_id||':absent', 'absent', NULL FROM live_event WHERE no_detections AND event_id NOT IN (SELECT event_id FROM live_occ)""")
register("write_occurrence_csv", _occurrence_csv,
         """SELECT dwc_occurrence_id AS "occurrenceID", CAST(event_id AS VARCHAR) AS "eventID", coalesce(recorded_by, station_recorded_by) AS "recordedBy" FROM flat""")
register("write_template", _template_files,
         "SELECT event_date AS date, dwc_occurrence_id AS record FROM flat WHERE method IN ('trampa_sherman','camara_trampa')")
register("write_backup", _backup_files,
         " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, CAST(sum({k}) AS BIGINT) AS keys, count(*) AS declared FROM {v}" for n, k, v in (
             ("events", "event_id", "event"), ("occurrences", "event_id", "occurrence"), ("audit", "seq", "change_log"), ("outbox", "seq", "outbox_item"))))
register("read_backups", _backup_documents, "SELECT event_id AS id, method FROM event WHERE station_id<>7")


def _with_facts(t):
    from fieldtally.operators.star import flatten

    flat = flatten(t.occurrence, t.event, t.station, t.taxon, t.project, t.campaign, t.fact)
    told = F.transform("facts", lambda f: F.concat_ws("=", f["measurement_type"], f["measurement_value"]))
    return flat.select("occurrence_id", "station_code", F.array_join(told, "|").alias("facts"))


register("flatten_facts", _with_facts,
         """SELECT occurrence_id, station_code, CASE WHEN event_id%7=3 THEN 'respuestaPlayback=respuesta '||(occurrence_minute%3) ELSE '' END AS facts FROM flat""")


def _preamble_files(t):
    """The trap sheet under a preamble with markers, known and unknown, written and read back."""
    path = _folder(t, "template")
    rows = X.build_sheet(_TRAP, X.sheet_rows(_TRAP.scope, t.flat))
    above = [["Proyecto", "{{project}}", "{{nothing}}"], [], ["Generado el {{date}}, {{date}}"]]
    files.write_template({_TRAP.name: rows}, {_TRAP.name: [c.header for c in _TRAP.columns]}, path,
                         preambles={_TRAP.name: above}, values={"project": "Línea, \"base\"", "date": "2026-09-04"})
    return t.spark.read.csv(f"{path}/{_TRAP.name}/preamble", escape='"').select(F.col("_c0").cast("int").alias("row_no"), F.concat_ws("|", "_c1", "_c2").alias("cells"))


def _whole_backup(t):
    """All eight tables with all their columns, written, read again and compared row by row in both directions."""
    path = _folder(t, "backup-all")
    tables = {
        "events": t.event, "occurrences": t.occurrence, "identifications": t.occurrence.select("occurrence_id", "taxon_id", "confidence", "created_at"),
        "measurements": t.fact, "audit": t.change_log, "outbox": t.outbox_item,
        "syncLog": t.outbox_item.select("item_id", "seq", F.col("queued_at").alias("at"), "outcome"),
        "settings": t.raw("nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value")),
    }
    files.write_backup(tables, path, marker="field-backup", device_id="d1", created_at="2026-01-01T00:00:00Z")
    out = files.read_backup_folder(t.spark, path, {n: df.schema.simpleString()[7:-1] for n, df in tables.items()}, marker="field-backup")

    def marked(df, side):
        return df.groupBy(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n")).select("h", (F.col("n") * side).alias("n"))

    def compared(name):
        back = out[name].select(*tables[name].columns)
        both = marked(tables[name], 1).unionByName(marked(back, -1)).groupBy("h").agg(F.sum("n").alias("n"))
        return both.agg(F.lit(name).alias("name"), F.count_if(F.col("n") != 0).alias("different"))

    different = reduce(DataFrame.unionByName, [compared(n) for n in tables])
    return different.join(out["counts"].select(F.col("table").alias("name"), F.col("rows").alias("declared")), "name")


register("write_template_preamble", _preamble_files,
         """SELECT v.n AS row_no, v.c AS cells FROM (VALUES (1,'Proyecto|Línea, "base"'),(2,''),(3,'Generado el 2026-09-04, 2026-09-04')) AS v(n,c)""")
register("write_backup_all", _whole_backup,
         " UNION ALL ".join(f"SELECT '{n}' AS name, 0 AS different, count(*) AS declared FROM {v}" for n, v in (
             ("events", "event"), ("occurrences", "lineitem"), ("identifications", "lineitem"), ("measurements", "lineitem WHERE l_orderkey%7=3"), ("audit", "change_log"),
             ("outbox", "outbox_item"), ("syncLog", "outbox_item"), ("settings", "nation"))))


def _native_sheets(t):
    """Every sheet of the native workbook: its columns, its rows, and how many different first cells they have."""
    dims, stations, events = _dims(t), t.station, t.event

    def counted(sheet, star):
        rows = X.build_sheet(sheet, X.sheet_rows(sheet.scope, star, stations=stations, events=events, events_dims=dims))
        return rows.agg(F.lit(sheet.name).alias("sheet"), F.lit(len(rows.columns)).alias("n_columns"), F.count(F.lit(1)).alias("rows"), F.countDistinct("c1").alias("first_cells"))

    return t.on_star(lambda star: reduce(DataFrame.unionByName, [counted(s, star) for s in X.NATIVE_TEMPLATE]))


_SHEET = "SELECT '{0}' AS sheet, {1} AS n_columns, count(*) AS rows, count(DISTINCT {2}) AS first_cells FROM {3}"
_PLANNED = """(SELECT station_code FROM (
      SELECT c.event_id, g.station_id, g.method FROM grid g LEFT JOIN chosen c USING (station_id, method)
      UNION ALL SELECT event_id, station_id, method FROM live_event ANTI JOIN grid USING (station_id, method)) w JOIN station USING (station_id))"""
_SAMPLED = """(SELECT event_id FROM first_of UNION ALL SELECT event_id FROM live_event WHERE event_id NOT IN (SELECT event_id FROM live_occ))"""
register("native_sheets", _native_sheets, " UNION ALL ".join(_SHEET.format(*row) for row in (
    ("Registros", 53, "event_date", f"flat WHERE {_SCOPES['registros']}"), ("Plan", 14, "station_code", _PLANNED),
    ("Trampeo", 38, "event_date", f"flat WHERE {_SCOPES['trampeo']}"), ("MTAN", 27, "event_date", f"flat WHERE {_SCOPES['transito_aereo_nocturno']}"),
    ("Tránsito aéreo", 32, "event_date", f"flat WHERE {_SCOPES['transito_aereo']}"), ("Muestreos", 17, "event_id", _SAMPLED),
    ("Estaciones", 22, "station_code", "(SELECT DISTINCT station_code FROM flat WHERE station_code IS NOT NULL)"))), chosen=_CHOSEN, first_of=_FIRST)
