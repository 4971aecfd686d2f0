"""The named fields a report column can show, each a column expression over the flat table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import survey as S
from fieldtally.functions import vocab as V
from fieldtally.functions.geo import to_utm
from fieldtally.functions.text import half_up, number_text


def text(c: Column | str) -> Column:
    """Text of a value, empty for null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def number(c: Column | str) -> Column:
    return F.coalesce(number_text(F.col(c) if isinstance(c, str) else c), F.lit(""))


def yes(c: Column) -> Column:
    return F.when(c, "Sí").otherwise("")


def coordinates_of() -> Column:
    """struct(lat, lon, utm_east, utm_north, zone, datum, source): own fix, else station, else none."""
    fix_utm = to_utm("fix_lat", "fix_lon", F.col("utm_zone"))
    own, at_station = F.col("fix_lat").isNotNull(), F.coalesce("has_station", F.lit(False))
    zone, datum = F.col("utm_zone"), F.coalesce("datum", F.lit("WGS84"))
    return F.struct(
        F.when(own, F.col("fix_lat")).when(at_station, F.col("lat")).alias("lat"),
        F.when(own, F.col("fix_lon")).when(at_station, F.col("lon")).alias("lon"),
        F.when(own & zone.isNotNull(), fix_utm["east"]).when(~own & at_station, F.col("utm_east")).alias("utm_east"),
        F.when(own & zone.isNotNull(), fix_utm["north"]).when(~own & at_station, F.col("utm_north")).alias("utm_north"),
        zone.alias("zone"), datum.alias("datum"),
        F.when(own, "avistamiento").when(at_station, "estacion").otherwise("ninguna").alias("source"),
    )


@dataclass(frozen=True)
class Field:
    label: str
    group: str
    build: Callable[[], Column]


def _plain(column: str) -> Callable[[], Column]:
    return lambda: text(column)


def _num(column: str) -> Callable[[], Column]:
    return lambda: number(column)


def _date_part(start: int, length: int) -> Callable[[], Column]:
    return lambda: text(F.substring("event_date", start, length).try_cast("int"))


def _declares(method: str) -> Callable[[], Column]:
    return lambda: yes(F.array_contains("methods", method))


def _own(part: str) -> Callable[[], Column]:
    return lambda: F.when(F.col("fix_lat").isNotNull(), number(coordinates_of()[part])).otherwise("")


EVENT, STATION, RECORD, TAXONOMY = "Evento", "Estación", "Registro", "Taxonomía"
FLIGHT, EFFORT, CONSERVATION, TRACE = "Vuelo", "Esfuerzo", "Conservación", "Trazabilidad"

# Field ids and labels that templates refer to.
FIELDS: dict[str, Field] = {
    "event.date": Field("Fecha", EVENT, _plain("event_date")),
    "event.year": Field("Año", EVENT, _date_part(1, 4)),
    "event.month": Field("Mes", EVENT, _date_part(6, 2)),
    "event.day": Field("Día", EVENT, _date_part(9, 2)),
    "occurrence.time": Field("Hora", EVENT, _plain("occurrence_time")),
    "occurrence.amPm": Field("AM/PM", EVENT, lambda: S.am_pm("occurrence_time")),
    "event.method": Field("Metodología", EVENT, lambda: text(S.lookup("method", V.METHODS))),
    "event.recordedBy": Field("Observador", EVENT, lambda: text(F.coalesce("recorded_by", "station_recorded_by"))),
    "event.identifiedBy": Field("Identificado por", EVENT, _plain("identified_by")),
    "event.team": Field("Equipo", EVENT, _plain("team")),
    "event.weather": Field("Clima", EVENT, _plain("weather")),
    "event.period": Field("Periodo del día", EVENT, lambda: text(S.infer_period("event_time"))),
    "event.temperature": Field("Temperatura (°C)", EVENT, _num("temperature_c")),
    "event.wind": Field("Viento (Beaufort)", EVENT, _num("wind_beaufort")),
    "event.cloud": Field("Nubosidad (octas)", EVENT, _num("cloud_octas")),
    "event.precipitation": Field("Precipitación", EVENT, _plain("precipitation")),
    "event.performed": Field("¿Se realizó?", EVENT,
                             lambda: F.when(F.col("performed"), "SI").when(~F.col("performed"), "NO").otherwise("")),
    "event.notPerformedReason": Field("¿Por qué no se realizó?", EVENT, _plain("not_performed_reason")),
    "event.noDetections": Field("Sin detecciones", EVENT, lambda: yes(F.col("no_detections"))),
    "event.notes": Field("Observaciones del muestreo", EVENT, _plain("event_notes")),
    "event.id": Field("ID del muestreo", EVENT, _plain("event_id")),
    "project.name": Field("Proyecto", STATION, _plain("project_name")),
    "project.client": Field("Cliente", STATION, _plain("client")),
    "campaign.name": Field("Campaña", STATION, _plain("campaign_name")),
    "campaign.season": Field("Temporada", STATION, lambda: text(F.coalesce("campaign_season", "season"))),
    "station.code": Field("ID Estación", STATION, _plain("station_code")),
    "station.darwinCoreLocationId": Field("ID Estación DwC", STATION, _plain("dwc_location_id")),
    "station.finalCode": Field("ID Final Estación", STATION, _plain("final_code")),
    "station.sector": Field("Sector", STATION, _plain("sector")),
    "station.region": Field("Región", STATION, lambda: text(F.coalesce("region", "project_region"))),
    "station.habitat": Field("Ambiente", STATION, _plain("habitat")),
    "station.slope": Field("Ladera de exposición", STATION, _plain("slope_aspect")),
    "station.utmEast": Field("UTM E estación", STATION, _num("utm_east")),
    "station.utmNorth": Field("UTM N estación", STATION, _num("utm_north")),
    "station.utmStartEast": Field("UTM E inicio", STATION, _num("utm_start_east")),
    "station.utmStartNorth": Field("UTM N inicio", STATION, _num("utm_start_north")),
    "station.utmEndEast": Field("UTM E fin", STATION, _num("utm_end_east")),
    "station.utmEndNorth": Field("UTM N fin", STATION, _num("utm_end_north")),
    "station.latitude": Field("Latitud estación", STATION, _num("lat")),
    "station.longitude": Field("Longitud estación", STATION, _num("lon")),
    "station.methodTransecto": Field("¿Transecto?", STATION, _declares("transecto")),
    "station.methodPlaybackAves": Field("¿Playback aves?", STATION, _declares("playback_aves")),
    "station.methodPlaybackAnfibios": Field("¿Playback anfibios?", STATION, _declares("playback_anfibios")),
    "station.methodCamara": Field("¿Cámara trampa?", STATION, _declares("camara_trampa")),
    "station.methodSherman": Field("¿Trampas Sherman?", STATION, _declares("trampa_sherman")),
    "occurrence.commonName": Field("Nombre común", RECORD, lambda: text(F.coalesce("common_name", "verbatim_taxon"))),
    "occurrence.recordType": Field("Tipo de registro", RECORD, _plain("record_type")),
    "occurrence.evidenceKind": Field("Directo/Indirecto", RECORD, _plain("evidence_kind")),
    "occurrence.count": Field("Abundancia", RECORD, _num("individual_count")),
    "occurrence.sex": Field("Sexo", RECORD, _plain("sex")),
    "occurrence.lifeStage": Field("Estado de desarrollo", RECORD, _plain("life_stage")),
    "occurrence.condition": Field("Estado del organismo", RECORD, _plain("organism_condition")),
    "occurrence.behaviour": Field("Comportamiento", RECORD, _plain("behaviour")),
    "occurrence.notes": Field("Observaciones", RECORD, _plain("notes")),
    "occurrence.photos": Field("Fotos", RECORD, lambda: F.when(
        F.size("media_ids") > 0, F.concat(F.size("media_ids").cast("string"), F.lit(" foto(s)"))).otherwise("")),
    "occurrence.confidence": Field("Confianza de identificación", RECORD, _plain("confidence")),
    "occurrence.detectionDistance": Field("Distancia de detección (m)", RECORD, _num("detection_distance_m")),
    "occurrence.organismId": Field("Código del individuo", RECORD, _plain("organism_id")),
    "occurrence.reproductiveCondition": Field("Condición reproductiva", RECORD, _plain("reproductive_condition")),
    "occurrence.trapNumber": Field("N° de trampa", RECORD, _plain("trap_number")),
    "site.installedOn": Field("Fecha instalación", STATION, _plain("site_installed_on")),
    "occurrence.site": Field("Punto o línea", RECORD, _plain("site_name")),
    "occurrence.recapture": Field("Recaptura", RECORD, lambda: yes(F.col("recapture"))),
    "occurrence.utmEast": Field("UTM E del avistamiento", RECORD, _own("utm_east")),
    "occurrence.utmNorth": Field("UTM N del avistamiento", RECORD, _own("utm_north")),
    "occurrence.latitude": Field("Latitud del avistamiento", RECORD, _num("fix_lat")),
    "occurrence.longitude": Field("Longitud del avistamiento", RECORD, _num("fix_lon")),
    "taxon.scientificName": Field("Nombre científico", TAXONOMY, _plain("scientific_name")),
    "taxon.kingdom": Field("Reino", TAXONOMY, _plain("kingdom")),
    "taxon.phylum": Field("Filo", TAXONOMY, _plain("phylum")),
    "taxon.class": Field("Clase", TAXONOMY, lambda: text(F.coalesce("class_es", "tax_class"))),
    "taxon.classLatin": Field("Clase (latín)", TAXONOMY, _plain("tax_class")),
    "taxon.order": Field("Orden", TAXONOMY, _plain("tax_order")),
    "taxon.family": Field("Familia", TAXONOMY, _plain("family")),
    "taxon.genus": Field("Género", TAXONOMY, _plain("genus")),
    "taxon.specificEpithet": Field("Epíteto específico", TAXONOMY, _plain("specific_epithet")),
    "taxon.infraspecificEpithet": Field("Epíteto infraespecífico", TAXONOMY, _plain("infra_epithet")),
    "taxon.rank": Field("Rango taxonómico", TAXONOMY, _plain("taxon_rank")),
    "aerial.origin": Field("Origen del vuelo", FLIGHT, _plain("flight_origin")),
    "aerial.destination": Field("Destino del vuelo", FLIGHT, _plain("flight_destination")),
    "aerial.direction": Field("Dirección de vuelo", FLIGHT, _plain("flight_direction")),
    "aerial.heightCategory": Field("Categoría de altura", FLIGHT, _plain("flight_height_category")),
    "aerial.heightReference": Field("Referencia de altura", FLIGHT, _plain("flight_height_reference")),
    "aerial.flightType": Field("Tipo de vuelo", FLIGHT, _plain("flight_type")),
    "event.timeBlock": Field("Bloque horario", EVENT, _plain("time_block")),
    "aerial.heightMeters": Field("Altura de vuelo (m)", FLIGHT, _num("flight_height_m")),
    "effort.label": Field("Esfuerzo", EFFORT, _plain("effort_label")),
    "effort.duration": Field("Duración (min)", EFFORT, _num("duration_min")),
    "effort.distance": Field("Distancia recorrida (m)", EFFORT, _num("effort_distance_m")),
    "effort.trapNights": Field("Trampas-noche", EFFORT, _num("trap_nights")),
    "conservation.category": Field("Categoría de conservación", CONSERVATION, lambda: text(S.conservation_badge("rce", "iucn"))),
    "conservation.origin": Field("Origen", CONSERVATION, _plain("origin")),
    "conservation.endemic": Field("Endémica", CONSERVATION,
                                  lambda: F.when(F.col("endemic"), "Sí").when(~F.col("endemic"), "No").otherwise("")),
    "conservation.source": Field("Fuente de conservación", CONSERVATION, _plain("conservation_source")),
    "trace.deferredEntry": Field("Anotado después", TRACE, lambda: yes(F.col("deferred"))),
    "trace.occurrenceId": Field("ID del registro", TRACE, _plain("dwc_occurrence_id")),
    "trace.syncState": Field("Estado de sincronización", TRACE, lambda: text(S.lookup(
        "sync_state", {"synced": "Sincronizado", "error": "Error", "pending": "Pendiente"}, F.col("sync_state")))),
    "trace.reviewState": Field("Estado de revisión", TRACE, _plain("review_state")),
    "trace.source": Field("Origen del registro", TRACE, _plain("source")),
    "trace.utterance": Field("Dictado original", TRACE, _plain("utterance")),
    "trace.pendingFields": Field("Campos pendientes", TRACE, lambda: text(F.array_join("pending_fields", "; "))),
    "trace.createdBy": Field("Creado por", TRACE, _plain("created_by")),
    "trace.createdAt": Field("Creado el", TRACE, _plain("created_at")),
    "trace.updatedBy": Field("Modificado por", TRACE, _plain("updated_by")),
    "trace.updatedAt": Field("Modificado el", TRACE, _plain("updated_at")),
}


def field(field_id: str) -> Column:
    """Text column of a field; an unknown id is an empty column."""
    known = FIELDS.get(field_id)
    return known.build() if known else F.lit("")


def export_fields(flat: DataFrame, field_ids: list[str] | None = None, *, now: str = "2030-01-01 00:00:00") -> DataFrame:
    """The chosen fields as columns named by field id; effort is added only when asked for."""
    from fieldtally.operators.effort import effort_summary

    ids = list(FIELDS) if field_ids is None else field_ids
    rows = effort_summary(flat, now=now) if any(i.startswith("effort.") for i in ids) else flat
    return rows.select(*[field(i).alias(i) for i in ids])


# --- photographs --------------------------------------------------------------------------

UTM_LINE, LATLON_LINE = "__utm", "__latlon"
DEFAULT_LABEL_FIELDS = ["station.code", "event.date", "occurrence.time", UTM_LINE, "project.name"]
_SHORT_LABELS = {
    "station.code": "Punto", "station.finalCode": "Punto", "project.name": "Proyecto", "event.date": "Fecha",
    "occurrence.time": "Hora", "event.recordedBy": "Observador", UTM_LINE: "UTM", LATLON_LINE: "Coord.",
}


def _whole(c: Column) -> Column:
    return half_up(c).cast("bigint").cast("string")


def fixed_decimals(c: Column, decimals: int) -> Column:
    """Decimal text with a fixed number of digits and a point, whatever the locale."""
    scaled = F.floor(F.abs(c) * 10**decimals + 0.5).cast("bigint")
    whole, rest = F.floor(scaled / 10**decimals).cast("string"), (scaled % 10**decimals).cast("string")
    sign = F.when((c < 0) & (scaled > 0), "-").otherwise("")
    return F.concat(sign, whole, F.lit("."), F.lpad(rest, decimals, "0"))


def label_value(field_id: str) -> Column:
    point = coordinates_of()
    if field_id == UTM_LINE:
        zone = F.when(point["zone"].isNotNull(), F.concat(point["zone"].cast("string"), F.lit("S "))).otherwise("")
        return F.concat(zone, _whole(point["utm_east"]), F.lit(" E / "), _whole(point["utm_north"]), F.lit(" N"))
    if field_id == LATLON_LINE:
        return F.concat(fixed_decimals(point["lat"], 5), F.lit(", "), fixed_decimals(point["lon"], 5))
    return field(field_id)


def photo_label_lines(field_ids: list[str] | None = None) -> Column:
    """Ordered array of struct(label, value); lines without a value are left out."""
    ids = DEFAULT_LABEL_FIELDS if field_ids is None else field_ids
    lines = []
    for i in ids:
        name = _SHORT_LABELS.get(i) or (FIELDS[i].label if i in FIELDS else i)
        lines.append(F.struct(F.lit(name).alias("label"), F.coalesce(label_value(i), F.lit("")).alias("value")))
    return F.filter(F.array(*lines), lambda line: line["value"] != "")


def _file_part(c: Column) -> Column:
    from fieldtally.functions.text import strip_accents

    return F.regexp_replace(F.regexp_replace(strip_accents(c), r"[^A-Za-z0-9-]+", "-"), r"^-+|-+$", "")


def photo_file_name(index: Column | str = "photo_index") -> Column:
    """``station_date_hhmm_species_n.jpg`` without accents or blanks."""
    parts = [
        F.coalesce("final_code", "station_code", F.lit("sin-punto")),
        F.col("event_date"),
        F.regexp_replace(F.coalesce("occurrence_time", "event_time", F.lit("")), "^([^:]*):", "$1"),
        F.coalesce("common_name", "verbatim_taxon", F.lit("sin-especie")),
        (F.col(index) if isinstance(index, str) else index).cast("string"),
    ]
    named = [F.when(~F.coalesce(p == "", F.lit(True)), _file_part(p)) for p in parts]
    return F.concat(F.concat_ws("_", *named), F.lit(".jpg"))
