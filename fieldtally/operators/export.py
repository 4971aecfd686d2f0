"""Report sheets, Darwin Core tables and the protection of sensitive locations."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field as dc_field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import survey as S
from fieldtally.functions import vocab as V
from fieldtally.functions.fields import FIELDS, coordinates_of, field, number, photo_file_name
from fieldtally.functions.text import blank, half_up, number_text
from fieldtally.operators import coverage as C
from fieldtally.operators.effort import effort_summary
from fieldtally.operators.star import one_per_key

POLICIES = ("exacta", "generalizada", "omitida")
GRID_DEGREES = 0.01
GRID_METERS = 1100.0


# --- sensitive locations ------------------------------------------------------------------

def apply_sensitivity(lat: Column, lon: Column, uncertainty: Column, sensitive: Column, policy: str) -> Column:
    """struct(lat, lon, uncertainty_m, generalizations, withheld) under a policy.

    exacta keeps six decimals; generalizada snaps sensitive taxa to a 0.01° grid with at least
    1100 m of uncertainty; omitida removes their position.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    none = F.lit(None).cast("string")
    hide = F.coalesce(sensitive, F.lit(False)) & F.lit(policy != "exacta")
    snap = lambda c: half_up(half_up(c / GRID_DEGREES) * GRID_DEGREES, 6)
    gone = policy == "omitida"
    return F.struct(
        F.when(~hide, half_up(lat, 6)).otherwise(F.lit(None).cast("double") if gone else snap(lat)).alias("lat"),
        F.when(~hide, half_up(lon, 6)).otherwise(F.lit(None).cast("double") if gone else snap(lon)).alias("lon"),
        F.when(~hide, uncertainty).otherwise(
            F.lit(None).cast("double") if gone else F.greatest(F.coalesce(uncertainty, F.lit(0.0)), F.lit(GRID_METERS))
        ).alias("uncertainty_m"),
        F.when(hide, none if gone else F.lit("Coordenadas generalizadas a 0.01° por sensibilidad de la especie."))
        .alias("generalizations"),
        F.when(hide, F.lit("Coordenadas omitidas: especie en categoría de conservación o endémica.") if gone
               else F.lit("Coordenadas exactas disponibles para el titular del proyecto.")).alias("withheld"),
    )


def count_sensitive(flat: DataFrame) -> DataFrame:
    return flat.agg(F.count_if(S.is_sensitive("rce", "iucn", "endemic")).alias("sensitive_records"))


# --- Darwin Core --------------------------------------------------------------------------

def _text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def event_remarks() -> Column:
    period = S.infer_period("event_time")
    return F.concat_ws(
        "; ",
        F.when(~blank("weather"), F.concat(F.lit("Clima: "), F.col("weather"))),
        F.when(period.isNotNull(), F.concat(F.lit("Periodo: "), period)),
        F.concat(F.lit("Temperatura: "), number_text(F.col("temperature_c")), F.lit(" °C")),
        F.concat(F.lit("Viento Beaufort: "), number_text(F.col("wind_beaufort"))),
        F.concat(F.lit("Nubosidad: "), number_text(F.col("cloud_octas")), F.lit("/8")),
        F.when(~blank("precipitation"), F.concat(F.lit("Precipitación: "), F.col("precipitation"))),
        F.when(F.col("no_detections"), "Muestreo sin detecciones"),
        F.when(F.col("incidental"), "Registro oportunista fuera de estación"),
    )


def occurrence_remarks() -> Column:
    badge = S.conservation_badge("rce", "iucn")
    return F.concat_ws(
        "; ",
        F.concat(F.lit("tipoRegistro="), F.col("record_type")),
        F.concat(F.lit("evidencia="), F.col("evidence_kind")),
        F.when(F.col("sex_scope") == "algunos", "sexoAplicaAAlgunosIndividuos"),
        F.when(F.col("life_stage_scope") == "algunos", "estadoAplicaAAlgunosIndividuos"),
        F.when(~blank("occurrence_time") & ~F.col("occurrence_time").eqNullSafe(F.col("event_time")),
               F.concat(F.lit("hora="), F.col("occurrence_time"))),
        F.concat(F.lit("distanciaDeteccion="), number_text(F.col("detection_distance_m")), F.lit(" m")),
        F.when(F.col("recapture"), "recaptura"),
        F.concat(F.lit("conservacion="), badge),
        F.when(~blank("review_state") & (F.col("review_state") != "terreno"),
               F.concat(F.lit("revision="), F.col("review_state"))),
        F.when(~blank("notes"), F.col("notes")),
    )


def dwca_event(flat: DataFrame, *, policy: str = "exacta", now: str = "2030-01-01 00:00:00") -> DataFrame:
    """One row per event with a record, in Darwin Core terms.

    The position is the first record's. Under a policy other than exacta it is the station's,
    so that a masked species cannot be located through its event.
    """
    rows = effort_summary(one_per_key(flat, "event_id"), now=now)
    point = coordinates_of()
    open_position = F.lit(policy == "exacta")
    lat = F.when(open_position, point["lat"]).otherwise(F.col("lat"))
    lon = F.when(open_position, point["lon"]).otherwise(F.col("lon"))
    east = F.when(open_position, point["utm_east"]).otherwise(F.col("utm_east"))
    north = F.when(open_position, point["utm_north"]).otherwise(F.col("utm_north"))
    by_distance = (F.col("unit") == "distancia") & F.col("effort_distance_m").isNotNull()
    by_traps = (F.col("unit") == "trampas-noche") & F.col("trap_nights").isNotNull()
    by_time = F.col("duration_min").isNotNull()
    size = F.when(by_distance, number("effort_distance_m")).when(by_traps, number("trap_nights")).when(
        by_time, number("duration_min")).otherwise("")
    unit = F.when(by_distance, "m").when(by_traps, "trap-nights").when(by_time, "minutes").otherwise("")
    terms = {
        "eventID": F.col("event_id"), "eventDate": F.col("event_date"), "eventTime": F.col("event_time"),
        "year": F.substring("event_date", 1, 4), "month": F.substring("event_date", 6, 2).try_cast("int"),
        "day": F.substring("event_date", 9, 2).try_cast("int"),
        "samplingProtocol": F.col("method"), "sampleSizeValue": size, "sampleSizeUnit": unit,
        "samplingEffort": F.col("effort_label"), "locationID": F.col("dwc_location_id"), "locality": F.col("station_code"),
        "decimalLatitude": number_text(lat), "decimalLongitude": number_text(lon), "geodeticDatum": point["datum"],
        "coordinateUncertaintyInMeters": number_text(F.col("device_accuracy_m")),
        "verbatimCoordinates": F.concat(_text_of(point["zone"]), number_text(east), F.lit(" "), number_text(north)),
        "verbatimCoordinateSystem": F.lit("UTM"), "verbatimSRS": point["datum"],
        "country": F.lit("Chile"), "countryCode": F.lit("CL"),
        "stateProvince": F.col("region"), "habitat": F.col("habitat"),
        "recordedBy": F.coalesce("recorded_by", "station_recorded_by"), "fieldNotes": F.col("event_notes"),
        "parentEventID": F.col("campaign_id"), "eventRemarks": event_remarks(),
    }
    return rows.select(*[_text_of(c).alias(t) for t, c in terms.items()])


def dwca_present(flat: DataFrame, *, policy: str = "exacta", reproductive: bool = True) -> DataFrame:
    """Occurrence rows of the records, positions under the sensitivity policy."""
    point = coordinates_of()
    safe = apply_sensitivity(
        point["lat"], point["lon"], F.col("fix_accuracy_m"), S.is_sensitive("rce", "iucn", "endemic"), policy
    )
    count = number_text(F.col("individual_count"))
    terms = {
        "occurrenceID": F.col("dwc_occurrence_id"), "eventID": F.col("event_id"),
        "basisOfRecord": S.basis_of_record("method"), "occurrenceStatus": F.lit("present"), "individualCount": count,
        "organismID": F.col("organism_id"), "dataGeneralizations": F.col("_safe.generalizations"),
        "informationWithheld": F.col("_safe.withheld"), "organismQuantity": count,
        "organismQuantityType": F.when(count.isNotNull(), "individuos"),
        "sex": F.col("sex"), "lifeStage": F.col("life_stage"), "behavior": F.col("behaviour"),
        "reproductiveCondition": F.col("reproductive_condition") if reproductive else F.lit(""),
        "vitality": F.col("organism_condition"), "establishmentMeans": F.lit(""),
        "recordedBy": F.coalesce("recorded_by", "station_recorded_by"), "identifiedBy": F.col("identified_by"),
        "dateIdentified": F.lit(""), "identificationRemarks": F.lit(""), "occurrenceRemarks": occurrence_remarks(),
        "associatedMedia": F.array_join("media_ids", " | "),
        "decimalLatitude": number_text(F.col("_safe.lat")), "decimalLongitude": number_text(F.col("_safe.lon")),
        "coordinateUncertaintyInMeters": number_text(F.col("_safe.uncertainty_m")),
        "scientificName": F.col("scientific_name"), "vernacularName": F.coalesce("common_name", "verbatim_taxon"),
        "kingdom": F.col("kingdom"), "phylum": F.col("phylum"), "class": F.col("tax_class"), "order": F.col("tax_order"),
        "family": F.col("family"), "genus": F.col("genus"), "specificEpithet": F.col("specific_epithet"),
        "infraspecificEpithet": F.col("infra_epithet"), "taxonRank": F.col("taxon_rank"),
        "identificationQualifier": S.identification_qualifier("confidence", "is_placeholder"),
    }
    return flat.withColumn("_safe", safe).select(*[_text_of(c).alias(t) for t, c in terms.items()])


def absences(events: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Live events declared without detections that have no record: an absence each."""
    empty = S.live(events).filter("no_detections").join(
        S.live(occurrences).select("event_id"), "event_id", "left_anti"
    )
    return empty.select(
        F.concat(F.col("event_id").cast("string"), F.lit(":absent")).alias("occurrenceID"),
        F.col("event_id").cast("string").alias("eventID"), S.basis_of_record("method").alias("basisOfRecord"),
        F.lit("absent").alias("occurrenceStatus"), F.lit("0").alias("individualCount"),
        F.coalesce("recorded_by", F.lit("")).alias("recordedBy"),
        F.lit("Muestreo realizado sin detecciones de fauna.").alias("occurrenceRemarks"),
    )


def dwca_occurrence(flat: DataFrame, events: DataFrame | None, occurrences: DataFrame | None, *,
                    policy: str = "exacta") -> DataFrame:
    """Present rows and, when the events are given, absences; missing terms are empty."""
    present = dwca_present(flat, policy=policy)
    if events is None:
        return present
    return present.unionByName(absences(events, occurrences), allowMissingColumns=True).fillna("")


def dwca_measurement(flat: DataFrame, facts: DataFrame) -> DataFrame:
    """Flight attributes unpivoted, and the stored facts of live records, in long form."""
    def row(kind: str, value: Column, unit: str, how: str) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.struct(
            F.lit(kind).alias("measurementType"), value.alias("measurementValue"),
            F.lit(unit).alias("measurementUnit"), F.lit(how).alias("measurementMethod")))

    flight = F.array_compact(F.array(
        row("alturaDeVuelo", number_text(F.col("flight_height_m")), "m", "estimación visual"),
        row("categoriaAlturaDeVuelo", F.col("flight_height_category"), "", "categorías 1-5 de la planilla"),
        row("direccionDeVuelo", F.col("flight_direction"), "", ""),
        row("origenDeVuelo", F.col("flight_origin"), "", ""),
        row("destinoDeVuelo", F.col("flight_destination"), "", ""),
    ))
    flown = flat.select(F.col("dwc_occurrence_id").alias("occurrenceID"), F.explode(flight).alias("m")).select(
        "occurrenceID", "m.*")
    stored = facts.join(flat.select("occurrence_id", "dwc_occurrence_id"), "occurrence_id").select(
        F.col("dwc_occurrence_id").alias("occurrenceID"), F.col("measurement_type").alias("measurementType"),
        F.col("measurement_value").alias("measurementValue"),
        F.coalesce("measurement_unit", F.lit("")).alias("measurementUnit"),
        F.coalesce("measurement_method", F.lit("")).alias("measurementMethod"),
    )
    return flown.unionByName(stored)


# --- sheets -------------------------------------------------------------------------------

# What a sheet's row shows when there is an event but no record.
_NO_RECORD = {
    "record_type": "Otro", "evidence_kind": "Directo", "source": "manual", "sync_state": "pending",
    "occurrence_time": "", "dwc_occurrence_id": "", "created_by": "", "updated_by": "",
}


def _without_record(rows: DataFrame) -> DataFrame:
    extra = {c: F.lit(v) for c, v in _NO_RECORD.items()}
    extra["media_ids"] = F.array().cast("array<string>")
    extra["pending_fields"] = F.array().cast("array<string>")
    return rows.withColumns(extra)


def sheet_samplings(flat: DataFrame, events_dims: DataFrame) -> DataFrame:
    """One row per event: its first record, or the bare event when nothing was recorded.

    ``events_dims``: ``star.event_rows``. Project and campaign of a bare event are its own.
    """
    bare = events_dims.filter(F.col("event_deleted_at").isNull()).join(
        flat.select("event_id"), "event_id", "left_anti")
    return one_per_key(flat, "event_id").unionByName(_without_record(bare), allowMissingColumns=True)


def sheet_plan(flat: DataFrame, stations: DataFrame, events: DataFrame, events_dims: DataFrame) -> DataFrame:
    """One row per planned cell, done or not, and the live events outside the plan."""
    covered = C.plan_coverage(stations, events).select("station_id", "method", "event_id")
    outside = C.off_plan(stations, events).select("event_id")
    wanted = covered.filter(F.col("event_id").isNotNull()).select("event_id").unionByName(outside)
    with_event = sheet_samplings(flat, events_dims.join(wanted, "event_id", "left_semi")).join(
        wanted, "event_id", "left_semi")
    open_cells = covered.filter(F.col("event_id").isNull()).drop("event_id").join(
        stations.drop("sites").withColumn("has_station", F.lit(True)), "station_id")
    blank_event = open_cells.withColumns({"event_date": F.lit(""), "event_time": F.lit("")})
    return with_event.unionByName(_without_record(blank_event), allowMissingColumns=True)


def sheet_rows(scope: str, flat: DataFrame, *, stations: DataFrame | None = None, events: DataFrame | None = None,
               events_dims: DataFrame | None = None) -> DataFrame:
    """The flat rows that feed a sheet of the given scope."""
    by_method = {
        "registros": ~F.col("method").isin(V.OWN_SHEET_METHODS),
        "transito_aereo": F.col("method") == "transito_aereo",
        "transito_aereo_nocturno": F.col("method") == "transito_aereo_nocturno",
        "trampeo": F.col("method").isin(V.TRAP_METHODS),
    }
    if scope in by_method:
        return flat.filter(by_method[scope])
    if scope == "muestreos":
        return one_per_key(flat, "event_id") if events_dims is None else sheet_samplings(flat, events_dims)
    if scope == "plan":
        if stations is None:
            return sheet_rows("muestreos", flat, events_dims=events_dims)
        return sheet_plan(flat, stations, events, events_dims)
    if scope == "estaciones":
        return one_per_key(flat.filter("has_station"), "station_id")
    return flat


@dataclass(frozen=True)
class SheetColumn:
    header: str
    field_id: str | None = None
    constant: str | None = None


@dataclass(frozen=True)
class Sheet:
    name: str
    scope: str
    columns: list[SheetColumn]
    preamble: list[list[str]] = dc_field(default_factory=list)


def labelled(*field_ids: str) -> list[SheetColumn]:
    """Columns headed by their field's own label."""
    return [SheetColumn(FIELDS[i].label, i) for i in field_ids]


def build_sheet(sheet: Sheet, rows: DataFrame, *, now: str = "2030-01-01 00:00:00") -> DataFrame:
    """Rows of a sheet as text columns ``c1..cn`` (headers may repeat, column names may not)."""
    ready = effort_summary(rows, now=now)
    return ready.select(*[
        (F.lit(c.constant) if c.constant is not None else field(c.field_id) if c.field_id else F.lit("")).alias(f"c{i}")
        for i, c in enumerate(sheet.columns, start=1)
    ])


def fill_placeholders(preamble: list[list[str]], values: dict[str, str]) -> list[list[str]]:
    """Decorative rows with their ``{{marker}}`` replaced; unknown markers vanish."""
    import re

    return [[re.sub(r"\{\{(\w+)\}\}", lambda m: values.get(m[1], ""), cell or "") for cell in row] for row in preamble]


#: Header, field and constant of each column of the regulator's sheet, in its order.
REGULATOR_COLUMNS = Path(__file__).parents[1] / "functions" / "regulator_columns.csv"


def regulator_sheet(columns: Path = REGULATOR_COLUMNS, name: str = "Planilla") -> Sheet:
    """The regulator's sheet: all its columns; those no field fills stay empty."""
    lines = [line for line in columns.read_text(encoding="utf8").splitlines() if not line.startswith("#")]
    return sheet_from_table([(r["header"], r["field"] or None, r["constant"] or None) for r in csv.DictReader(lines)], name)


def sheet_from_table(rows: list[tuple[str, str | None, str | None]], name: str, scope: str = "registros_todos") -> Sheet:
    """A sheet out of a configuration table (header, field id, constant), such as a regulator's
    official column list read from a file."""
    return Sheet(name, scope, [SheetColumn(h, f or None, k) for h, f, k in rows])


_WHO = ["event.recordedBy", "event.team"]
_TAXONOMY = ["taxon.kingdom", "taxon.phylum", "taxon.class", "taxon.order", "taxon.family", "taxon.genus",
             "taxon.specificEpithet"]
_POSITION = ["occurrence.latitude", "occurrence.longitude", "occurrence.utmEast", "occurrence.utmNorth"]
_SPECIES = ["occurrence.commonName", "taxon.scientificName"]
_CREATED = ["trace.createdBy", "trace.createdAt"]

# The sheets of the native format and the order of their columns.
NATIVE_TEMPLATE = [
    Sheet("Registros", "registros", labelled(
        "event.date", "occurrence.time", "project.name", "campaign.name", "campaign.season", "station.code",
        "station.sector", "station.region", "station.habitat", "station.slope", "event.weather", "event.method", *_WHO,
        *_SPECIES, "occurrence.recordType", "occurrence.evidenceKind", "occurrence.count", "occurrence.sex",
        "occurrence.lifeStage", "occurrence.condition", "occurrence.behaviour", "occurrence.reproductiveCondition",
        "occurrence.confidence", "occurrence.detectionDistance", "occurrence.organismId", *_POSITION, *_TAXONOMY,
        "taxon.infraspecificEpithet", "conservation.category", "conservation.origin", "conservation.endemic",
        "conservation.source", "occurrence.photos", "occurrence.notes", "trace.occurrenceId", "trace.reviewState",
        "trace.syncState", "trace.source", "trace.utterance", "trace.pendingFields", *_CREATED)),
    Sheet("Plan", "plan", labelled(
        "station.code", "station.sector", "station.region", "event.method", "event.performed",
        "event.notPerformedReason", "event.date", *_WHO, "station.utmEast", "station.utmNorth", "event.noDetections",
        "effort.duration", "effort.distance")),
    Sheet("Trampeo", "trampeo", labelled(
        "event.date", "occurrence.time", "project.name", "campaign.season", "station.code", "station.region",
        "station.habitat", "event.method", "event.recordedBy", "occurrence.site", "occurrence.trapNumber", *_SPECIES,
        "occurrence.count", "occurrence.sex", "occurrence.lifeStage", "occurrence.condition", "occurrence.organismId",
        "occurrence.recapture", *_POSITION, *_TAXONOMY, "conservation.category", "conservation.origin",
        "conservation.endemic", "occurrence.photos", "occurrence.notes", "trace.occurrenceId", *_CREATED)),
    Sheet("MTAN", "transito_aereo_nocturno", labelled(
        "event.date", "occurrence.time", "event.timeBlock", "project.name", "campaign.season", "station.code",
        "station.sector", *_WHO, "event.weather", "station.slope", *_SPECIES, "taxon.class", "occurrence.count",
        "occurrence.recordType", "station.habitat", "aerial.heightMeters", "aerial.heightReference",
        "aerial.direction", "aerial.flightType", "aerial.origin", "aerial.destination", "occurrence.notes",
        "trace.occurrenceId", *_CREATED)),
    Sheet("Tránsito aéreo", "transito_aereo", labelled(
        "event.date", "occurrence.time", "project.name", "campaign.season", "station.code", "station.region",
        "event.recordedBy", "event.weather", *_SPECIES, "occurrence.count", "occurrence.sex", "occurrence.lifeStage",
        "aerial.origin", "aerial.destination", "aerial.direction", "aerial.heightCategory", "aerial.heightMeters",
        "occurrence.behaviour", *_TAXONOMY, "conservation.category", "occurrence.photos", "occurrence.notes",
        "trace.occurrenceId", *_CREATED)),
    Sheet("Muestreos", "muestreos", labelled(
        "event.id", "event.date", "project.name", "campaign.name", "station.code", "event.method", "event.recordedBy",
        "event.weather", "event.period", "event.temperature", "event.wind", "event.cloud", "event.precipitation",
        "effort.duration", "effort.distance", "effort.trapNights", "event.notes")),
    Sheet("Estaciones", "estaciones", labelled(
        "station.code", "station.finalCode", "project.name", "station.region", "campaign.season", "station.habitat",
        "station.slope", "station.utmEast", "station.utmNorth", "station.utmStartEast", "station.utmStartNorth",
        "station.utmEndEast", "station.utmEndNorth", "station.latitude", "station.longitude", "station.methodTransecto",
        "station.methodPlaybackAves", "station.methodPlaybackAnfibios", "station.methodCamara",
        "station.methodSherman", "event.recordedBy", "event.identifiedBy")),
]


# --- photographs --------------------------------------------------------------------------

def photo_index(flat: DataFrame, media: DataFrame) -> DataFrame:
    """Photographs with content, numbered from 1 in the order of their record's media list.

    ``media``: media_id, kind, has_content. The number of earlier photographs is counted inside
    the record's own list after one join, so no window over all photographs is needed.
    """
    usable = media.filter((F.col("kind") == "foto") & F.col("has_content")).select("media_id")
    listed = flat.select("occurrence_id", F.posexplode("media_ids").alias("pos", "media_id")).join(usable, "media_id")
    per_record = listed.groupBy("occurrence_id").agg(F.array_sort(F.collect_list(F.struct("pos", "media_id"))).alias("p"))
    numbered = per_record.select("occurrence_id", F.posexplode("p").alias("i", "m")).select(
        "occurrence_id", F.col("m.media_id").alias("media_id"), (F.col("i") + 1).alias("photo_index"))
    return flat.join(numbered, "occurrence_id").select(
        "occurrence_id", "media_id", "photo_index", photo_file_name().alias("file_name"))


