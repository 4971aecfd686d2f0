"""Reading strangers' spreadsheets out of a long table of cells.

``cells``: file, sheet, row_no (from 1), col_no, value, and optionally value_type (n, d, b, s: number, date,
truth value, text), as ``read_cells`` gives them. Row and column counts of a single sheet
are never collected; only header rows, whose width a sheet bounds, become arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.headers import CORE_FIELDS, NUMERIC_FIELDS, match_headers
from fieldtally.functions.text import clean_cell, excel_date, excel_time, fold, parse_number
from fieldtally.session import written

SHEET = ["file", "sheet"]
NUMERIC_TEXT = r"^-?\d+([.,]\d+)?$"


# --- finding the header -------------------------------------------------------------------

def detect_header_row(cells: DataFrame, variant: str = "template") -> DataFrame:
    """Header row of each sheet: (file, sheet, header_row).

    template: of the first 25 rows with three cells, most distinct texts that are no numbers (at
    least 3). import: of the first 20 rows, most filled cells (at least 5). Ties: the first.
    """
    if variant == "template":
        top = cells.filter(F.col("row_no") <= 25).withColumn("v", clean_cell("value", "template")).filter(F.col("v").isNotNull())
        textual = F.when(~F.col("v").rlike(NUMERIC_TEXT), fold("v"))
        rows = top.groupBy(*SHEET, "row_no").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(textual).alias("score")
        ).filter(F.col("n") >= 3)
        least = 3
    else:
        top = cells.filter(F.col("row_no") <= 20).withColumn("v", clean_cell("value", "import")).filter(F.col("v").isNotNull())
        rows = top.groupBy(*SHEET, "row_no").agg(F.count(F.lit(1)).alias("score")).filter(F.col("score") >= 5)
        least = 5
    best = rows.groupBy(*SHEET).agg(
        F.max_by(F.struct("row_no", "score"), F.struct(F.col("score"), -F.col("row_no"))).alias("b"))
    return best.filter(F.col("b.score") >= least).select(*SHEET, F.col("b.row_no").alias("header_row"))


def header_candidates(cells: DataFrame, *, rows: int = 25, keep: int = 12, preview: int = 6) -> DataFrame:
    """First non-empty rows of each sheet with a short preview, to choose the header by hand."""
    top = cells.filter(F.col("row_no") <= rows).withColumn("v", clean_cell("value", "template")).filter(F.col("v").isNotNull())
    lines = top.groupBy(*SHEET, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "v"))).alias("c"))
    text = F.array_join(F.slice(F.col("c.v"), 1, preview), " · ")
    order = Window.partitionBy(*SHEET).orderBy("row_no")
    return lines.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep).select(
        *SHEET, "row_no",
        F.when(F.length(text) > 90, F.concat(F.substring(text, 1, 90), F.lit("…"))).otherwise(text).alias("preview"),
    )


def sheet_headers(cells: DataFrame, header_rows: DataFrame, reader: str = "template") -> DataFrame:
    """Header text of every column in the header row, detected or chosen (file, sheet, col_no, header, header_row)."""
    at = header_rows.select(*SHEET, "header_row", F.col("header_row").alias("row_no"))
    # Written before they are cleaned: a filter on the clean text would go ahead of the join, to every cell.
    found = written(cells.join(at, [*SHEET, "row_no"]).select(*SHEET, "header_row", "col_no", "value"), "header-cells")
    return found.select(*SHEET, "header_row", "col_no", clean_cell("value", reader).alias("header")).filter(F.col("header").isNotNull())


def _body(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    return cells.join(header_rows, SHEET).filter(F.col("row_no") > F.col("header_row"))


# --- columns ------------------------------------------------------------------------------

def column_samples(cells: DataFrame, header_rows: DataFrame, *, keep: int = 3, width: int = 40) -> DataFrame:
    """Up to three distinct values of each column in reading order, long ones cut."""
    body = _body(cells, header_rows).withColumn("v", clean_cell("value", "template")).filter(F.col("v").isNotNull())
    first = body.groupBy(*SHEET, "col_no", "v").agg(F.min("row_no").alias("row_no"))
    order = Window.partitionBy(*SHEET, "col_no").orderBy("row_no", "v")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep).select(
        *SHEET, "col_no", "rank",
        F.when(F.length("v") > width, F.concat(F.substring("v", 1, width), F.lit("…"))).otherwise(F.col("v")).alias("sample"),
    )


def numeric_columns(cells: DataFrame, header_rows: DataFrame, *, look: int = 30) -> DataFrame:
    """Columns whose first values (at most 30, at least 3) are numbers in 80 % of cases."""
    body = _body(cells, header_rows).withColumn("v", clean_cell("value", "template")).filter(F.col("v").isNotNull())
    order = Window.partitionBy(*SHEET, "col_no").orderBy("row_no")
    seen = body.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= look)
    return seen.groupBy(*SHEET, "col_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").rlike(NUMERIC_TEXT)).alias("numbers")
    ).filter((F.col("n") >= 3) & (F.col("numbers") >= 0.8 * F.col("n"))).select(*SHEET, "col_no", F.lit(True).alias("numeric"))


def detect_columns(cells: DataFrame, header_rows: DataFrame, extra: list[tuple[str, str]] = (), headers: DataFrame | None = None) -> DataFrame:
    """Each column with its field, or why it may stay empty (``omitted``), and its first values.

    ``headers`` (as ``sheet_headers`` gives them) spares a scan where they are known; the cells are then
    scanned twice, for the first values and for the first different ones.
    """
    headers = sheet_headers(cells, header_rows) if headers is None else headers
    matches = match_headers(headers, extra)
    samples = column_samples(cells, header_rows).groupBy(*SHEET, "col_no").agg(
        F.count_if(F.col("sample").rlike(r"^\d+$")).alias("whole_numbers"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample"))), lambda s: s["sample"]).alias("samples"))
    rows = (
        headers.join(matches, "header", "left")
        .join(numeric_columns(cells, header_rows), SHEET + ["col_no"], "left")
        .join(samples, SHEET + ["col_no"], "left")
    )
    dropped = F.coalesce("numeric", F.lit(False)) & ~F.col("field_id").isin(NUMERIC_FIELDS)
    field = F.when(~dropped, F.col("field_id"))
    filled_by_sheet = F.col("header").rlike(r"(?i)no\s*llenar|no\s*modificar|autocomplet|no\s*editar")
    counter = fold("header").rlike(r"^(n|no|num|numero|item|itm|correlativo|id n)$") & (F.col("whole_numbers") >= 2)
    return rows.select(
        *SHEET, "header_row", "col_no", "header", field.alias("field_id"),
        F.when(field.isNotNull(), F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(field.isNull() & filled_by_sheet, "autocompletada").when(field.isNull() & counter, "correlativo").alias("omitted"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )


# --- sheets -------------------------------------------------------------------------------

def _has(*ids: str) -> Column:
    out = F.lit(False)
    for i in ids:
        out = out | F.array_contains("fields", i)
    return out


def _starts(prefix: str) -> Column:
    return F.exists("fields", lambda f: f.startswith(prefix))


def sheet_fields(columns: DataFrame) -> DataFrame:
    """The set of recognised fields per sheet (at most one entry per known field)."""
    return columns.groupBy(*SHEET).agg(
        F.collect_set("field_id").alias("fields"),
        F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("field_id").isNull()).alias("n_unmapped"))


def classify_sheet() -> Column:
    """Role of a sheet from its ``fields``."""
    records = _has("occurrence.count", "station.code", "occurrence.recordType")
    return (
        F.when(_has("aerial.heightMeters", "aerial.origin", "aerial.direction"), "registros_ta")
        .when(_has("occurrence.commonName", "taxon.scientificName") & records, "registros")
        .when(_has("occurrence.commonName", "taxon.scientificName"), "catalogo_especies")
        .when(_starts("station."), "estaciones")
        .otherwise("desconocida")
    )


def guess_scope() -> Column:
    """Scope of an export sheet from its ``fields``."""
    return (
        F.when(_has("aerial.heightReference", "aerial.flightType", "event.timeBlock"), "transito_aereo_nocturno")
        .when(_has("aerial.heightMeters", "aerial.origin", "aerial.direction"), "transito_aereo")
        .when(_has("event.performed", "event.notPerformedReason"), "plan")
        .when(_starts("occurrence.") | _has("taxon.scientificName"), "registros")
        .when(_starts("effort."), "muestreos")
        .when(_starts("station."), "estaciones")
        .otherwise("registros")
    )


def detect_sheets(columns: DataFrame) -> DataFrame:
    """Scope of each sheet and whether it is to be ignored (a guide or list, or hardly recognised)."""
    side_sheet = fold("sheet").rlike("^(instrucciones|leer|guia|ayuda|portada|indice|validacion|listas|catalogo|nombres)")
    return sheet_fields(columns).select(
        *SHEET, "fields", "n_columns", "n_unmapped", guess_scope().alias("scope"),
        (side_sheet | (F.col("n_columns") - F.col("n_unmapped") < 2)).alias("ignored"))


def template_gaps(sheets: DataFrame) -> DataFrame:
    """Per file: total and unmapped columns, and the core fields that have no column at all."""
    used = sheets.filter(~F.col("ignored"))
    return used.groupBy("file").agg(
        F.sum("n_columns").alias("total_columns"), F.sum("n_unmapped").alias("unmapped"),
        F.array_distinct(F.flatten(F.collect_set("fields"))).alias("fields"),
    ).select("file", "total_columns", "unmapped",
             F.array_except(F.array(*[F.lit(f) for f in CORE_FIELDS]), F.col("fields")).alias("missing"))


def template_from_detection(columns: DataFrame, sheets: DataFrame, preamble: DataFrame | None = None) -> DataFrame:
    """Used sheets as template rows: ordered array of (col_no, header, field_id) per sheet, and the rows above the header if given."""
    kept = sheets.filter(~F.col("ignored")).select(*SHEET, "scope")
    template = columns.join(kept, SHEET).groupBy(*SHEET, "scope").agg(
        F.array_sort(F.collect_list(F.struct("col_no", "header", "field_id"))).alias("columns"))
    if preamble is None:
        return template
    above = preamble.groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda r: r["cells"]).alias("preamble"))
    return template.join(above, SHEET, "left")


def preamble_rows(cells: DataFrame, header_rows: DataFrame) -> DataFrame:
    """The decorative rows above the header (file, sheet, row_no, cells), kept so that an export looks like the original.

    Every row above the header comes, blank ones with no cells; a row ends at its last cell with text, and
    cells without text before it are null.
    """
    rows = header_rows.filter(F.col("header_row") > 1).select(*SHEET, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("header_row").cast("bigint") - 1)).alias("row_no"))
    texts = cells.select(*SHEET, "row_no", "col_no", clean_cell("value", "template").alias("value")).filter(F.col("value").isNotNull())
    joined = rows.join(texts, [*SHEET, "row_no"], "left").groupBy(*SHEET, "row_no").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("col_no").isNotNull(), F.struct("col_no", "value")))).alias("by_col"), F.max("col_no").alias("last"))
    whole = F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda i: F.element_at("by_col", i))
    return joined.select(*SHEET, "row_no", F.when(F.col("last").isNotNull(), whole).otherwise(F.array().cast("array<string>")).alias("cells"))


# --- the whole detection ------------------------------------------------------------------

@dataclass(frozen=True)
class Detection:
    """What ``detect_template`` found, as small written tables."""

    sheets: DataFrame     # file, sheet, header_row, fields, n_columns, n_unmapped, scope, ignored
    columns: DataFrame    # as ``detect_columns``
    preamble: DataFrame   # as ``preamble_rows``
    candidates: DataFrame  # as ``header_candidates``


def detect_template(cells: DataFrame, overrides: DataFrame | None = None, extra: list[tuple[str, str]] = (), *, top: int = 25) -> Detection:
    """Sheets, columns and preambles of foreign workbooks, with a person's corrections.

    ``overrides``: file, sheet, header_row, scope, use; a null leaves what was found. A header row that was chosen
    is read as if it had been found, so columns, samples and preamble follow it. ``use`` says that a sheet counts,
    or doesn't, whatever it looks like. The cells are scanned three times: their first rows are written as a table
    that header, candidates and preamble come from, then ``detect_columns`` reads the bodies. A sheet without a
    header row has no columns and is ignored unless ``use`` says otherwise; one without a cell in its first rows
    isn't listed.
    """
    if overrides is None:
        overrides = cells.select(*SHEET).limit(0).select(*SHEET, *[F.lit(None).cast(t).alias(c) for c, t in (("header_row", "bigint"), ("scope", "string"), ("use", "boolean"))])
        tops = cells.filter(F.col("row_no") <= top)
    else:
        deep = overrides.select(*SHEET, F.col("header_row").alias("chosen_row"))
        tops = cells.join(deep, SHEET, "left").filter(F.col("row_no") <= F.greatest(F.lit(top), F.coalesce("chosen_row", F.lit(0)))).drop("chosen_row")
    tops = written(tops, "sheet-tops")
    found = detect_header_row(tops)
    wished = overrides.select(*SHEET, F.col("header_row").alias("chosen_row"), F.col("scope").alias("chosen_scope"), "use")
    rows = tops.select(*SHEET).distinct().join(found, SHEET, "left").join(wished, SHEET, "left")
    rows = written(rows.select(*SHEET, F.coalesce("chosen_row", "header_row").alias("header_row"), "chosen_scope", "use"), "sheet-rows")
    header_rows = rows.filter(F.col("header_row").isNotNull()).select(*SHEET, "header_row")
    headers = written(sheet_headers(tops, header_rows), "sheet-headers")
    columns = written(detect_columns(cells, header_rows, extra, headers), "sheet-columns")
    known = detect_sheets(columns)
    sheets = rows.join(known, SHEET, "left").select(
        *SHEET, "header_row", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), F.coalesce("n_columns", F.lit(0)).alias("n_columns"),
        F.coalesce("n_unmapped", F.lit(0)).alias("n_unmapped"), F.coalesce("chosen_scope", "scope", F.lit("registros")).alias("scope"),
        F.coalesce(~F.col("use"), "ignored", F.lit(True)).alias("ignored"))
    return Detection(written(sheets, "sheets"), columns, preamble_rows(tops, header_rows), header_candidates(tops, rows=top))


# --- records ------------------------------------------------------------------------------

def field_columns(cells: DataFrame, header_rows: DataFrame, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """First column of each field recognised with confidence .7 or more."""
    headers = sheet_headers(cells, header_rows, "import")
    return sure_columns(headers.join(match_headers(headers, extra), "header"))


def sure_columns(matched: DataFrame) -> DataFrame:
    """``field_columns`` of headers that have met their fields."""
    return matched.filter(F.col("field_id").isNotNull() & (F.col("confidence") >= 0.7)).groupBy(*SHEET, "header_row", "field_id").agg(F.min("col_no").alias("col_no"))


def import_sheets(cells: DataFrame, header_rows: DataFrame, extra: list[tuple[str, str]] = ()) -> DataFrame:
    headers = sheet_headers(cells, header_rows, "import")
    columns = headers.join(match_headers(headers, extra), "header", "left")
    return sheet_fields(columns).select(*SHEET, classify_sheet().alias("role"))


def _rows_by_field(cells: DataFrame, header_rows: DataFrame, roles: list[str], fields: dict[str, str],
                   extra: list[tuple[str, str]]) -> DataFrame:
    """One row per spreadsheet row with the wanted fields as columns (null when absent).

    The table of wanted columns has a handful of rows per sheet: it is written once, after which
    the cells are scanned a single time.
    """
    headers = sheet_headers(cells, written(header_rows, "header-rows"), "import")
    matched = written(headers.join(match_headers(headers, extra), "header", "left"), "import-headers")
    sheets = sheet_fields(matched).select(*SHEET, classify_sheet().alias("role")).filter(F.col("role").isin(roles))
    wanted = written(sure_columns(matched).filter(F.col("field_id").isin(list(fields))).join(sheets, SHEET), "import-columns")
    values = cells.join(wanted, SHEET + ["col_no"]).filter(F.col("row_no") > F.col("header_row"))
    typed = [F.max(F.when(F.col("field_id") == f, F.col("value_type") == "n")).alias(f"{name} is number")
             for f, name in fields.items() if name in ("_date", "_time") and "value_type" in cells.columns]
    # Texts are aggregated by sort: the row number, in which most rows differ, is compared first.
    return values.groupBy("row_no", *SHEET, "role").agg(*[
        F.max(F.when(F.col("field_id") == f, F.col("value"))).alias(name) for f, name in fields.items()
    ], *typed)


RECORD_FIELDS = {
    "occurrence.commonName": "common_name", "event.date": "_date", "occurrence.time": "_time", "station.code": "station_code",
    "event.method": "method", "occurrence.recordType": "record_type", "occurrence.count": "_count", "occurrence.sex": "sex",
    "occurrence.lifeStage": "life_stage", "occurrence.condition": "organism_condition", "occurrence.behaviour": "behaviour",
    "event.weather": "weather", "occurrence.notes": "notes", "event.recordedBy": "recorded_by", "event.team": "team",
    "occurrence.reproductiveCondition": "reproductive_condition", "aerial.origin": "flight_origin",
    "aerial.destination": "flight_destination", "aerial.heightCategory": "flight_height_category", "aerial.heightMeters": "_height",
}
_CONVERTED = ("_date", "_time", "_count", "_height")


def _counted_keys(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count_distinct("taxon_id").alias("hits"), F.min("taxon_id").alias("taxon_id"))


def resolve_taxa(names: DataFrame, keys: DataFrame, column: str = "common_name") -> DataFrame:
    """Catalogue hits of each distinct name: (name, hits, taxon_id when there is exactly one).

    ``keys``: key, taxon_id (the exploded search keys). Keys are deduplicated and counted before
    the join, so a name shared by many taxa adds one row.
    """
    counted = _counted_keys(keys)
    distinct = names.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("key", fold(column))
    return distinct.join(counted, "key", "left").select(
        column, F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("taxon_id")).alias("taxon_id"))


def import_records(cells: DataFrame, header_rows: DataFrame, keys: DataFrame, *, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Historical rows of record sheets, cleaned and with their species; unnamed rows are skipped."""
    raw = _rows_by_field(cells, header_rows, ["registros", "registros_ta"], RECORD_FIELDS, extra)
    plain = {n: clean_cell(n) for n in RECORD_FIELDS.values() if n not in _CONVERTED}
    flight = F.col("role") == "registros_ta"
    number = {c: F.coalesce(F.col(f"{c} is number"), F.lit(False)) if f"{c} is number" in raw.columns else None for c in ("_date", "_time")}
    rows = raw.withColumns(plain).filter(F.col("common_name").isNotNull()).withColumns(
        {
            "event_date": excel_date("_date", number["_date"]), "event_time": excel_time("_time", number["_time"]), "individual_count": parse_number("_count"),
            "flight_height_m": F.when(flight, parse_number("_height")),
            "method": F.coalesce("method", F.when(flight, "Tránsito aéreo")),
            "stated_record_type": F.col("record_type"),
            "record_type": F.coalesce("record_type", F.when(flight, "Individuo")),
            **{c: F.when(flight, F.col(c)) for c in ("flight_origin", "flight_destination", "flight_height_category")},
        }
    ).drop(*_CONVERTED, *[f"{c} is number" for c in number])
    return rows.withColumn("key", fold("common_name")).join(_counted_keys(keys), "key", "left").drop("key").withColumns(
        {"hits": F.coalesce("hits", F.lit(0)), "taxon_id": F.when(F.col("hits") == 1, F.col("taxon_id"))})


#: What ``import_issues`` reads of a record.
ISSUE_COLUMNS = [*SHEET, "row_no", "common_name", "hits", "event_date", "station_code", "stated_record_type"]


def import_issues(records: DataFrame, record_types: list[str]) -> DataFrame:
    """Problems of imported rows in long form: file, sheet, row_no, column, severity, message."""
    known = F.array(*[fold(F.lit(t)) for t in record_types])  # folded once, as a constant of the plan
    unlisted = F.col("stated_record_type").isNotNull() & ~F.array_contains(known, fold("stated_record_type"))
    name = F.col("common_name")

    def issue(when: Column, column: str, severity: str, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(column).alias("column"), F.lit(severity).alias("severity"), message.alias("message")))

    found = F.array_compact(F.array(
        issue(F.col("hits") > 1, "Nombre común", "warning", F.concat(
            F.lit('"'), name, F.lit('" corresponde a '), F.col("hits").cast("string"),
            F.lit(" especies del catálogo; requiere elegir una."))),
        issue(F.col("hits") == 0, "Nombre común", "error", F.concat(
            F.lit('"'), name, F.lit('" no existe en el catálogo de especies (en la planilla producía #N/A).'))),
        issue(F.col("event_date").isNull(), "Fecha", "error", F.lit("Fecha ausente o ilegible.")),
        issue(F.col("station_code").isNull(), "ID Estación", "error", F.lit("Sin estación asociada.")),
        issue(unlisted, "Registro", "warning", F.concat(
            F.lit('Tipo de registro "'), F.col("stated_record_type"), F.lit('" fuera de la lista de validación.'))),
    ))
    return records.select(*SHEET, "row_no", F.explode(found).alias("i")).select(*SHEET, "row_no", "i.*")


def import_verdict(records: DataFrame, issues: DataFrame) -> DataFrame:
    """A file can be imported when it has a record and no error."""
    errors = issues.filter(F.col("severity") == "error").groupBy("file").agg(F.count(F.lit(1)).alias("errors"))
    counts = records.groupBy("file").agg(F.count(F.lit(1)).alias("records"))
    return counts.join(errors, "file", "left").select(
        "file", "records", F.coalesce("errors", F.lit(0)).alias("errors"), F.col("errors").isNull().alias("can_import"))


STATION_FIELDS = {
    "station.code": "station_code", "station.finalCode": "final_code", "project.name": "project", "station.region": "region",
    "campaign.season": "season", "station.habitat": "habitat", "station.slope": "slope_aspect", "station.sector": "sector",
    "station.utmEast": "_east", "station.utmNorth": "_north",
}


def import_stations(cells: DataFrame, header_rows: DataFrame, *, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Rows of station sheets; the final code defaults to the code."""
    raw = _rows_by_field(cells, header_rows, ["estaciones"], STATION_FIELDS, extra)
    plain = {n: clean_cell(n) for n in STATION_FIELDS.values() if not n.startswith("_")}
    return raw.withColumns(plain).filter(F.col("station_code").isNotNull()).select(
        *SHEET, "row_no", "station_code", F.coalesce("final_code", "station_code").alias("final_code"), "project", "region",
        "season", "habitat", "slope_aspect", "sector",
        parse_number("_east").alias("utm_east"), parse_number("_north").alias("utm_north"))


# --- species lists ------------------------------------------------------------------------

CATALOG_FIELDS = {
    "occurrence.commonName": "common_name", "taxon.scientificName": "scientific_name", "taxon.kingdom": "kingdom",
    "taxon.phylum": "phylum", "taxon.class": "class", "taxon.classLatin": "class", "taxon.order": "order",
    "taxon.family": "family", "taxon.genus": "genus", "taxon.specificEpithet": "specific_epithet",
    "taxon.infraspecificEpithet": "infra_epithet",
}


def catalog_field() -> Column:
    """Catalogue field of a matched header: in a species list "tipo" and "division" are the phylum."""
    from fieldtally.functions.survey import lookup

    return F.when(fold("header").rlike(r"^(tipo|filo|division)\b"), "phylum").otherwise(lookup("field_id", CATALOG_FIELDS))


def detect_species_sheet(cells: DataFrame, *, sheet: str | None = None, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """The species list of each file: header row and number of named rows.

    A header has three catalogue columns, one of them a name, among the first 12 rows with
    content; the sheet with most named rows wins, ties go to the first sheet name.
    """
    rows = cells if sheet is None else cells.filter(F.col("sheet") == sheet)
    filled = rows.withColumn("header", F.trim("value")).filter(F.coalesce(F.col("header"), F.lit("")) != "")
    content = filled.select(*SHEET, "row_no").distinct()
    order = Window.partitionBy(*SHEET).orderBy("row_no")
    top = content.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= 12).drop("rn")
    heads = filled.join(top, SHEET + ["row_no"])
    named = heads.join(match_headers(heads, extra), "header", "left").withColumn("catalog", catalog_field())
    is_name = F.col("catalog").isin("common_name", "scientific_name")
    first = named.groupBy(*SHEET, "row_no").agg(
        F.count_distinct("catalog").alias("n"), F.count_if(is_name).alias("names"),
        F.min(F.when(F.col("catalog") == "common_name", F.col("col_no"))).alias("common_col"),
        F.min(F.when(F.col("catalog") == "scientific_name", F.col("col_no"))).alias("scientific_col"),
    ).filter((F.col("n") >= 3) & (F.col("names") > 0)).groupBy(*SHEET).agg(
        F.min_by(F.struct("row_no", "common_col", "scientific_col"), "row_no").alias("h"))
    at_name = (F.col("col_no") == F.col("h.common_col")) | (F.col("col_no") == F.col("h.scientific_col"))
    counted = (
        filled.join(first, SHEET).filter((F.col("row_no") > F.col("h.row_no")) & at_name & clean_cell("value", "catalog").isNotNull())
        .select(*SHEET, "row_no", F.col("h.row_no").alias("header_row")).distinct()
        .groupBy(*SHEET, "header_row").agg(F.count(F.lit(1)).alias("named_rows"))
    )
    return counted.groupBy("file").agg(
        F.min_by(F.struct("sheet", "header_row", "named_rows"), F.struct((-F.col("named_rows")).alias("r"), F.col("sheet"))).alias("b")
    ).select("file", "b.*")


# --- national red list --------------------------------------------------------------------

RED_LIST_HEADERS = {
    "scientific_name": "nombre cientifico", "common_name": "nombre comun", "category": "categoria vigente",
    "source": "fuente de categoria vigente", "process": "numero proceso rce", "decree": "referencia o decreto",
    "endemic": "endemica", "class": "clase", "order": "orden", "family": "familia",
}


def red_list_rows(cells: DataFrame) -> DataFrame:
    """Rows of a red-list sheet: columns found by the beginning of the folded header in row 1."""
    heads = cells.filter(F.col("row_no") == 1).withColumn("h", fold("value"))
    columns = None
    for name, prefix in RED_LIST_HEADERS.items():
        part = heads.filter(F.col("h").startswith(prefix)).groupBy(*SHEET).agg(F.min("col_no").alias("col_no")).withColumn("name", F.lit(name))
        columns = part if columns is None else columns.unionByName(part)
    values = cells.filter(F.col("row_no") > 1).join(columns, SHEET + ["col_no"])
    text = F.nullif(F.trim(F.col("value")), F.lit(""))
    return values.groupBy(*SHEET, "row_no").agg(*[
        F.max(F.when(F.col("name") == n, text)).alias(n) for n in RED_LIST_HEADERS])


def read_nomina(rows: DataFrame) -> dict[str, DataFrame]:
    """One row per species: the highest process number, ties to the later row; losers reported.

    ``rows``: row_no and the columns of RED_LIST_HEADERS. The category stays as written; ``code``
    is set only when it is one of the simple codes.
    """
    from fieldtally.functions import vocab as V

    process = F.regexp_replace(F.col("process").cast("string"), r"[^\d]", "").try_cast("bigint")
    yes_no = fold(F.coalesce(F.col("endemic").cast("string"), F.lit("")))
    simple = F.upper("category").isin(V.RED_LIST_CODES)
    species = rows.filter(F.col("scientific_name").isNotNull()).select(
        fold("scientific_name").alias("name_key"), "row_no", "scientific_name", "common_name", "category", "source", "decree",
        F.when(simple, F.upper("category")).alias("code"),
        (F.col("category").isNotNull() & ~simple).alias("composite"),
        F.coalesce(F.col("category").rlike("(?i)no v[aá]lid"), F.lit(False)).alias("synonym"),
        F.when(process > 0, process).alias("process"),
        F.when(yes_no.isin("si", "s"), True).when(yes_no.isin("no", "n"), False).alias("endemic"),
    )
    payload = F.struct(*[F.col(c) for c in species.columns if c != "name_key"])
    rank = F.struct(F.coalesce("process", F.lit(0)).alias("p"), F.col("row_no"))
    winners = species.groupBy("name_key").agg(F.max_by(payload, rank).alias("w"), F.count(F.lit(1)).alias("n"))
    current = winners.select("name_key", "w.*")
    losers = species.join(winners.filter(F.col("n") > 1).select("name_key", "w"), "name_key").filter(
        F.col("row_no") != F.col("w.row_no"))
    label = lambda cat, proc: F.concat(
        F.coalesce(cat, F.lit("—")), F.lit(" (proceso "), F.coalesce(proc.cast("string"), F.lit("?")), F.lit(")"))
    resolved = losers.select(
        "scientific_name", label(F.col("category"), F.col("process")).alias("discarded"),
        label(F.col("w.category"), F.col("w.process")).alias("kept"))
    return {"species": current, "resolved": resolved}


def nomina_summary(species: DataFrame) -> DataFrame:
    from fieldtally.functions import vocab as V

    return species.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("category").isNotNull()).alias("with_category"),
        F.count_if(F.col("composite") & ~F.col("synonym")).alias("composite"),
        F.count_if("synonym").alias("synonyms"),
        F.count_if(F.col("code").isin(V.RED_LIST_THREATENED)).alias("threatened"))
