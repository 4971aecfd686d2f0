"""Survey rules that need only the columns of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions import vocab as V
from fieldtally.functions.text import blank, col, half_up, number_text  # noqa: F401


def lookup(c: Column | str, mapping: dict, default: Column | None = None) -> Column:
    """Literal map lookup kept inside the generated code."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    found = F.create_map(*pairs)[col(c)]
    return found if default is None else F.coalesce(found, default)


def live(df):
    """Rows that were not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull())


# --- time ---------------------------------------------------------------------------------

def hour_of(time: Column | str) -> Column:
    return F.substring(col(time), 1, 2).try_cast("int")


def infer_period(time: Column | str) -> Column:
    h = hour_of(time)
    return (
        F.when((h >= 21) | (h < 5), "Nocturno")
        .when((h < 8) | (h >= 19), "Crepuscular")
        .when(h.isNotNull(), "Diurno")
    )


def am_pm(time: Column | str) -> Column:
    # An empty text counts as hour zero.
    h = F.when(blank(time), F.lit(0)).otherwise(hour_of(time))
    return F.when(h.isNull(), "").when(h > 11, "PM").otherwise("AM")


def field_day(ts: Column | str, cut_hour: int = 4) -> Column:
    """A field day runs from the cut hour to the same hour of the next day."""
    return F.to_date(col(ts) - F.expr(f"INTERVAL {int(cut_hour)} HOURS"))


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(col(end).cast("date"), col(start).cast("date"))


def season_of(date: Column | str) -> Column:
    return lookup(F.month(col(date).cast("date")), V.SEASON_BY_MONTH, F.lit("Primavera"))


def readable_date(date: Column | str, current_year: Column) -> Column:
    """``3 de septiembre``; the year only when it is another one."""
    d = col(date).cast("date")
    text = F.concat(F.day(d).cast("string"), F.lit(" de "), F.element_at(F.array(*map(F.lit, V.MONTHS)), F.month(d)))
    return F.when(F.year(d) == current_year, text).otherwise(F.concat(text, F.lit(" de "), F.year(d).cast("string")))


def trap_nights_between(traps: Column | str, installed: Column | str, retrieved: Column | str) -> Column:
    return col(traps) * F.greatest(F.lit(0), days_between(installed, retrieved))


# --- records ------------------------------------------------------------------------------

def evidence_kind(record_type: Column | str) -> Column:
    return F.when(col(record_type).isin(V.INDIRECT_RECORD_TYPES), "Indirecto").otherwise("Directo")


def normalize_waypoint_label(raw: Column | str) -> Column:
    text = F.lower(F.trim(col(raw)))
    return (
        F.when(text.isin("inicio", "inicial", "partida", "comienzo", "cero", "0"), "inicio")
        .when(text.isin("final", "fin", "termino", "término", "llegada"), "final")
        .when(text.isin("medio", "intermedio", "mitad"), "medio")
        .otherwise(text)
    )


def cardinal_of(heading: Column | str) -> Column:
    """One of eight compass points for a heading in degrees, negative ones too."""
    h = F.pmod(col(heading).cast("double"), F.lit(360.0))
    index = (F.floor(h / 45 + 0.5) % 8).cast("int") + 1
    return F.when(
        col(heading).isNotNull() & ~F.isnan(col(heading).cast("double")),
        F.element_at(F.array(*map(F.lit, V.CARDINALS)), index),
    )


def record_types_for_method(
    method: Column | str, vocabulary: Column | None = None, current: Column | None = None
) -> Column:
    """Allowed record types in rule order, limited to the vocabulary; the current one always stays."""
    default = F.array(*map(F.lit, V.RECORD_TYPES))
    base = default if vocabulary is None else F.when(F.size(vocabulary) > 0, vocabulary).otherwise(default)
    rules = F.create_map(
        *[x for m, types in V.RECORD_TYPES_BY_METHOD.items() for x in (F.lit(m), F.array(*map(F.lit, types)))]
    )
    allowed = rules[col(method)]
    limited = F.filter(allowed, lambda t: F.array_contains(base, t))
    if current is not None:
        extra = F.when(~blank(current), F.array(current)).otherwise(F.array().cast("array<string>"))
        limited = F.array_union(limited, extra)
    return F.when(allowed.isNull(), base).otherwise(limited)


def impossible_record_type(method: Column | str, record_type: Column | str) -> Column:
    return ~F.array_contains(record_types_for_method(method), col(record_type))


def basis_of_record(method: Column | str) -> Column:
    return F.when(col(method).isin(V.MACHINE_METHODS), "MachineObservation").otherwise("HumanObservation")


def identification_qualifier(confidence: Column | str, placeholder: Column | str) -> Column:
    return (
        F.when(col(confidence) == "probable", "cf.")
        .when(col(confidence) == "posible", "?")
        .when(col(placeholder), "sp.")
        .otherwise("")
    )


def dwc_id(namespace: str, project_code: Column | str, kind: str, ident: Column | str) -> Column:
    """``urn:<namespace>:<project slug>:<kind>:<id>``; location codes are slugged too."""
    from fieldtally.functions.text import slug

    tail = slug(ident) if kind == "loc" else col(ident).cast("string")
    return F.concat(F.lit(f"urn:{namespace}:"), slug(project_code), F.lit(f":{kind}:"), tail)


# --- effort -------------------------------------------------------------------------------

def effort_unit(method: Column | str) -> Column:
    return (
        F.when(col(method).isin(V.DISTANCE_METHODS), "distancia")
        .when(col(method).isin(V.TRAP_METHODS), "trampas-noche")
        .when(col(method).isin(V.DURATION_METHODS), "duración")
        .otherwise("sin-esfuerzo")
    )


def format_duration(minutes: Column | str) -> Column:
    m = col(minutes)
    h = F.floor(m / 60).cast("string")
    rest = m % 60
    return (
        F.when(m < 60, F.concat(m.cast("string"), F.lit(" min")))
        .when(rest == 0, F.concat(h, F.lit(" h")))
        .otherwise(F.concat(h, F.lit(" h "), rest.cast("string"), F.lit(" min")))
    )


def format_distance(meters: Column | str) -> Column:
    m = col(meters)
    # Hundredths of a kilometre as whole numbers: exact, and no locale in the decimal mark.
    hundredths = half_up(m / 10).cast("bigint")
    km = F.concat(
        F.floor(hundredths / 100).cast("string"), F.lit(","),
        F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(" km"),
    )
    return F.when(m < 1000, F.concat(number_text(m), F.lit(" m"))).otherwise(km)


def effort_label(unit, measured, duration, distance, trap_nights) -> Column:
    nights = F.concat(
        number_text(trap_nights), F.lit(" trampa-noche"), F.when(trap_nights == 1, "").otherwise("s")
    )
    text = F.concat_ws(
        " · ",
        F.when(duration.isNotNull(), format_duration(duration)),
        F.when(distance.isNotNull() & (unit == "distancia"), format_distance(distance)),
        F.when(trap_nights.isNotNull() & (unit == "trampas-noche"), nights),
    )
    return F.when(text != "", text).when(measured, "esfuerzo incompleto").otherwise("sin medición de esfuerzo")


# --- conservation -------------------------------------------------------------------------

def category_of(rce: Column | str, iucn: Column | str) -> Column:
    return F.trim(F.upper(F.coalesce(col(rce), col(iucn), F.lit(""))))


def conservation_level(rce: Column | str, iucn: Column | str) -> Column:
    cat = category_of(rce, iucn)
    return (
        F.when(cat == "", "sin-clasificar")
        .when(cat.isin(V.THREATENED_CODES), "amenazada")
        .when(cat == "NT", "casi-amenazada")
        .otherwise("sin-riesgo")
    )


def is_threatened(rce: Column | str, iucn: Column | str) -> Column:
    return category_of(rce, iucn).isin(V.THREATENED_CODES)


def is_exotic(origin: Column | str) -> Column:
    text = F.lower(F.coalesce(col(origin), F.lit("")))
    return text.contains("exótic") | text.contains("exotic") | text.contains("asilvestrad")


def is_sensitive(rce, iucn, endemic) -> Column:
    level = conservation_level(rce, iucn)
    return (level == "amenazada") | (F.coalesce(col(endemic), F.lit(False)) & (level == "casi-amenazada"))


def conservation_badge(rce, iucn) -> Column:
    cat = category_of(rce, iucn)
    scheme = F.when(~blank(rce), " (RCE)").when(~blank(iucn), " (UICN)").otherwise("")
    return F.when(cat != "", F.concat(cat, F.lit(" · "), lookup(cat, V.THREAT_LABELS, cat), scheme))


def conservation_detail(rce, iucn, decree, source) -> Column:
    cat = category_of(rce, iucn)
    return F.when(
        cat != "",
        F.concat(
            lookup(cat, V.THREAT_LABELS, cat),
            F.when(~blank(decree), F.concat(F.lit(", "), col(decree))).otherwise(""),
            F.when(~blank(source), F.concat(F.lit(" · fuente: "), col(source))).otherwise(""),
        ),
    )


def conservation_flag(rce="rce", iucn="iucn", endemic="endemic", origin="origin",
                      migratory="migratory", legal="legal_protection", decree="rce_decree",
                      source="conservation_source") -> Column:
    """struct(level, badge, detail, traits, sensitive_location)."""
    return F.struct(
        conservation_level(rce, iucn).alias("level"),
        conservation_badge(rce, iucn).alias("badge"),
        conservation_detail(rce, iucn, decree, source).alias("detail"),
        F.array_compact(
            F.array(
                F.when(col(endemic), "Endémica"),
                F.when(~blank(origin), col(origin)),
                F.when(col(migratory), "Migratoria"),
                F.when(~blank(legal), col(legal)),
            )
        ).alias("traits"),
        is_sensitive(rce, iucn, endemic).alias("sensitive_location"),
    )


def mobility_of(group: Column | str, order: Column | str) -> Column:
    g = col(group)
    return (
        F.when(g.isin("reptiles", "anfibios"), "baja")
        .when(g == "aves", "alta")
        .when((g == "mamiferos") & col(order).isin(V.LOW_MOBILITY_ORDERS), "baja")
        .when(g == "mamiferos", "alta")
        .otherwise("desconocida")
    )


def location_fix_reason(rce, iucn, group, order, record_type) -> Column:
    """Why the record needs its own coordinate; null when it does not."""
    return (
        F.when(is_threatened(rce, iucn), "especie en categoría de conservación")
        .when(
            col(record_type).isin(V.FIXED_EVIDENCE),
            F.concat(F.lower(col(record_type)), F.lit(": la evidencia queda en un punto fijo")),
        )
        .when(mobility_of(group, order) == "baja", "especie de baja movilidad")
    )


def location_fix_need(rce, iucn, group, order, record_type) -> Column:
    reason = location_fix_reason(rce, iucn, group, order, record_type)
    return F.struct(reason.isNotNull().alias("required"), reason.alias("reason"))


def suggests_photo(rce, iucn, record_type, confidence) -> Column:
    doubtful = ~blank(confidence) & (col(confidence) != "seguro")
    return is_threatened(rce, iucn) | doubtful | F.coalesce(col(record_type).isin(V.FIXED_EVIDENCE), F.lit(False))
