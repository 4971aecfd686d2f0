"""Checks on draft observations: required fields, questions and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import survey as S
from fieldtally.functions import vocab as V
from fieldtally.functions.profiles import FALLBACK, STANDARD_ID
from fieldtally.functions.text import blank
from fieldtally.operators.spatial import station_drift
from fieldtally.operators.star import seen_taxa
from fieldtally.session import written

CONTEXT = ["method", "tax_group", "record_type", "threatened"]


def resolve_requirements(contexts: DataFrame, config: DataFrame, *, profile: str = STANDARD_ID) -> DataFrame:
    """Effective requirement of every field for each distinct context.

    Base, then group, then method, then record type (which cannot reopen what the method hid),
    then a threatened taxon raises it unless hidden. Contexts are combinations of controlled
    values, so this table is small whatever the number of drafts.
    """
    rules = config.filter(F.col("profile") == profile)

    def level(name: str, column: str | None) -> DataFrame:
        rows = rules.filter(F.col("level") == name)
        picked = rows.select("field", F.col("requirement").alias(f"_{name}"), F.col("level_value"))
        return picked.drop("level_value") if column is None else picked.withColumnRenamed("level_value", column)

    fields = F.explode(F.array(*[F.lit(f) for f in V.FIELD_LABELS]))
    grid = contexts.select(*CONTEXT).distinct().withColumn("field", fields)
    grid = grid.join(level("base", None), "field", "left")
    for name, column in (("group", "tax_group"), ("method", "method"), ("record_type", "record_type")):
        grid = grid.join(level(name, column), [column, "field"], "left")
    grid = grid.join(level("threatened", None), "field", "left")

    closed = F.coalesce(F.col("_method") == "hidden", F.lit(False))
    before = F.coalesce("_group", "_base", F.lit(FALLBACK))
    with_method = F.coalesce(F.col("_method"), before)
    value = F.when(~closed & F.col("_record_type").isNotNull(), F.col("_record_type")).otherwise(with_method)
    rank = lambda c: S.lookup(c, V.REQUIREMENT_RANK)
    raised = (
        F.col("threatened") & (F.col("_value") != "hidden") & F.col("_threatened").isNotNull()
        & (rank("_threatened") > rank("_value"))
    )
    return grid.withColumn("_value", value).select(
        *CONTEXT, "field", F.when(raised, F.col("_threatened")).otherwise(F.col("_value")).alias("requirement")
    )


LEVELS = ("hidden", "optional", "recommended", "required")


def _rule_masks(config: DataFrame, profile: str) -> Column:
    """The profile as one value: map of a level and its value to a bit mask of fields for each requirement.

    A bit is a field of ``field_values`` by its place. The map has one entry a configured value and is a scalar
    subquery, so drafts look their rules up where they are instead of meeting them in joins.
    """
    bit = S.lookup("field", {name: 1 << i for i, name in enumerate(field_values())})
    key = F.when(F.col("level").isin("base", "threatened"), F.col("level")).otherwise(F.concat_ws("|", "level", "level_value"))
    masks = config.filter(F.col("profile") == profile).withColumn("bit", bit.cast("long")).groupBy(key.alias("key")).agg(
        *[F.bit_or(F.when(F.col("requirement") == r, F.coalesce("bit", F.lit(0))).otherwise(0)).alias(r) for r in LEVELS])
    return masks.agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct(*LEVELS))))).scalar()


def _with_requirements(rows: DataFrame, config: DataFrame, profile: str) -> DataFrame:
    """Rows with ``must`` and ``should``: bit masks of the fields that are required and recommended in their context.

    The rules of ``resolve_requirements`` as mask arithmetic: a later level takes the place of an earlier one in
    the fields it names; the record type leaves alone what the method hides; a threatened taxon only raises.
    """
    def found(key: Column) -> Column:
        return F.element_at("rules", key)

    def word(level: str, requirement: str) -> Column:
        return F.coalesce(F.col(f"{level}_rules.{requirement}"), F.lit(0).cast("long"))

    keyed = rows.withColumn("rules", _rule_masks(config, profile)).withColumns({
        "base_rules": found(F.lit("base")), "group_rules": found(F.concat(F.lit("group|"), "tax_group")), "method_rules": found(F.concat(F.lit("method|"), "method")),
        "type_rules": found(F.concat(F.lit("record_type|"), "record_type")), "threatened_rules": F.when(F.col("threatened"), found(F.lit("threatened")))})
    value = {r: word("base", r) for r in LEVELS}
    for level in ("group", "method", "type"):
        own = {r: word(level, r) for r in LEVELS}
        if level == "type":
            open_ = F.bitwise_not(word("method", "hidden"))
            own = {r: own[r].bitwiseAND(open_) for r in LEVELS}
        free = F.bitwise_not(own["hidden"].bitwiseOR(own["optional"]).bitwiseOR(own["recommended"]).bitwiseOR(own["required"]))
        names = {f"{level}_{r}": value[r].bitwiseAND(free).bitwiseOR(own[r]) for r in LEVELS}
        keyed = keyed.withColumns(names)
        value = {r: F.col(f"{level}_{r}") for r in LEVELS}
    shown = F.bitwise_not(value["hidden"])
    keyed = keyed.withColumn("must", value["required"].bitwiseOR(word("threatened", "required").bitwiseAND(shown)))
    keyed = keyed.withColumn("should", value["recommended"].bitwiseOR(word("threatened", "recommended").bitwiseAND(shown)).bitwiseAND(F.bitwise_not("must")))
    return keyed.drop("rules", *[f"{x}_rules" for x in ("base", "group", "method", "type", "threatened")], *[f"{x}_{r}" for x in ("group", "method", "type") for r in LEVELS])


def field_values() -> dict[str, Column]:
    """Text value of each requirable field of a draft; null or empty means missing."""
    c = lambda name: F.col(name).cast("string")
    return {
        "eventDate": c("event_date"), "eventTime": c("event_time"), "station": c("station_id"), "method": c("method"),
        "recordedBy": c("recorded_by"), "weather": c("weather"), "taxon": c("taxon_id"), "trapNumber": c("trap_number"),
        "reproductiveCondition": c("reproductive_condition"), "flightHeightReference": c("flight_height_reference"),
        "flightType": c("flight_type"), "timeBlock": c("time_block"),
        "recordType": F.when(~F.coalesce("record_type_inferred", F.lit(False)), c("record_type")),
        "individualCount": c("individual_count"), "sex": c("sex"), "lifeStage": c("life_stage"),
        "organismCondition": c("organism_condition"), "behaviour": c("behaviour"), "notes": c("notes"),
        "photos": F.when(F.size("media_ids") > 0, "x"),
        "occurrenceCoordinates": F.when(F.col("fix_requested"), "x"),
        "flightDirection": c("flight_direction"),
        "flightHeight": F.coalesce(c("flight_height_m"), c("flight_height_category")),
        "flightOrigin": c("flight_origin"), "flightDestination": c("flight_destination"),
        "playbackResponse": c("playback_response"), "detectionDistance": c("detection_distance_m"),
        "organismId": c("organism_id"),
    }


def prepare_drafts(drafts: DataFrame, taxa: DataFrame, config: DataFrame, *, profile: str = STANDARD_ID) -> DataFrame:
    """Drafts with their taxon and the requirements of their context: one join, no explosion."""
    rows = drafts.join(
        seen_taxa(taxa, drafts).select("taxon_id", "common_name", "scientific_name", "tax_group", "tax_order", "rce", "iucn", "origin",
                    "endemic", "rce_decree", "conservation_source"),
        "taxon_id", "left",
    ).withColumn("threatened", S.is_threatened("rce", "iucn"))
    nothing, several, corrected = _asks_for_taxon()
    return _with_requirements(rows, config, profile).withColumns(
        {
            "fix_reason": S.location_fix_reason("rce", "iucn", "tax_group", "tax_order", "record_type"),
            "taxon_asked": nothing | several | corrected,
        }
    ).withColumn("field_states", field_states())


def _issue(rule: str, when: Column, field: str, severity: str, level: str, message: Column) -> tuple[str, Column]:
    return rule, F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(
            F.lit(rule).alias("rule"), F.lit(field).alias("field"), F.lit(severity).alias("severity"),
            F.lit(level).alias("level"), F.coalesce(message, F.lit("")).alias("message"),
        ),
    )


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _asks_for_taxon() -> tuple[Column, Column, Column]:
    """Conditions under which the taxon is already being asked about."""
    no_taxon = F.col("taxon_id").isNull()
    nothing = no_taxon & blank("verbatim_taxon") & (F.size("candidates") == 0)
    several = no_taxon & (F.size("candidates") > 1)
    corrected = ~blank("corrected_from") & F.col("taxon_id").isNotNull() & F.col("common_name").isNotNull()
    return nothing, several, corrected


def field_states() -> Column:
    """Array of struct(field, state) for each field that is missing and asked for.

    States: pending (required), info (recommended), silent (pending without a message). One plain
    expression a field, which compiles; ``prepare_drafts`` has already put the conditions shared by all
    fields into columns, and requirements are masks over the fields' places.
    """
    def state(i: int, name: str, value: Column) -> Column:
        must = F.col("must").bitwiseAND(F.lit(1 << i)) != 0
        asked, silent = must | (F.col("should").bitwiseAND(F.lit(1 << i)) != 0), F.array_contains("acknowledged", name)
        if name == "occurrenceCoordinates":
            asked, must = must | F.col("fix_reason").isNotNull(), F.lit(True)
        if name == "taxon":
            asked = asked & ~(F.col("taxon_asked") & (F.size("candidates") == 0))
            silent = F.col("taxon_asked") | silent
        return F.when(blank(value) & asked, F.struct(
            F.lit(name).alias("field"),
            F.when(silent, "silent").when(must, "pending").otherwise("info").alias("state")))

    return F.array_compact(F.array(*[state(i, name, value) for i, (name, value) in enumerate(field_values().items())]))


def _state_message(s: Column) -> Column:
    label = F.lower(S.lookup(s["field"], V.FIELD_LABELS))
    why = F.when(
        (s["field"] == "occurrenceCoordinates") & F.col("fix_reason").isNotNull(),
        F.concat(F.lit(" ("), F.col("fix_reason"), F.lit(")")),
    ).otherwise("")
    return F.when(s["state"] == "pending", F.concat(F.lit("Falta "), label, why, F.lit("."))).otherwise(
        F.concat(F.lit("Sin "), label, F.lit(" (recomendado).")))


def _question_rules() -> dict[str, Column]:
    n = F.coalesce("individual_count", F.lit(0))
    nothing, several, corrected = _asks_for_taxon()
    name = F.coalesce("common_name", F.lit("Esta especie"))
    badge, detail = S.conservation_badge("rce", "iucn"), S.conservation_detail("rce", "iucn", "rce_decree", "conservation_source")
    scoped = lambda attr, scope: (
        (n > 1) & ~blank(attr) & (F.col(attr) != "Indeterminado") & (F.col(scope) == "sin_definir"))
    ask_scope = lambda attr: _text("¿Los ", n.cast("string"), " individuos son ", F.lower(attr), "?")
    enabled = F.array_contains("project_methods", F.col("method"))
    why_photo = (
        F.when(F.col("threatened"), "Especie en categoría de conservación")
        .when(F.col("confidence") != "seguro", _text('Identificación "', F.col("confidence"), '"'))
        .otherwise(_text("Registro por ", F.lower("record_type")))
    )
    flight = F.lit(False)
    for c in ("flight_direction", "flight_height_m", "flight_height_category", "flight_origin", "flight_destination",
              "flight_height_reference", "flight_type"):
        flight = flight | F.col(c).isNotNull()
    rules = [
        _issue("v_no_taxon", nothing, "taxon", "blocker", "occurrence",
               F.lit("No se reconoció ninguna especie. Dicta o escribe al menos el nombre común.")),
        _issue("v_ambiguous_taxon", several, "taxonAmbiguity", "question", "occurrence",
               _text('"', F.coalesce("verbatim_taxon", F.lit("ese nombre")),
                     '" corresponde a más de una especie. ¿Cuál registraste?')),
        _issue("v_corrected_taxon", corrected, "taxonAmbiguity", "question", "occurrence",
               _text('Escuché "', F.col("corrected_from"), '". ¿Es ', F.col("common_name"), "?")),
        _issue("v_sex_scope", scoped("sex", "sex_scope"), "sexScope", "question", "occurrence", ask_scope("sex")),
        _issue("v_stage_scope", scoped("life_stage", "life_stage_scope"), "lifeStageScope", "question", "occurrence",
               ask_scope("life_stage")),
        _issue("v_indirect_count", F.col("record_type").isin(V.FIXED_EVIDENCE) & (F.col("individual_count") > 0),
               "consistency", "question", "occurrence",
               _text("Registraste ", F.lower("record_type"), " con abundancia ", F.col("individual_count").cast("string"),
                     ". ¿La abundancia se refiere a individuos o a signos encontrados?")),
        _issue("v_method_not_enabled",
               F.col("method").isNotNull() & (F.col("method") != V.OPPORTUNISTIC) & (F.size("project_methods") > 0) & ~enabled,
               "method", "info", "event", F.lit("La metodología seleccionada no está habilitada para este proyecto.")),
        _issue("v_threatened", F.col("threatened"), "conservation", "info", "occurrence",
               F.trim(_text(name, " está en categoría de conservación: ", badge, ". ", F.coalesce(detail, F.lit(""))))),
        _issue("v_exotic", S.is_exotic("origin"), "conservation", "info", "occurrence",
               _text(name, " es exótica; se informa por separado en la línea base.")),
        _issue("v_photo_hint", (F.size("media_ids") == 0) & S.suggests_photo("rce", "iucn", "record_type", "confidence"),
               "photos", "info", "occurrence", _text(why_photo, ": una fotografía permitiría verificarlo después.")),
        _issue("v_flight_outside_method", flight & ~F.coalesce(F.col("method").isin(V.FLIGHT_METHODS), F.lit(False)),
               "consistency", "info", "occurrence",
               F.lit("Se capturaron datos de vuelo fuera de la metodología de tránsito aéreo;"
                     " se guardarán como hechos asociados.")),
    ]
    return dict(rules)


def draft_issues(prepared: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Long issue rows (draft_id, rule, field, severity, level, message) of ``prepare_drafts``.

    ``rules`` limits the work to some of the rules.
    """
    wanted = lambda rule: rules is None or rule in rules
    parts = []
    questions = [issue for rule, issue in _question_rules().items() if wanted(rule)]
    if questions:
        parts.append(F.array_compact(F.array(*questions)))
    if wanted("v_required_fields"):
        parts.append(F.transform(
            F.filter(F.col("field_states"), lambda s: s["state"] != "silent"),
            lambda s: F.struct(
                F.lit("v_required_fields").alias("rule"), s["field"].alias("field"), s["state"].alias("severity"),
                F.when(s["field"].isin(V.EVENT_LEVEL_FIELDS), "event").otherwise("occurrence").alias("level"),
                F.coalesce(_state_message(s), F.lit("")).alias("message"),
            ),
        ))
    issues = parts[0] if len(parts) == 1 else F.concat(*parts)
    return prepared.select("draft_id", F.explode(issues).alias("i")).select("draft_id", "i.*")


def effort_issues(drafts: DataFrame, effort: DataFrame, config: DataFrame, *, profile: str = STANDARD_ID) -> DataFrame:
    """Drafts whose event measures effort incompletely (``effort``: event_id, unit, measured, incomplete).

    Depends only on method and record type, so requirements are looked up with threatened off.
    """
    open_events = effort.filter(F.col("measured") & F.col("incomplete")).select("event_id", "unit")
    rows = drafts.join(open_events, "event_id").withColumns(
        {"threatened": F.lit(False), "tax_group": F.lit(None).cast("string")})
    wanted = resolve_requirements(rows, config, profile=profile).filter(F.col("field") == "effort").select(
        F.col("method").alias("_m"), F.col("record_type").alias("_r"), "requirement")
    what = (
        F.when(F.col("unit") == "distancia", "la distancia recorrida")
        .when(F.col("unit") == "trampas-noche", "las trampas-noche").otherwise("la duración del muestreo")
    )
    return rows.join(
        wanted, F.col("method").eqNullSafe(F.col("_m")) & F.col("record_type").eqNullSafe(F.col("_r")), "left"
    ).select(
        "draft_id", F.lit("v_effort_incomplete").alias("rule"), F.lit("effort").alias("field"),
        F.when(F.col("requirement") == "required", "pending").otherwise("info").alias("severity"),
        F.lit("event").alias("level"),
        _text("Mediste esfuerzo pero falta ", what, ". Ciérralo para poder comparar con otras campañas.").alias("message"),
    )


def drift_issues(fixes: DataFrame, stations: DataFrame) -> DataFrame:
    """Question for each position that seems to be at another station (see ``station_drift``)."""
    codes = stations.select("station_id", "station_code")
    named = (
        station_drift(fixes, stations)
        .join(codes.withColumnsRenamed({"station_id": "chosen_station_id", "station_code": "chosen"}), "chosen_station_id")
        .join(codes.withColumnsRenamed({"station_id": "nearer_station_id", "station_code": "nearer"}), "nearer_station_id", "left")
    )
    hint = F.coalesce(_text(". La más cercana es ", F.col("nearer")), F.lit(""))
    return named.select(
        F.col("fix_id").alias("draft_id"), F.lit("v_station_drift").alias("rule"), F.lit("stationDistance").alias("field"),
        F.lit("question").alias("severity"), F.lit("event").alias("level"),
        _text("Estás a ", F.col("distance_m").cast("string"), " m de ", F.col("chosen"), hint, ".").alias("message"),
    )


def ambiguous_options(drafts: DataFrame, taxa: DataFrame, limit: int = 6) -> DataFrame:
    """The first candidates offered for an ambiguous name, with their labels."""
    several = drafts.filter(F.col("taxon_id").isNull() & (F.size("candidates") > 1))
    offered = several.select("draft_id", F.posexplode(F.slice("candidates", 1, limit)).alias("pos", "option_id"))
    labels = taxa.select(F.col("taxon_id").alias("option_id"), F.when(
        ~blank("scientific_name"), F.concat_ws(" — ", "common_name", "scientific_name")
    ).otherwise(F.col("common_name")).alias("label"))
    return offered.join(labels, "option_id", "left").select(
        "draft_id", "pos", "option_id", F.coalesce("label", F.col("option_id").cast("string")).alias("label"))


def draft_result(prepared: DataFrame) -> DataFrame:
    """Per draft: its pending fields in form order and whether it can be saved (no blocker)."""
    nothing, _, _ = _asks_for_taxon()
    pending = F.transform(
        F.filter(F.col("field_states"), lambda s: s["state"].isin("pending", "silent")), lambda s: s["field"])
    return prepared.select("draft_id", pending.alias("pending_fields"), (~nothing).alias("can_save"))


def what_is_missing(issues: DataFrame) -> DataFrame:
    """Only what someone can act on: blockers, then questions, then pending fields."""
    rank = F.when(F.col("severity") == "blocker", 0).when(F.col("severity") == "question", 1).otherwise(2)
    missing = issues.filter(F.col("severity").isin("blocker", "question", "pending")).withColumn("urgency", rank)
    return written(missing, "missing").orderBy("draft_id", "urgency", "field")
