"""Recognising the columns of foreign spreadsheets by their header."""

from __future__ import annotations

import csv
import json
import re
import unicodedata
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.fields import FIELDS
from fieldtally.functions.text import fold

#: Fixed values, one (field, header name) a line: how spreadsheets name a field besides its own label.
#: A caller adds more pairs, which come first, or gives another file of this form.
HEADER_NAMES = Path(__file__).with_name("header_names.csv")

NUMERIC_FIELDS = [
    "event.year", "event.month", "event.day", "occurrence.count", "occurrence.latitude", "occurrence.longitude",
    "occurrence.utmEast", "occurrence.utmNorth", "occurrence.detectionDistance", "occurrence.trapNumber",
    "station.latitude", "station.longitude", "station.utmEast", "station.utmNorth", "station.utmStartEast",
    "station.utmStartNorth", "station.utmEndEast", "station.utmEndNorth", "aerial.heightMeters",
    "aerial.heightCategory", "event.temperature", "event.wind", "event.cloud", "effort.trapNights",
]
CORE_FIELDS = [
    "event.date", "occurrence.time", "station.code", "event.method", "occurrence.commonName", "taxon.scientificName",
    "occurrence.recordType", "occurrence.count", "occurrence.sex", "occurrence.lifeStage", "occurrence.behaviour",
    "occurrence.notes", "occurrence.latitude", "occurrence.longitude", "conservation.category", "occurrence.photos",
]


def _fold_py(s: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()


def alias_table(extra: list[tuple[str, str]] = (), names: Path = HEADER_NAMES) -> list[tuple[int, str, str]]:
    """(order, alias, field id): labels and names in field order; the order breaks ties.

    ``extra`` pairs (header, field id) of a caller come first, so they win.
    """
    with names.open(newline="", encoding="utf-8") as lines:
        named = [(row["field_id"], row["name"]) for row in csv.DictReader(lines)]
    place = {field_id: k for k, field_id in enumerate(FIELDS)}
    pairs = sorted([(place[f], 0, spec.label, f) for f, spec in FIELDS.items()] + [
        (place.get(f, len(place)), k + 1, name, f) for k, (f, name) in enumerate(named)])
    folded = dict.fromkeys((_fold_py(name), f) for name, f in [*extra, *((name, f) for _, _, name, f in pairs)])
    return [(i, alias, f) for i, (alias, f) in enumerate(folded)]


def _best_match(q: Column, aliases: list[tuple[int, str, str]]) -> Column:
    """struct(loss, order, field, alias) of the best alias for a folded header; loss = -confidence."""
    # One text literal that the optimizer folds into a constant array.
    text = json.dumps([{"order": i, "alias": a, "field": f} for i, a, f in aliases])
    table = F.from_json(F.lit(text), "array<struct<order:int,alias:string,field:string>>")
    n = F.length(q)

    def scored(a: Column, confidence: Column) -> Column:
        return F.struct((-confidence).alias("loss"), a["order"].alias("order"), a["field"].alias("field"), a["alias"].alias("alias"))

    def ratio(a: Column) -> Column:
        return F.least(F.length(a["alias"]), n) / F.greatest(F.length(a["alias"]), n)

    def contained(a: Column) -> Column:
        one_in_other = q.contains(a["alias"]) | a["alias"].contains(q)
        return (F.length(a["alias"]) >= 4) & one_in_other & (ratio(a) >= 0.34)

    def typo(a: Column) -> Column:
        close = (F.abs(F.length(a["alias"]) - n) <= 2) & (n >= 5)
        return close & F.levenshtein(a["alias"], q, 2).between(0, 2)

    inside = F.array_min(F.transform(F.filter(table, contained), lambda a: scored(a, 0.6 + 0.25 * ratio(a))))
    spelled = F.array_min(F.transform(F.filter(table, typo), lambda a: scored(
        a, F.when(F.levenshtein(a["alias"], q, 2) == 1, 0.65).otherwise(0.55))))
    return F.struct(inside.alias("inside"), spelled.alias("spelled"))


def match_headers(headers: DataFrame, extra: list[tuple[str, str]] = (), column: str = "header") -> DataFrame:
    """Field and confidence for each distinct header.

    Tried as written, without notes in parentheses, and before a colon; a later form wins only
    with a higher confidence. The alias list is configuration, so it travels inside the plan as
    a constant array and each distinct header is scored where it is.
    """
    aliases = alias_table(extra)
    raw = F.col(column)
    no_note = F.regexp_replace(raw, r"\([^)]*\)", " ")
    before_colon = F.split(no_note, ":")[0]
    forms = F.array(
        F.struct(F.lit(0).alias("form"), fold(raw).alias("q")),
        F.struct(F.lit(1).alias("form"), fold(no_note).alias("q")),
        F.struct(F.lit(2).alias("form"), F.when(F.length(before_colon) < F.length(no_note), fold(before_colon)).alias("q")),
    )
    rows = headers.filter(raw.isNotNull()).select(column).distinct().select(column, F.explode(forms).alias("v")).select(
        column, "v.form", "v.q").filter(F.coalesce(F.col("q"), F.lit("")) != "")
    # Nothing beats an equal alias, so only headers without one are scored against the whole list.
    known: dict[str, tuple[int, str]] = {}
    for order, alias, field in aliases:
        known.setdefault(alias, (order, field))
    equal = F.from_json(F.lit(json.dumps({a: {"order": o, "field": f} for a, (o, f) in known.items()})), "map<string,struct<order:int,field:string>>")
    rows = rows.withColumn("equal", F.element_at(equal, F.col("q")))
    hit = F.struct(F.lit(-1.0).alias("loss"), F.col("equal.order").alias("order"), F.col("equal.field").alias("field"), F.col("q").alias("alias"))
    rows = rows.withColumn("exact", F.when(F.col("equal").isNotNull(), hit)).drop("equal")
    exact = rows.filter(F.col("exact").isNotNull()).groupBy(column).agg(F.min_by("exact", "form").alias("best"))
    scored = rows.join(exact.select(column), column, "left_anti").withColumn("m", _best_match(F.col("q"), aliases))
    inside_wins = F.col("m.inside.loss") <= F.coalesce(F.col("m.spelled.loss"), F.lit(0.0))
    best = F.when((F.col("m.inside.loss") <= -0.7) | inside_wins, F.col("m.inside")).otherwise(F.col("m.spelled"))
    guessed_best = scored.withColumn("best", best).filter(F.col("best").isNotNull()).groupBy(column).agg(
        F.min_by("best", F.struct(F.col("best.loss"), F.col("form"))).alias("best"))
    chosen = exact.unionByName(guessed_best)
    # An identifier of the standard is never guessed.
    guessed = (F.col("best.loss") > -1) & raw.rlike(r"(?i)\bdwc\b|darwin core")
    return headers.select(column).distinct().join(chosen, column, "left").select(
        column,
        F.when(~guessed, F.col("best.field")).alias("field_id"),
        F.coalesce(F.when(~guessed, -F.col("best.loss")), F.lit(0.0)).alias("confidence"),
        F.when(~guessed, F.col("best.alias")).alias("matched_alias"),
    )
