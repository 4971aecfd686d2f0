"""Column functions on hand-made values."""

import random

from pyspark.sql import functions as F

from fieldtally.functions import geo as G
from fieldtally.functions import survey as S
from fieldtally.functions import text as T


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_fold_and_tokens(spark):
    r = one(spark, T.fold(F.lit("  Ratón  OLIVÁCEO (N°3)\n")), T.tokenize(F.lit("¡Ñandú, 2!")), T.tokenize(F.lit("--")))
    assert r == ("raton olivaceo n 3", ["nandu", "2"], [])


def test_singulars(spark):
    r = one(spark, *[T.singular_candidates(F.lit(w)) for w in ("perdices", "tiuques", "dos", "rayaditos")])
    assert r[0] == ["perdices", "perdiz", "perdic", "perdice"]
    assert r[1] == ["tiuques", "tiuqu", "tiuque"]
    assert r[2] == ["dos"]
    assert r[3] == ["rayaditos", "rayadito"]


def test_cells_and_numbers(spark):
    r = one(spark, T.clean_cell(F.lit(" 0 ")), T.clean_cell(F.lit("0"), "template"), T.parse_number(F.lit("1.234")),
            T.parse_number(F.lit("$ 12,5 m")), T.parse_number(F.lit("1.2.3")), T.parse_number(F.lit("n/a")))
    assert r == (None, "0", 1.234, 12.5, None, None)


def test_dates_and_times(spark):
    r = one(spark, T.excel_date(F.lit("45000")), T.excel_date(F.lit("3/9/2026")), T.excel_date(F.lit("2026-09-03T10:00")),
            T.excel_date(F.lit("ayer")), T.excel_time(F.lit("0.5")), T.excel_time(F.lit("a las 7:05")), T.excel_time(F.lit("tarde")))
    assert r == ("2023-03-15", "2026-09-03", "2026-09-03", None, "12:00", "07:05", None)


def test_utm_round_trip(spark):
    points = [(-33.45, -70.66), (-41.47, -72.94), (-18.48, -70.33), (-53.16, -70.91), (-31.2465, -71.5312)]
    df = spark.createDataFrame(points, "lat double, lon double")
    back = df.withColumn("u", G.to_utm("lat", "lon")).withColumn("p", G.from_utm("u.east", "u.north", "u.zone", "u.hemisphere"))
    worst = back.select(F.max(G.haversine_m("lat", "lon", "p.lat", "p.lon"))).first()[0]
    assert worst < 0.5
    assert one(spark, G.utm_zone(F.lit(-70.66))) == (19,)


def test_half_up_is_towards_plus_infinity(spark):
    assert one(spark, T.half_up(F.lit(-2.5)), T.half_up(F.lit(2.5)), T.half_up(F.lit(-0.125), 2)) == (-2, 3, -0.12)


def test_periods_and_labels(spark):
    r = one(spark, *[S.infer_period(F.lit(t)) for t in ("04:59", "05:00", "08:00", "19:00", "21:00")])
    assert list(r) == ["Nocturno", "Crepuscular", "Diurno", "Crepuscular", "Nocturno"]
    r = one(spark, S.cardinal_of(F.lit(197)), S.cardinal_of(F.lit(-10)), S.cardinal_of(F.lit(None).cast("int")),
            S.normalize_waypoint_label(F.lit(" Partida ")), S.season_of(F.lit("2026-12-01")))
    assert r == ("S", "N", None, "inicio", "Verano")


def test_effort_texts(spark):
    r = one(spark, S.format_duration(F.lit(42)), S.format_duration(F.lit(65)), S.format_duration(F.lit(120)),
            S.format_distance(F.lit(850)), S.format_distance(F.lit(1300)))
    assert r == ("42 min", "1 h 5 min", "2 h", "850 m", "1,30 km")


def test_field_day_runs_from_four(spark):
    df = spark.sql("select timestamp'2026-09-03 03:59:00' a, timestamp'2026-09-03 04:00:00' b")
    r = df.select(S.field_day("a").cast("string"), S.field_day("b").cast("string")).first()
    assert tuple(r) == ("2026-09-02", "2026-09-03")


def test_conservation_levels(spark):
    level = lambda rce, iucn=None: S.conservation_level(F.lit(rce).cast("string"), F.lit(iucn).cast("string"))
    r = one(spark, level("en"), level(None, "NT"), level("LC"), level(None), level("EN (JF); LC (Chile)"))
    assert list(r) == ["amenazada", "casi-amenazada", "sin-riesgo", "sin-clasificar", "sin-riesgo"]


def test_location_fix_need(spark):
    need = lambda rce, g, o, t: S.location_fix_reason(
        F.lit(rce).cast("string"), F.lit(None).cast("string"), F.lit(g), F.lit(o), F.lit(t))
    r = one(spark, need("VU", "aves", "x", "Individuo"), need(None, "aves", "x", "Fecas"), need(None, "reptiles", "x", "Individuo"),
            need(None, "mamiferos", "Rodentia", "Individuo"), need(None, "mamiferos", "Carnivora", "Individuo"),
            need(None, "aves", "x", "Registro de audio"))
    assert r[0] == "especie en categoría de conservación"
    assert r[1].startswith("fecas")
    assert r[2] == r[3] == "especie de baja movilidad"
    assert r[4] is None and r[5] is None


def test_record_types_keep_the_current_value(spark):
    r = one(spark, S.record_types_for_method(F.lit("songmeter"), current=F.lit("Fecas")),
            S.record_types_for_method(F.lit("camara_trampa"), F.array(F.lit("Huella"), F.lit("Nido"))))
    assert r == (["Registro de audio", "Vocalización", "Fecas"], ["Huella"])


def test_ids(spark):
    assert one(spark, S.dwc_id("survey", F.lit("Ñuble Sur 01"), "occ", F.lit("x1")))[0] == "urn:survey:nuble-sur-01:occ:x1"


def test_clean_cell_trims_what_the_pattern_trims(spark):
    """Trimmed without a pattern, but for the separators before which a pattern's end lies."""
    rng = random.Random(3)
    texts = ["".join(rng.choices(" \t\n\x0b\f\r\xa0\x85\u2028\u2029\u3000a-", k=rng.randint(0, 5))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None, "N/A ", "\t- ", "a \x85", "a \u2028", " b\n"]], "t string")
    pattern = F.regexp_replace(F.regexp_replace("t", "\xa0", " "), r"^\s+|\s+$", "")
    for reader in ("import", "template", "catalog"):
        marker = pattern.isin("", "-", "--", "n/a", "N/A") if reader == "catalog" else F.lower(pattern).isin(T.NULL_MARKERS[reader])
        got = rows.select(T.clean_cell("t", reader).alias("v"), F.when(~marker, pattern).alias("w")).collect()
        assert [r.v for r in got] == [r.w for r in got] and any(r.w for r in got)
    assert "trim(" in rows.select(T.clean_cell("t"))._jdf.queryExecution().optimizedPlan().toString()
