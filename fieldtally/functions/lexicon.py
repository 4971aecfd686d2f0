"""How field teams speak: phrases and the values they stand for.

All lists are fixed values in folded form (no accents). They are loaded as one table of
(lexicon, phrase, value, priority), so a project adds its own phrases as rows.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, one (lexicon, phrase, value) a line.
PHRASES = Path(__file__).with_name("phrases.csv")

# Order in which a reading of the same place is preferred; stations, distances and heights come
# before these, traps and lines between weather and direction, numbers last.
LEXICONS = {
    "opens": 30, "weather": 50, "direction": 80, "method": 90, "record_type": 100, "confidence": 110, "sex": 120,
    "life_stage": 130, "condition": 140, "behaviour": 150,
}

# Single words that open a reading, fill a sentence or count.
SLOPE_TRIGGERS = ["inclinacion", "exposicion", "ladera", "pendiente", "aspecto"]
SLOPE_TERMS = {
    "plano": "Plano", "llano": "Plano", "fondo": "Fondo de quebrada", "quebrada": "Quebrada", "cima": "Cima",
    "cumbre": "Cima", "ladera": "Ladera", "media": "Media ladera", "norte": "Norte", "sur": "Sur", "este": "Este",
    "oeste": "Oeste", "oriente": "Este", "poniente": "Oeste", "noreste": "Noreste", "noroeste": "Noroeste",
    "sureste": "Sureste", "suroeste": "Suroeste",
}
DISTANCE_TRIGGERS, HEIGHT_TRIGGERS = ["distancia", "a"], ["altura", "alto", "altitud"]
ORIGIN_TRIGGERS = ["desde", "proveniente", "viene", "origen"]
DESTINATION_TRIGGERS = ["hacia", "rumbo", "hasta", "destino", "direccion"]
TRAP_TRIGGERS, LINE_TRIGGERS = ["trampa", "trampas"], ["linea", "lineas", "transecta"]
METRES = ["metros", "metro", "m"]
SITE_FILLERS = [
    "asociada", "asociado", "asociadas", "asociados", "correspondiente", "numero", "n", "a", "al", "la", "el", "de", "del",
    "los", "las", "punto", "pto", "estacion",
]
FILLERS = [
    "de", "del", "la", "el", "los", "las", "unos", "unas", "con", "en", "a", "al", "y", "e", "o", "u", "que", "se", "su",
    "sus", "aproximadamente", "como", "mas", "menos", "sobre", "estacion", "punto", "especie", "registro", "registros",
    "encontre", "vi", "escuche", "observe", "hay", "habia", "tengo", "anote", "individuo", "individuos", "metros", "metro",
    "m", "vuelo", "sexo", "edad", "este", "esta", "ese", "esa",
]
UNITS = {
    "cero": 0, "un": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
    "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18,
    "diecinueve": 19, "veinte": 20, "veintiun": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25,
    "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29, "uno": 1, "una": 1, "veintiuno": 21,
    "veintiuna": 21,
}
TENS = {
    "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90,
}
HUNDREDS = {
    "cien": 100, "ciento": 100, "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500,
    "seiscientos": 600, "setecientos": 700, "ochocientos": 800, "novecientos": 900,
}
DATE_NUMBERS = {
    "un": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "uno": 1,
    "una": 1,
}
WEEKDAYS = [
    "domingo", "lunes", "martes", "miercoles", "jueves", "viernes", "sabado",
]
MONTH_NUMBERS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9,
    "octubre": 10, "noviembre": 11, "diciembre": 12, "setiembre": 9,
}


def lexicon_rows() -> list[tuple[str, str, str, int, int]]:
    """(lexicon, phrase, value, priority, order) of the built-in phrases."""
    lines = [line for line in PHRASES.read_text(encoding="utf8").splitlines() if not line.startswith("#")]
    return [(r["lexicon"], r["phrase"], r["value"], LEXICONS[r["lexicon"]], i) for i, r in enumerate(csv.DictReader(lines))]


def lexicon_table(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """The phrase table; ``extra`` (lexicon, phrase, value) wins over a built-in row for a phrase."""
    base = spark.createDataFrame(lexicon_rows(), "lexicon string, phrase string, value string, priority int, ord int")
    if extra is None:
        return base
    levels = spark.createDataFrame(list(LEXICONS.items()), "lexicon string, priority int")
    own = extra.join(levels, "lexicon").select("lexicon", "phrase", "value", "priority", F.lit(-1).alias("ord"))
    both = own.unionByName(base)
    return both.groupBy("lexicon", "phrase").agg(
        F.min_by(F.struct("value", "priority", "ord"), F.struct("ord", "value")).alias("b")).select("lexicon", "phrase", "b.*")


def reserved_words() -> list[str]:
    """Single words that already mean something, so they cannot name a species by themselves."""
    words = set(FILLERS) | set(SLOPE_TRIGGERS) | set(SLOPE_TERMS) | set(HEIGHT_TRIGGERS) | set(ORIGIN_TRIGGERS) | set(DESTINATION_TRIGGERS)
    words |= {p for name, p, *_ in lexicon_rows() if " " not in p and name != "opens"}
    return sorted(words)
