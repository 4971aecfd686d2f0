"""Spoken Spanish notes to observation rows: joins over token spans instead of a scanner.

utterance -> chunks -> tokens -> n-grams, which meet the species keys and the phrase table in
equi-joins; a fold inside the chunk's own short array picks the spans that do not overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions import lexicon as L
from fieldtally.functions import survey as S
from fieldtally.functions import vocab as V
from fieldtally.functions.text import fold, singular_candidates, tokenize
from fieldtally.session import shuffled, spread, written

CHUNK = ["utterance_id", "chunk_no"]
NO_DETECTION = (r"\b(sin registros?|sin detecciones?|no (se )?(registro|registre|detecto|detecte|hubo|vi|observe)"
                r"( nada| registros?| especies?)?|nada que registrar|estacion vacia|cero registros?)\b")


# --- commands -----------------------------------------------------------------------------

# Whole sentences that are orders, tried in this order.
COMMANDS = [
    ("que_me_falta", r"^(que me falta|que falta|falta algo)$", 0),
    ("nuevo_registro", r"^(nuevo registro|otra observacion|siguiente registro|nueva observacion)$", 0),
    ("guardar", r"^(guardar|guarda|listo|ok guardar|confirmar)$", 0),
    ("cancelar", r"^(cancelar|descartar|borrar esto|olvidalo)$", 0),
    ("eliminar", r"^(eliminar|eliminar registro|borrar registro)$", 0),
    ("duplicar", r"^(duplicar|duplicar registro|duplicar este)$", 0),
    ("agregar_foto", r"^(agregar foto|agrega foto|tomar foto|tomar fotografia|agregar fotografia)$", 0),
    ("revisar_pendientes", r"^(revisar pendientes|ver pendientes|pendientes)$", 0),
    ("resumen", r"^(resumen|resumen del dia|resumen de terreno|resumen de la jornada)$", 0),
    ("sincronizar", r"^(sincronizar|sincroniza|subir datos|subir registros)$", 0),
    ("agregar_individuo", r"^agregar (?:otro individuo|un individuo|(\d+) individuos)$", 1),
    ("editar_abundancia", r"^(?:editar |cambiar |corregir )?abundancia (?:a |en )?(\d+)$", 1),
    ("cambiar_estacion", r"^cambiar estacion (?:a |por )?([a-z]{1,5} ?\d{1,3})$", 1),
    ("iniciar_track", r"^(iniciar|comenzar|empezar|abrir|partir) (el )?track(eo)?$", 0),
    ("cerrar_track", r"^(cerrar|terminar|finalizar|detener|parar) (el )?track(eo)?$", 0),
    ("marcar_punto", r"^(?:marcar |marca )?(?:punto|pto|waypoint) (?:de )?([a-z0-9]+)$", 1),
    ("sin_detecciones", r"^(sin registros?|sin detecciones?|nada que registrar|estacion vacia)$", 0),
    ("no_realizado", r"^no se (?:realizo|pudo(?: hacer)?|hizo|ejecuto|alcanzo)(?:\s*(?:por(?:que)?\s+)?(.+))?$", 1),
    ("otro_igual", r"^(?:otro|otra|uno|una) (?:igual|mas)$|^repetir(?: el ultimo| ultimo)?$|^(?:otros|otras) (\d+) (?:iguales|mas)$", 1),
    ("deshacer", r"^(deshacer|deshaz|borra(?: e)?l? ultimo|anular|me equivoque)$", 0),
    ("corregir", r"^(?:corrige|corregir|correccion|no)\s+(.+)$", 1),
    ("cambiar_metodologia", r"^(?:cambiar |usar )?metodologia (?:a |por )?(.+)$", 1),
]


def classify_utterance(utterances: DataFrame) -> DataFrame:
    """Adds ``command`` (null for a dictation) and its ``argument``."""
    text = fold("text")
    command, argument = None, None
    for kind, pattern, group in COMMANDS:
        hit = F.col("_folded").rlike(pattern)
        value = F.nullif(F.trim(F.regexp_extract("_folded", pattern, group)), F.lit("")) if group else F.lit(None).cast("string")
        if kind in ("agregar_individuo", "otro_igual"):
            value = F.coalesce(value, F.lit("1"))
        if kind == "cambiar_estacion":
            value = F.upper(F.replace(value, F.lit(" "), F.lit("")))
        command = F.when(hit, kind) if command is None else command.when(hit, kind)
        argument = F.when(hit, value) if argument is None else argument.when(hit, value)
    return utterances.withColumn("_folded", text).withColumns({"command": command, "argument": argument}).drop("_folded")


# --- chunks, dates, tokens ----------------------------------------------------------------

def split_chunks(utterances: DataFrame) -> DataFrame:
    """(utterance_id, chunk_no, chunk): cut at commas, stops and the words y / e.

    Points that do not separate ideas are kept: "S. rubecula" and "1,5".
    """
    safe = F.regexp_replace(F.regexp_replace("text", r"(?<![A-Za-zÀ-ÿ0-9_])([A-Za-zÀ-ÿ])\.\s*", "$1 "), r"(\d)[.,](\d)", "$1·$2")
    parts = F.split(safe, r"(?i)[,;.\n]+|\s+\by\b\s+|\s+\be\b\s+")
    cleaned = F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("·"), F.lit(".")))), lambda p: p != "")
    keep = [c for c in utterances.columns if c != "text"]
    return spread(utterances, "utterance_id").select(*keep, F.posexplode(cleaned).alias("chunk_no", "chunk"))


_FILL = r"(?:(?:el|la|del|de|dia|pasado|pasada|antepasado) )"
_NUM = r"(\d{1,2}|" + "|".join(sorted(L.DATE_NUMBERS, key=len, reverse=True)) + ")"
_DATE = (r"\b(?:(hoy)|(ayer)|(anteayer|antier|antes de ayer)|hace " + _NUM + r" (?:dias|dia)|" + _FILL + r"{0,2}("
         + "|".join(L.WEEKDAYS) + r")( pasado| pasada)?|" + _FILL + r"?" + _NUM + r"(?: de)? ("
         + "|".join(L.MONTH_NUMBERS) + r"))\b")


def read_dates(chunks: DataFrame, *, today: Column | str) -> DataFrame:
    """Adds spoken_date, days_ago and ``words`` (the folded chunk without the date)."""
    ref = (F.lit(today) if isinstance(today, str) else today).cast("date")
    text = F.col("_folded")
    g = lambda i: F.get(F.col("_said"), F.lit(i - 1))
    groups = F.array(*[F.nullif(F.regexp_extract("_folded", _DATE, i), F.lit("")) for i in range(1, 9)])
    number = lambda c: F.coalesce(c.try_cast("int"), S.lookup(c, L.DATE_NUMBERS))
    target = S.lookup(g(5), {w: i + 1 for i, w in enumerate(L.WEEKDAYS)})
    back = F.pmod(F.dayofweek(ref) - target, F.lit(7))
    weekday_back = F.when(back == 0, 7).otherwise(back) + F.when(g(6).isNotNull(), 7).otherwise(0)
    day, month = number(g(7)), S.lookup(g(8), L.MONTH_NUMBERS)
    # A day past the month's end rolls into the next one, as calendars on devices do.
    in_year = lambda y: F.date_add(F.make_date(y, month, F.lit(1)), (day - 1).cast("int"))
    this_year = in_year(F.year(ref))
    by_month = F.when(this_year > ref, in_year(F.year(ref) - 1)).otherwise(this_year)
    days = (
        F.when(g(1).isNotNull(), 0).when(g(2).isNotNull(), 1).when(g(3).isNotNull(), 2)
        .when(g(4).isNotNull(), number(g(4))).when(g(5).isNotNull(), weekday_back)
        .when(day.between(1, 31) & month.isNotNull(), F.datediff(ref, by_month))
    )
    rows = chunks.withColumn("_folded", fold("chunk")).withColumn("_said", F.explode(F.array(groups))).withColumn("days_ago", days)
    rest = F.when(F.col("days_ago").isNotNull(), F.regexp_replace(text, f"^(.*?){_DATE}", "$1")).otherwise(text)
    return rows.withColumns(
        {
            "spoken_date": F.when(F.col("days_ago").isNotNull(), F.date_format(F.date_sub(ref, F.col("days_ago").cast("int")), "yyyy-MM-dd")),
            "words": F.trim(F.regexp_replace(rest, r" +", " ")),
        }
    ).drop("_folded", "_said")


def with_tokens(dated: DataFrame) -> DataFrame:
    return dated.withColumn("tokens", tokenize("words"))


def _positions(tokens: Column) -> Column:
    """1..n, empty for no tokens (a bare sequence would count down)."""
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))


def phrase_lengths(phrases: DataFrame, column: str) -> list[int]:
    """The word counts that the phrases of a catalogue have: as many numbers as its longest phrase has words at most."""
    counts = phrases.select(F.size(F.split(column, " ")).alias("n")).filter("n is not null").distinct().orderBy("n")
    return [r["n"] for r in counts.collect()]


def ngrams(chunks: DataFrame, lengths: list[int]) -> DataFrame:
    """(utterance_id, chunk_no, start, n, window) for every run of tokens that has one of ``lengths``."""
    starts = chunks.select(*CHUNK, "tokens", F.explode(_positions(F.col("tokens"))).alias("start"))
    runs = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    return starts.select(*CHUNK, "start", F.explode(runs).alias("n"), "tokens").filter(F.col("n") <= F.size("tokens") - F.col("start") + 1).select(
        *CHUNK, "start", "n", F.slice("tokens", F.col("start"), F.col("n")).alias("window"))


# --- numbers ------------------------------------------------------------------------------

def read_numbers(chunks: DataFrame) -> DataFrame:
    """Counted quantities (start, n, number): digits, or a run of Spanish number words added up.

    Runs are gaps and islands over the chunk's token rows; "y" joins a run before a unit and
    "mil" multiplies what was said before it.
    """
    words = {**{w: ("unit", v) for w, v in L.UNITS.items()}, **{w: ("ten", v) for w, v in L.TENS.items()},
             **{w: ("hundred", v) for w, v in L.HUNDREDS.items()}, "mil": ("mil", 1000)}
    kind = S.lookup("token", {w: k for w, (k, _) in words.items()})
    value = S.lookup("token", {w: v for w, (_, v) in words.items()})
    tokens = chunks.select(*CHUNK, F.posexplode("tokens").alias("i", "token"))
    per_chunk = Window.partitionBy(*CHUNK).orderBy("i")
    rows = tokens.withColumns({"kind": kind, "value": value, "digits": F.col("token").rlike(r"^\d+$")})
    rows = rows.withColumn(
        "links", (F.col("token") == "y") & F.lag("kind").over(per_chunk).isNotNull() & (F.lead("kind").over(per_chunk) == "unit"))
    rows = rows.filter(F.col("kind").isNotNull() | F.col("links") | F.col("digits"))
    previous_digits = F.coalesce(F.lag("digits").over(per_chunk), F.lit(False))
    breaks = F.col("digits") | previous_digits | (F.col("i") - F.coalesce(F.lag("i").over(per_chunk), F.lit(-9)) > 1)
    rows = rows.withColumn("run", F.sum(F.when(breaks, 1).otherwise(0)).over(per_chunk))
    in_run = Window.partitionBy(*CHUNK, "run").orderBy("i")
    rows = rows.withColumn("mils", F.sum(F.when(F.col("kind") == "mil", 1).otherwise(0)).over(in_run.rowsBetween(Window.unboundedPreceding, -1)))
    part = rows.groupBy(*CHUNK, "run", F.coalesce("mils", F.lit(0)).alias("part")).agg(
        F.min("i").alias("i"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("kind").isin("unit", "ten", "hundred"), F.col("value"))).alias("said"),
        F.max(F.when(F.col("kind") == "mil", True)).alias("thousand"),
        F.max(F.when(F.col("digits"), F.col("token").try_cast("bigint"))).alias("number"),
    )
    amount = F.when(F.col("number").isNotNull(), F.col("number")).when(
        F.col("thousand"), F.when(F.coalesce("said", F.lit(0)) == 0, 1).otherwise(F.col("said")) * 1000
    ).otherwise(F.coalesce("said", F.lit(0)))
    return part.withColumn("amount", amount).groupBy(*CHUNK, "run").agg(
        (F.min("i") + 1).alias("start"), F.sum("n").cast("int").alias("n"), F.sum("amount").cast("bigint").alias("number")
    ).drop("run")


# --- species ------------------------------------------------------------------------------

def _variants(window: Column) -> Column:
    """Singular forms of a window: each word alone in turn, then all words at once."""
    def replaced(i: Column) -> Column:
        forms = F.filter(singular_candidates(F.get(window, i)), lambda w: w != F.get(window, i))
        return F.transform(forms, lambda w: F.array_join(F.transform(window, lambda x, k: F.when(k == i, w).otherwise(x)), " "))

    one = F.flatten(F.transform(F.sequence(F.lit(0), F.size(window) - 1), replaced))
    every = F.array_join(F.transform(window, lambda w: F.element_at(singular_candidates(w), -1)), " ")
    return F.array_distinct(F.array_append(one, every))


def _pick(hits: DataFrame, order: list[Column]) -> DataFrame:
    payload = F.struct("start", "n", "matched", "confidence", "corrected_from")
    return hits.groupBy(*CHUNK).agg(F.min_by(payload, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("m")).select(
        *CHUNK, "m.*")


def _with_ids(hits: DataFrame, names: DataFrame) -> DataFrame:
    """The sorted ids of what each chunk matched, out of ``names`` (matched, taxon_id): only names that were said become lists."""
    said = hits.select("matched").distinct()
    ids = shuffled(names).join(said, "matched").groupBy("matched").agg(F.array_sort(F.collect_set("taxon_id")).alias("taxon_ids"))
    return shuffled(hits).join(ids, "matched").select(*CHUNK, "start", "n", "matched", "taxon_ids", "confidence", "corrected_from")


def match_taxa(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """The species of each chunk: (start, n, matched, taxon_ids, confidence, corrected_from).

    Exact or plural name; else the beginning of names; else a distinctive inner word; else a
    misspelling. Each pass looks only at the chunks the earlier ones left, leftmost first, then
    longest. A pass meets names with how many species they stand for; the species themselves are
    listed for the names that were chosen.
    """
    keys = keys.filter(F.col("key").isNotNull()).select("key", "taxon_id").distinct()
    names = keys.select("key").distinct()
    none = F.lit(None).cast("string")
    words = F.split("key", " ")
    forms = F.array_union(F.array(F.array_join("window", " ")), _variants(F.col("window")))
    lengths = phrase_lengths(names, "key")
    leftmost_longest = [F.col("start"), -F.col("n"), F.col("form")]

    def counted(matched: DataFrame) -> DataFrame:
        return matched.groupBy("matched").agg(F.count_distinct("taxon_id").alias("species"))

    def sure(one: float, several: float) -> Column:
        return F.when(F.col("species") == 1, one).otherwise(several)

    def exact(rest: DataFrame) -> DataFrame:
        spoken = ngrams(rest, lengths).select(*CHUNK, "start", "n", F.posexplode(forms).alias("form", "phrase"))
        hits = shuffled(spoken).join(names, F.col("phrase") == F.col("key")).select(
            *CHUNK, "start", "n", "form", F.col("phrase").alias("matched"),
            F.when(F.col("form") == 0, 1.0).otherwise(0.95).alias("confidence"), none.alias("corrected_from"))
        return _with_ids(_pick(hits, leftmost_longest), keys.withColumnRenamed("key", "matched"))

    def by_prefix(rest: DataFrame) -> DataFrame:
        shorter = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        prefixes = keys.select("taxon_id", F.explode(F.transform(
            shorter, lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("matched")).filter(F.length("matched") >= 4)
        spoken = ngrams(rest, [1, 2, 3]).select(*CHUNK, "start", "n", F.posexplode(forms).alias("form", "matched"))
        hits = shuffled(spoken).join(counted(prefixes), "matched").select(
            *CHUNK, "start", "n", "form", "matched", sure(0.9, 0.7).alias("confidence"), none.alias("corrected_from"))
        return _with_ids(_pick(hits, leftmost_longest), prefixes)

    def by_inner_word(rest: DataFrame) -> DataFrame:
        inner = keys.select("taxon_id", F.explode(F.slice(words, F.lit(2), F.size(words))).alias("matched")).filter(F.length("matched") >= 5)
        tokens = ngrams(rest, [1]).withColumn("token", F.get("window", F.lit(0))).filter(F.col("token").rlike("^[a-z]+$"))
        asked = tokens.select(*CHUNK, "start", "n", F.posexplode(singular_candidates("token")).alias("form", "matched")).filter(
            (F.length("matched") >= 5) & ~F.col("matched").isin(L.reserved_words()))
        hits = shuffled(asked).join(counted(inner).filter(F.col("species") <= 3), "matched").select(
            *CHUNK, "start", "n", "form", "matched", sure(0.85, 0.6).alias("confidence"), none.alias("corrected_from"))
        return _with_ids(_pick(hits, [F.col("start"), F.col("form")]), inner)

    def by_spelling(rest: DataFrame) -> DataFrame:
        spoken = ngrams(rest, [1, 2]).withColumn("phrase", F.array_join("window", " ")).filter(
            (F.length("phrase") >= 5) & F.col("phrase").rlike("^[a-z ]+$")).drop("window")
        near = nearest_keys(spoken.select("phrase").distinct(), names)
        hits = shuffled(spoken).join(near, "phrase").select(
            *CHUNK, "start", "n", F.col("key").alias("matched"),
            F.when(F.col("distance") == 1, 0.8).otherwise(0.65).alias("confidence"), F.col("phrase").alias("corrected_from"))
        return _with_ids(_pick(hits, [F.col("start"), -F.col("n")]), keys.withColumnRenamed("key", "matched"))

    # Each pass is written once, so that the next one reads its result instead of repeating it.
    rest, found = written(chunks.select(*CHUNK, "tokens"), "asked"), []
    for number, search in enumerate((exact, by_prefix, by_inner_word, by_spelling), start=1):
        hits = written(search(rest).withColumn("pass", F.lit(number)), "matched")
        found.append(hits)
        if number < 4:
            rest = written(shuffled(rest.select(*CHUNK, "tokens")).join(hits.select(*CHUNK), CHUNK, "left_anti"), "unmatched")
            if rest.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def nearest_keys(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """(phrase, key, distance): the closest key within 1 edit (2 from nine letters on) of each phrase; of equals the first by letters."""
    most = F.when(F.length("phrase") >= 9, 2).otherwise(1)
    measured = close_keys(phrases, names.select("key")).filter(F.col("distance") <= most)
    best = measured.groupBy("phrase").agg(F.min_by(F.struct("key", "distance"), F.struct("distance", "key")).alias("b"))
    return best.select("phrase", "b.*")


GRAM = 3


def _grams(text: str, sizes) -> Column:
    """Runs of letters with the place where each begins: array<struct<at, gram>>."""
    places = F.sequence(F.lit(1), F.length(text))
    return F.flatten(F.transform(sizes, lambda g: F.transform(
        F.filter(places, lambda i: i + g <= F.length(text) + 1), lambda i: F.struct(i.alias("at"), F.substr(F.col(text), i, g).alias("gram")))))


def containing_keys(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(q, key, at): the keys that contain a query, and where first. ``queries``: q; ``keys``: key; both distinct.

    Keys are posted under their runs of one, two and three letters, with the place. A query reads the postings of
    its own letters if it has three or fewer, else of that one of its three-letter runs which the fewest keys
    have, so its candidates are bounded by the rarest thing it says.
    """
    posted = keys.select("key", F.explode(_grams("key", F.array(*map(F.lit, range(1, GRAM + 1))))).alias("p")).select("key", "p.*")
    frequent = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("keys"))
    said = queries.select("q", F.explode(_grams("q", F.array(F.least(F.length("q"), F.lit(GRAM))))).alias("p")).select("q", F.col("p.at").alias("q_at"), "p.gram")
    rarest = said.join(frequent, "gram", "left").groupBy("q").agg(
        F.min_by(F.struct("gram", "q_at"), F.struct(F.coalesce("keys", F.lit(0)), "q_at")).alias("r")).select("q", "r.*")
    begins = (F.col("at") - F.col("q_at") + 1).cast("int")
    met = rarest.join(posted, "gram").withColumn("begins", begins).filter("begins >= 1")
    return met.filter(F.substr(F.col("key"), F.col("begins"), F.length("q")) == F.col("q")).groupBy("q", "key").agg(F.min("begins").alias("at"))


def taxon_search(queries: DataFrame, keys: DataFrame, names: DataFrame, *, limit: int = 12) -> DataFrame:
    """Ranked lookup of typed queries (query_id, query): equal 0, prefix 1, contained 2, close 3; then by name; top ``limit``.

    Queries typed alike are answered once. Those that have ``limit`` species without it never reach the
    search by spelling, as a close name can't stand before a contained one.
    """
    asked = queries.select("query_id", fold("query").alias("q")).filter(F.col("q") != "")
    said = asked.select("q").distinct()
    known = keys.filter(F.col("key").isNotNull()).select("key", "taxon_id").distinct()
    texts = known.select("key").distinct()
    score = F.when(F.col("key") == F.col("q"), 0).when(F.col("at") == 1, 1).otherwise(2)
    inside = containing_keys(said, texts).join(known, "key").groupBy("q", "taxon_id").agg(F.min(score).alias("score"))
    inside = written(inside, "search-inside")
    full = inside.groupBy("q").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
    wide = said.filter(F.length("q") >= 4).join(full, "q", "left_anti").select(F.col("q").alias("phrase"))
    close = close_keys(wide, texts).join(known, "key").select(F.col("phrase").alias("q"), "taxon_id", F.lit(3).alias("score")).distinct()
    scored = inside.unionByName(close).groupBy("q", "taxon_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("q").orderBy("score", fold("common_name"), "taxon_id")
    ranked = scored.join(names.select("taxon_id", "common_name"), "taxon_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return asked.join(ranked, "q").select("query_id", "taxon_id", "score", "common_name", "rank")


SHORT_KEY = 12


def _without(text: Column) -> Column:
    """A text's variants with one letter left out."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(
        F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, F.length(text))))).otherwise(F.array().cast("array<string>"))


def _deletions(text: str) -> Column:
    """A text and all its variants with one or two letters left out."""
    one = F.array_distinct(_without(F.col(text)))
    return F.array_distinct(F.concat(F.array(F.col(text)), one, F.flatten(F.transform(one, _without))))


def close_keys(phrases: DataFrame, keys: DataFrame) -> DataFrame:
    """All (phrase, key, distance) pairs within two edits.

    Keys of up to ``SHORT_KEY`` letters are indexed by their deletion neighbourhood: two texts within two edits
    become the same when at most two letters of each are left out, so such pairs meet under that common text.
    A longer key is cut into three pieces of four letters or more, one of which two edits leave untouched, at most
    two places off.
    """
    sized = keys.select("key", F.length("key").alias("len")).filter("key is not null")
    said = phrases.select("phrase", F.length("phrase").alias("size")).filter("phrase is not null")
    short = sized.filter(F.col("len") <= SHORT_KEY).select("key", F.explode(_deletions("key")).alias("left"))
    asked = said.filter(F.col("size") <= SHORT_KEY + 2).select("phrase", F.explode(_deletions("phrase")).alias("left"))
    near = shuffled(asked).join(short, "left").select("phrase", "key")

    third = F.floor(F.col("len") / 3).cast("int")

    def parts(df: DataFrame) -> DataFrame:
        return df.select("*", F.explode(F.array(
            F.struct(F.lit(0).alias("no"), F.lit(1).alias("at"), third.alias("n")),
            F.struct(F.lit(1).alias("no"), (third + 1).alias("at"), third.alias("n")),
            F.struct(F.lit(2).alias("no"), (2 * third + 1).alias("at"), (F.col("len") - 2 * third).alias("n")))).alias("p"))

    lengths = said.select("phrase", F.explode(F.sequence(F.col("size") - 2, F.col("size") + 2)).alias("len"))
    long = F.col("len") > SHORT_KEY
    indexed = parts(sized.filter(long)).select("key", "len", "p.no", F.expr("substring(key, p.at, p.n)").alias("piece"))
    probes = parts(lengths.filter(long))
    probes = probes.select("phrase", "len", "p.no", "p.n", F.explode(F.sequence(F.col("p.at") - 2, F.col("p.at") + 2)).alias("at")).filter(
        (F.col("at") >= 1) & (F.col("at") + F.col("n") - 1 <= F.length("phrase"))).select(
        "phrase", "len", "no", F.expr("substring(phrase, at, n)").alias("piece"))
    met = shuffled(probes).join(indexed, ["len", "no", "piece"]).select("phrase", "key")
    return met.unionByName(near).distinct().withColumn(
        "distance", F.levenshtein("phrase", "key", 2)).filter(F.col("distance").between(0, 2))


# --- attributes ---------------------------------------------------------------------------

SPAN = ["start", "priority", "length", "ord", "kind", "value"]
_CHOSEN = "array<struct<start:int,length:int,kind:string,value:string,role:string>>"


def _canonical(words: Column) -> Column:
    """Words without their final plural s, when longer than four letters."""
    return F.transform(words, lambda w: F.when(
        (F.length(w) > 4) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def tag_lexicon(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every phrase of the lexicon found in a chunk, tolerating a plural s said on top of it.

    Both sides are joined on their words without plural s; the exact rule is checked after.
    """
    phrases = lexicon.withColumn("words", F.split("phrase", " "))
    said = ngrams(chunks, phrase_lengths(phrases, "phrase")).withColumn("stem", F.array_join(_canonical(F.col("window")), " "))
    # A lexicon is configuration; the runs of words are as many as what was said.
    met = said.join(F.broadcast(phrases.withColumn("stem", F.array_join(_canonical(F.col("words")), " "))), "stem")
    same = F.forall(F.zip_with("window", "words", lambda t, w: (t == w) | (
        (F.length(t) > 4) & t.endswith("s") & (F.substr(t, F.lit(1), F.length(t) - 1) == w))), lambda ok: ok)
    kind = F.when((F.col("lexicon") == "direction") & (F.col("phrase") == "este"), "direction_este").otherwise(F.col("lexicon"))
    found = met.filter(same).select(
        *CHUNK, "lexicon", F.struct("start", "priority", F.col("n").alias("length"), "ord", kind.alias("kind"), "value").alias("s"))
    longest_first = F.struct((-F.col("s.length")).alias("l"), F.col("s.ord"))
    return found.groupBy(*CHUNK, "lexicon", "s.start").agg(F.min_by("s", longest_first).alias("s")).select(*CHUNK, "s.*")


def read_station(chunks: DataFrame, stations: DataFrame) -> DataFrame:
    """Station codes said in one or two tokens: known ones first, else letters and digits."""
    codes = stations.select(F.replace(fold("station_code"), F.lit(" "), F.lit("")).alias("said"), "station_code").groupBy("said").agg(
        F.min("station_code").alias("code"))
    spoken = ngrams(chunks, [1, 2]).withColumn("said", F.array_join("window", ""))
    known = shuffled(spoken).join(codes, "said").select(
        *CHUNK, "start", (F.col("n") - 1).alias("priority"), F.col("n").alias("length"), F.lit(0).alias("ord"),
        F.lit("station").alias("kind"), F.col("code").alias("value"))
    alone = (F.col("n") == 1) & F.col("said").rlike(r"^[a-z]{2,5}\d{1,3}$")
    split = (F.col("n") == 2) & F.get("window", F.lit(0)).rlike(r"^[a-z]{2,5}$") & F.get("window", F.lit(1)).rlike(r"^\d{1,3}$")
    guessed = spoken.filter(alone | split).select(
        *CHUNK, "start", (F.col("n") + 1).alias("priority"), F.col("n").alias("length"), F.lit(0).alias("ord"),
        F.lit("station_unknown").alias("kind"), F.upper("said").alias("value"))
    return known.unionByName(guessed)


def read_measures(chunks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Composite readings around a number: distance, flight height, trap, line; and slope chains."""
    listed = numbers.groupBy(*CHUNK).agg(F.collect_list(F.struct("start", "n", "number")).alias("numbers"))
    rows = shuffled(chunks).join(listed, CHUNK, "left").withColumn(
        "numbers", F.coalesce("numbers", F.array().cast("array<struct<start:int,n:int,number:bigint>>")))
    tokens = F.col("tokens")
    token = lambda i: F.get(tokens, (i - 1).cast("int"))

    def led_by(at: Column, triggers: list[str], fillers: list[str]) -> Column:
        """Trigger positions from which only fillers lead to the position."""
        places = F.when(at > 1, F.sequence(F.lit(1), (at - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: token(i).isin(triggers) & F.forall(
            F.slice(tokens, i + 1, (at - i - 1).cast("int")), lambda t: t.isin(fillers)))

    def span(start, end, priority: int, kind, value) -> Column:
        return F.struct(
            start.cast("int").alias("start"), F.lit(priority).alias("priority"), (end - start).cast("int").alias("length"),
            F.lit(0).alias("ord"), kind.alias("kind"), value.cast("string").alias("value"))

    def around_numbers(triggers, fillers, build, where=None) -> Column:
        chosen = F.col("numbers") if where is None else F.filter("numbers", where)
        return F.flatten(F.transform(chosen, lambda m: F.transform(
            led_by(m["start"], triggers, fillers), lambda i: build(i, m))))

    after = lambda m: m["start"] + m["n"]
    metres = lambda m: F.coalesce(token(after(m)).isin(L.METRES), F.lit(False))
    distance = around_numbers(L.DISTANCE_TRIGGERS, ["de", "unos", "aproximadamente"],
                              lambda i, m: span(i, after(m) + 1, 10, F.lit("detection_distance"), m["number"]), metres)
    height = around_numbers(
        L.HEIGHT_TRIGGERS, ["de", "vuelo", "del"],
        lambda i, m: span(i, after(m) + F.when(metres(m), 1).otherwise(0), 20,
                          F.when(~metres(m) & m["number"].between(1, 5), "height_category").otherwise("height_m"), m["number"]))
    trap = around_numbers(L.TRAP_TRIGGERS, L.SITE_FILLERS, lambda i, m: span(i, after(m), 60, F.lit("trap"), m["number"]))
    line = around_numbers(L.LINE_TRIGGERS, L.SITE_FILLERS,
                          lambda i, m: span(i, after(m), 65, F.lit("line"), F.concat(F.lit("Línea "), m["number"].cast("string"))))
    codes = F.filter(_positions(tokens), lambda i: token(i).rlike(r"^[a-z]{1,3}\d{1,3}$"))
    at_codes = lambda triggers, build: F.flatten(F.transform(codes, lambda p: F.transform(
        led_by(p, triggers, L.SITE_FILLERS), lambda i: build(i, p))))
    trap_code = at_codes(L.TRAP_TRIGGERS, lambda i, p: span(i, p + 1, 60, F.lit("trap"), F.upper(token(p))))
    line_code = at_codes(L.LINE_TRIGGERS, lambda i, p: span(i, p + 1, 65, F.lit("line"), F.concat(F.lit("Línea "), F.upper(token(p)))))

    terms = "|".join(L.SLOPE_TERMS)
    chain = rf"\b({'|'.join(L.SLOPE_TRIGGERS)})((?: (?:de|del|la|el|en|hacia)\b)*((?: (?:{terms})\b(?: (?:y|e|a)\b)*)*))"
    trigger, tail = F.regexp_extract("words", chain, 1), F.regexp_extract("words", chain, 2)
    said = F.regexp_extract_all(F.regexp_extract("words", chain, 3), F.lit(rf"\b({terms})\b"), F.lit(1))
    parts = F.array_distinct(F.concat(
        F.when(trigger == "ladera", F.array(F.lit("Ladera"))).otherwise(F.array().cast("array<string>")),
        F.transform(said, lambda w: S.lookup(w, L.SLOPE_TERMS))))
    first = F.array_position(tokens, trigger)
    width = lambda text: F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    slope = F.when(trigger != "", F.array(span(
        first, first + F.when(F.size(parts) > 0, 1 + width(tail)).otherwise(1), 40,
        F.when(F.size(parts) > 0, "slope").otherwise("skip"), F.array_join(parts, "-")))).otherwise(
        F.array().cast("array<struct<start:int,priority:int,length:int,ord:int,kind:string,value:string>>"))

    found = F.concat(distance, height, trap, line, trap_code, line_code, slope)
    return rows.select(*CHUNK, F.explode(found).alias("s")).select(*CHUNK, "s.*")


def _single_tokens(chunks: DataFrame) -> DataFrame:
    """Words that tell the role of the compass point that follows."""
    tokens = chunks.select(*CHUNK, F.posexplode("tokens").alias("i", "token"))
    role = F.when(F.col("token").isin(L.ORIGIN_TRIGGERS), "origin").when(F.col("token").isin(L.DESTINATION_TRIGGERS), "destination")
    return tokens.withColumn("value", role).filter(F.col("value").isNotNull()).select(
        *CHUNK, (F.col("i") + 1).alias("start"), F.lit(70).alias("priority"), F.lit(1).alias("length"), F.lit(0).alias("ord"),
        F.lit("role").alias("kind"), "value")


def choose_spans(chunks: DataFrame, taxa: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per chunk: the species, the spans read left to right without overlap, and unread words.

    Candidates of a chunk are few, so a fold over its own sorted array decides; "este" is a
    compass point only when a role word announced one.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct(
        "start", "priority", (-F.col("length")).alias("minus_length"), "ord", "kind", "value")))
    grouped = candidates.groupBy(*CHUNK).agg(sorted_.alias("candidates"))
    empty = F.array().cast("array<struct<start:int,priority:int,minus_length:int,ord:int,kind:string,value:string>>")
    rows = shuffled(shuffled(chunks).join(taxa, CHUNK, "left")).join(grouped, CHUNK, "left").withColumn("candidates", F.coalesce("candidates", empty))
    first, last = F.coalesce("start", F.lit(0)), F.coalesce(F.col("start") + F.col("n"), F.lit(0))
    free = F.filter("candidates", lambda c: (c["start"] < first) | (c["start"] >= last))

    def step(acc, c):
        lone_este = (c["kind"] == "direction_este") & acc["role"].isNull()
        take = (c["start"] >= acc["pos"]) & ~lone_este
        is_direction = c["kind"].isin("direction", "direction_este")
        kind = F.when(is_direction, "direction").otherwise(c["kind"])
        span = F.struct(c["start"].alias("start"), (-c["minus_length"]).alias("length"), kind.alias("kind"),
                        c["value"].alias("value"), acc["role"].alias("role"))
        return F.struct(
            F.when(take, c["start"] - c["minus_length"]).otherwise(acc["pos"]).alias("pos"),
            F.when(take & (c["kind"] == "role"), c["value"]).when(take & is_direction, F.lit(None).cast("string"))
            .otherwise(acc["role"]).alias("role"),
            F.when(take, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(1).alias("pos"), F.lit(None).cast("string").alias("role"), F.array().cast(_CHOSEN).alias("out"))
    rows = rows.withColumn("spans", F.aggregate(free, start, step)["out"])
    covered = lambda i: F.exists("spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["length"]))
    unread = F.filter(
        _positions(F.col("tokens")),
        lambda i: ~covered(i) & ~((i >= first) & (i < last)) & ~F.get("tokens", i - 1).isin(L.FILLERS))
    return rows.withColumns({
        "unread": F.transform(unread, lambda i: F.get("tokens", i - 1)),
        "has_taxon": F.col("matched").isNotNull(),
        # "cantando" is both a record type and a behaviour.
        "implied": F.transform(
            F.filter("spans", lambda s: s["kind"] == "record_type"),
            lambda s: F.struct(s["start"].alias("start"), F.get(F.filter(
                "candidates", lambda c: (c["kind"] == "behaviour") & (c["start"] == s["start"])), F.lit(0))["value"].alias("value"))),
    })


# --- observations -------------------------------------------------------------------------

def read_chunks(utterances: DataFrame, keys: DataFrame, stations: DataFrame, lexicon: DataFrame, *,
                today: Column | str) -> DataFrame:
    """All readings per chunk of (utterance_id, text): see ``choose_spans``."""
    chunks = written(with_tokens(read_dates(split_chunks(utterances.select("utterance_id", "text")), today=today)), "chunks")
    # A chunk that held only a date says nothing else.
    chunks = chunks.filter(F.size("tokens") > 0)
    numbers = written(read_numbers(chunks), "numbers")
    counts = numbers.select(*CHUNK, "start", F.lit(160).alias("priority"), F.col("n").alias("length"), F.lit(0).alias("ord"),
                            F.lit("count").alias("kind"), F.col("number").cast("string").alias("value"))
    parts = [tag_lexicon(chunks, lexicon), read_station(chunks, stations), read_measures(chunks, numbers), _single_tokens(chunks), counts]
    candidates = reduce(DataFrame.unionByName, [p.select(*CHUNK, *SPAN) for p in parts])
    return written(choose_spans(chunks, match_taxa(chunks, keys), candidates), "spans")


def utterance_header(utterances: DataFrame, chunks: DataFrame, *, today: Column | str) -> DataFrame:
    """What a sentence says about the sampling: station, method, weather, slope, site, date, absence.

    Dates are read from the sentences again, as a chunk may hold nothing but its date.
    """
    spans = chunks.select("utterance_id", "chunk_no", F.explode("spans").alias("s"))
    order = F.struct("chunk_no", F.col("s.start"))
    last = lambda *kinds: F.max_by(F.when(F.col("s.kind").isin(*kinds), F.col("s.value")),
                                   F.when(F.col("s.kind").isin(*kinds), order))
    said = spans.groupBy("utterance_id").agg(
        last("station", "station_unknown").alias("station_code"), last("method").alias("method"),
        last("weather").alias("weather"), last("slope").alias("slope_aspect"), last("line").alias("site_name"),
        (F.count_if(F.col("s.kind") == "opens") > 0).alias("opens_point"),
        (F.count_if(F.col("s.kind") == "station_unknown") > 0).alias("unknown_station"))
    dated = read_dates(split_chunks(utterances.select("utterance_id", "text")), today=today)
    dates = dated.filter(F.col("spoken_date").isNotNull()).groupBy("utterance_id").agg(
        F.max_by("spoken_date", "chunk_no").alias("spoken_date"))
    return (
        shuffled(shuffled(utterances.select("utterance_id", fold("text").rlike(NO_DETECTION).alias("no_detections")))
                 .join(said, "utterance_id", "left")).join(dates, "utterance_id", "left")
        .withColumns({"opens_point": F.coalesce("opens_point", F.lit(False)),
                      "unknown_station": F.coalesce("unknown_station", F.lit(False))})
    )


def segment_observations(utterances: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with the observation they belong to (obs_no from 1; 0 is shared context).

    A chunk with a species opens an observation; so does the first chunk of all with unknown
    words, unless the sentence declares an absence. Others continue the observation before them.
    """
    absence = utterances.select("utterance_id", fold("text").rlike(NO_DETECTION).alias("absence"))
    order = Window.partitionBy("utterance_id").orderBy("chunk_no")
    rows = shuffled(chunks).join(absence, "utterance_id")
    may_open = F.col("has_taxon") | ((F.size("unread") > 0) & ~F.col("absence"))
    first = F.sum(F.when(may_open, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    opens = F.col("has_taxon") | (may_open & first)
    return rows.withColumn("opens", opens).withColumn(
        "obs_no", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def finalize_observations(segmented: DataFrame) -> DataFrame:
    """One row per observation with its attributes; the last word on each attribute counts."""
    keys = ["utterance_id", "obs_no"]
    rows = segmented.filter(F.col("obs_no") > 0)
    spans = rows.select(*keys, "chunk_no", F.explode("spans").alias("s"))
    order = F.struct("chunk_no", F.col("s.start"))

    def last(kind: str, role: str | None = None, not_role: str | None = None) -> Column:
        when = F.col("s.kind") == kind
        if role:
            when = when & (F.col("s.role") == role)
        if not_role:
            when = when & ~F.coalesce(F.col("s.role") == not_role, F.lit(False))
        return F.max_by(F.when(when, F.col("s.value")), F.when(when, order))

    attributes = spans.groupBy(*keys).agg(
        last("record_type").alias("said_type"), last("count").cast("bigint").alias("said_count"), last("sex").alias("sex"),
        last("life_stage").alias("life_stage"), last("condition").alias("organism_condition"),
        last("behaviour").alias("said_behaviour"), last("confidence").alias("said_confidence"),
        last("detection_distance").cast("double").alias("detection_distance_m"), last("trap").alias("trap_number"),
        last("height_m").cast("double").alias("flight_height_m"), last("height_category").alias("flight_height_category"),
        last("direction", role="origin").alias("flight_origin"), last("direction", not_role="origin").alias("flight_direction"))
    implied = rows.select(*keys, "chunk_no", F.explode("implied").alias("i")).filter(F.col("i.value").isNotNull()).groupBy(*keys).agg(
        F.min_by("i.value", F.struct("chunk_no", F.col("i.start"))).alias("implied_behaviour"))
    opened = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("opens"), F.struct("matched", "taxon_ids", "confidence", "corrected_from", "unread"))).alias("o"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: c["chunk"]), ", ").alias("verbatim"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(
            "chunk_no", F.when(F.col("opens") & ~F.col("has_taxon"), F.array().cast("array<string>")).otherwise(F.col("unread")).alias("u")))),
            lambda c: c["u"])).alias("unread"),
    )
    joined = shuffled(shuffled(opened).join(attributes, keys, "left")).join(implied, keys, "left")
    known = F.col("o.matched").isNotNull()
    record_type = F.coalesce("said_type", F.lit("Individuo"))
    direct = ~record_type.isin(V.INDIRECT_RECORD_TYPES)
    count = F.when(F.col("said_count").isNull() & direct, F.lit(1)).otherwise(F.col("said_count"))
    scope = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != "Indeterminado") & ~F.coalesce(count > 1, F.lit(False)),
                             "todos").otherwise("sin_definir")
    sure = F.when(F.col("said_type").isNull(), F.least(F.col("o.confidence"), F.lit(0.8))).otherwise(F.col("o.confidence"))
    return joined.select(
        *keys, F.coalesce("o.taxon_ids", F.array().cast("array<string>")).alias("taxon_ids"),
        F.when(known, F.col("o.matched")).otherwise(F.array_join("o.unread", " ")).alias("verbatim_taxon"),
        F.col("o.corrected_from").alias("corrected_from"), record_type.alias("record_type"),
        F.col("said_type").isNull().alias("record_type_inferred"),
        F.when(direct, "Directo").otherwise("Indirecto").alias("evidence_kind"),
        count.alias("individual_count"), (F.col("said_count").isNull() & direct).alias("count_inferred"),
        "sex", scope("sex").alias("sex_scope"), "life_stage", scope("life_stage").alias("life_stage_scope"),
        "organism_condition", F.coalesce("said_behaviour", "implied_behaviour").alias("behaviour"),
        F.coalesce("said_confidence", F.lit("seguro")).alias("identification_confidence"),
        "detection_distance_m", "trap_number", "flight_height_m", "flight_height_category", "flight_origin",
        F.col("flight_direction").alias("flight_destination"), "flight_direction",
        F.when(F.size("unread") > 0, F.array_join("unread", " ")).alias("notes"),
        F.when(known, sure).otherwise(0.0).alias("confidence"), "verbatim",
    )


def parse_utterances(utterances: DataFrame, keys: DataFrame, stations: DataFrame, lexicon: DataFrame, *,
                     today: Column | str) -> dict[str, DataFrame]:
    """Observations and headers of dictated sentences (utterance_id, text)."""
    chunks = read_chunks(utterances, keys, stations, lexicon, today=today)
    observations = finalize_observations(segment_observations(utterances, chunks))
    headers = utterance_header(utterances, chunks, today=today)
    return {"observations": observations, "headers": headers, "warnings": utterance_warnings(chunks, observations, headers)}


def utterance_warnings(chunks: DataFrame, observations: DataFrame, headers: DataFrame) -> DataFrame:
    """What a person should look at (utterance_id, kind, warning): species kept as they were said, stations that the
    project doesn't have, and sentences without any species that weren't a header or a declared absence."""
    unknown = observations.filter((F.size("taxon_ids") == 0) & (F.col("verbatim_taxon") != "")).select(
        "utterance_id", F.lit("especie").alias("kind"),
        F.concat(F.lit('No conozco "'), F.col("verbatim_taxon"), F.lit('": queda guardado tal cual para que lo identifiques después.')).alias("warning"))
    foreign = chunks.select("utterance_id", F.explode("spans").alias("s")).filter(F.col("s.kind") == "station_unknown").select(
        "utterance_id", F.lit("estacion").alias("kind"), F.concat(F.lit('La estación "'), F.col("s.value"), F.lit('" no está en el catálogo del proyecto.')).alias("warning"))
    header_only = F.col("opens_point") | F.col("weather").isNotNull() | F.col("slope_aspect").isNotNull()
    nothing = shuffled(headers.filter(~F.col("no_detections") & ~header_only)).join(observations.select("utterance_id"), "utterance_id", "left_anti").select(
        "utterance_id", F.lit("nada").alias("kind"), F.lit("No se reconoció ninguna especie en el dictado.").alias("warning"))
    return unknown.unionByName(foreign).unionByName(nothing)


def to_drafts(observations: DataFrame, headers: DataFrame, session: DataFrame) -> DataFrame:
    """Draft rows: what the sentence says, else what the session (utterance_id, station_code,
    method, today, ...) had selected. One candidate becomes the taxon, several stay candidates."""
    heads = headers.select("utterance_id", F.col("station_code").alias("_st"), F.col("method").alias("_me"),
                           F.col("weather").alias("_we"), "spoken_date", "site_name")
    one = F.size("taxon_ids") == 1
    joined = shuffled(shuffled(observations).join(heads, "utterance_id", "left")).join(session, "utterance_id", "left")
    return joined.select(
        F.concat_ws("#", F.col("utterance_id").cast("string"), F.col("obs_no").cast("string")).alias("draft_id"),
        "utterance_id", "obs_no", F.coalesce("_st", "station_code").alias("station_code"), F.coalesce("_me", "method").alias("method"),
        F.coalesce("spoken_date", F.col("today").cast("string")).alias("event_date"), F.col("_we").alias("weather"), "site_name",
        F.when(one, F.get("taxon_ids", F.lit(0))).alias("taxon_id"),
        F.when(one, F.array().cast("array<string>")).otherwise(F.col("taxon_ids").cast("array<string>")).alias("candidates"),
        *[c for c in observations.columns if c not in ("utterance_id", "obs_no", "taxon_ids")],
    )


def apply_correction(corrections: DataFrame, records: DataFrame, lexicon: DataFrame) -> DataFrame:
    """"eran dos", "era hembra": what a correction (utterance_id, record_id, text) changes.

    Read with the same tagging as any sentence, without species; only attributes said are patched.
    """
    chunks = with_tokens(split_chunks(corrections.select("utterance_id", "text")).withColumn("words", fold("chunk")))
    numbers = read_numbers(chunks).select(*CHUNK, F.col("start"), F.lit("count").alias("kind"), F.col("number").cast("string").alias("value"))
    tags = tag_lexicon(chunks, lexicon).select(*CHUNK, "start", "kind", "value")
    order = F.struct("chunk_no", "start")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, order))
    said = tags.unionByName(numbers).groupBy("utterance_id").agg(
        last("count").cast("bigint").alias("_count"), last("sex").alias("_sex"), last("life_stage").alias("_stage"),
        last("record_type").alias("_type"), last("behaviour").alias("_behaviour"), last("condition").alias("_condition"))
    patch = corrections.join(said, "utterance_id")
    return records.join(patch.drop("text"), "record_id").select(
        "utterance_id", "record_id",
        F.coalesce("_count", "individual_count").alias("individual_count"), F.coalesce("_sex", "sex").alias("sex"),
        F.coalesce("_stage", "life_stage").alias("life_stage"), F.coalesce("_type", "record_type").alias("record_type"),
        F.coalesce("_behaviour", "behaviour").alias("behaviour"),
        F.coalesce("_condition", "organism_condition").alias("organism_condition"))
