"""Dictated notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions.lexicon import lexicon_rows, lexicon_table
from fieldtally.functions.text import fold
from fieldtally.operators import changes as H
from fieldtally.operators import coverage as C
from fieldtally.operators import utterances as U
from fieldtally.plans.registry import register
from fieldtally.plans.views import pick

TODAY = "2026-09-04"


def keys(t):
    return t.taxon.select(fold("common_name").alias("key"), F.col("common_name").alias("taxon_id")).distinct()


def _chunks(t):
    return U.with_tokens(U.read_dates(U.split_chunks(t.utterance), today=TODAY))


def _parsed(t):
    return U.parse_utterances(t.utterance, keys(t), t.station, lexicon_table(t.spark), today=TODAY)


_NUMBER = "p_size%10"
register("split_chunks", lambda t: U.split_chunks(t.raw("part").select(
    F.col("p_partkey").alias("utterance_id"), F.concat(F.col("p_name"), F.lit(" y "), F.col("p_brand"), F.lit(", 1,5 S. "), F.col("p_type")).alias("text"))),
    """SELECT p_partkey AS utterance_id, 0 AS chunk_no, p_name AS chunk FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part
    UNION ALL SELECT p_partkey, 2, '1.5 S '||p_type FROM part""")
register("read_numbers", lambda t: U.read_numbers(_chunks(t)).select("utterance_id", "start", "n", "number"),
         f"SELECT p_partkey AS utterance_id, 1 AS start, 1 AS n, {_NUMBER} AS number FROM part")
register("match_taxa", lambda t: U.match_taxa(_chunks(t), keys(t)).select("utterance_id", "matched", "start", "n", "confidence", "pass"),
         "SELECT p_partkey AS utterance_id, p_name AS matched, 2 AS start, 2 AS n, 1e0 AS confidence, 1 AS pass FROM part")
_LONG = "de cola muy larga oscura"


def _long_names(t):
    """Sentences that say a species name of seven words in full, and the catalogue with those names."""
    said = t.raw("part").select(F.col("p_partkey").alias("utterance_id"), F.concat(F.lit("veo "), F.col("p_name"), F.lit(f" {_LONG}")).alias("text"))
    names = keys(t).union(keys(t).select(F.concat("key", F.lit(f" {_LONG}")), F.concat("taxon_id", F.lit("/larga"))))
    return U.match_taxa(U.with_tokens(U.read_dates(U.split_chunks(said), today=TODAY)), names)


def _long_phrases(t):
    """Sentences with a phrase of eight words that a project has added to the lexicon."""
    own = t.spark.createDataFrame([("behaviour", "mirando desde lo alto de una rama seca", "Acechando")], "lexicon string, phrase string, value string")
    said = t.raw("part").select(F.col("p_partkey").alias("utterance_id"), F.concat(
        F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " mirando desde lo alto de una rama seca").otherwise(" mirando desde lo alto")).alias("text"))
    return U.tag_lexicon(U.with_tokens(U.read_dates(U.split_chunks(said), today=TODAY)), lexicon_table(t.spark, own))


def _close(t):
    """All beginnings of whole part names as keys, all their ends as phrases: from one letter to the whole name, and longer
    ones of whole names twice over."""
    p = t.raw("part").select(F.col("p_name").alias("name")).distinct()
    parts = p.union(p.select(F.concat_ws(" ", "name", "name"))).select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("n"))
    begun = parts.select(F.expr("substring(name, 1, n)").alias("key")).distinct()
    return U.close_keys(parts.select(F.expr("substring(name, n)").alias("phrase")).distinct(), begun)


register("match_taxa_long_names", lambda t: _long_names(t).select("utterance_id", "matched", "start", "n", "confidence", "pass"),
         f"SELECT p_partkey AS utterance_id, p_name||' {_LONG}' AS matched, 2 AS start, 7 AS n, 1e0 AS confidence, 1 AS pass FROM part")
register("tag_lexicon_long_phrases", lambda t: _long_phrases(t).filter("value = 'Acechando'").select("utterance_id", "start", "length", "kind", "value"),
         "SELECT p_partkey AS utterance_id, 3 AS start, 8 AS length, 'behaviour' AS kind, 'Acechando' AS value FROM part WHERE p_partkey%2=0")
register("close_keys", lambda t: _close(t),
         """WITH names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_name||' '||p_name FROM part),
    begun AS (SELECT DISTINCT substr(name,1,n) AS key FROM (SELECT name, unnest(range(1,length(name)+1)) AS n FROM names)),
    said AS (SELECT DISTINCT substr(name,n) AS phrase FROM (SELECT name, unnest(range(1,length(name)+1)) AS n FROM names))
    SELECT phrase, key, CAST(levenshtein(phrase,key) AS INT) AS distance FROM said, begun
    WHERE abs(length(phrase)-length(key))<=2 AND levenshtein(phrase,key)<=2""")
register("tag_lexicon", lambda t: U.tag_lexicon(_chunks(t), lexicon_table(t.spark)).select("utterance_id", "start", "kind", "value"),
         """SELECT p_partkey AS utterance_id, 4 AS start, v.kind, v.value FROM part JOIN (VALUES (0,'sex','Macho'),(1,'sex','Hembra'),(2,'behaviour','Volando'),
    (3,'record_type','Vocalización'),(3,'behaviour','Vocalizando'),(4,'record_type','Fecas')) AS v(k,kind,value) ON p_partkey%5=v.k""")
_OBS = """SELECT p_partkey AS utterance_id, p_name AS taxon, CASE p_partkey%5 WHEN 3 THEN 'Vocalización' WHEN 4 THEN 'Fecas' ELSE 'Individuo' END AS record_type,
  CASE WHEN p_partkey%5=4 THEN 'Indirecto' ELSE 'Directo' END AS evidence_kind, p_size%10 AS individual_count,
  CASE p_partkey%5 WHEN 0 THEN 'Macho' WHEN 1 THEN 'Hembra' END AS sex,
  CASE WHEN p_partkey%5<2 AND p_size%10<=1 THEN 'todos' ELSE 'sin_definir' END AS sex_scope,
  CASE p_partkey%5 WHEN 2 THEN 'Volando' WHEN 3 THEN 'Vocalizando' END AS behaviour, CASE WHEN p_partkey%5<3 THEN 8e-1 ELSE 1e0 END AS confidence FROM part"""
register("finalize_observation", lambda t: _parsed(t)["observations"].select(
    "utterance_id", F.get("taxon_ids", F.lit(0)).alias("taxon"), "record_type", "evidence_kind", "individual_count", "sex", "sex_scope", "behaviour", "confidence"),
    "SELECT * FROM obs", obs=_OBS)


def _lists(t):
    """Three-part sentences: a station, a species with its count, another species."""
    k = F.col("p_partkey")
    return t.raw("part").select(k.alias("utterance_id"), F.concat(
        F.lit("en EM"), F.lpad((k % 50).cast("string"), 4, "0"), F.lit(" hay dos "), F.col("p_name"),
        F.when(k % 2 == 0, " machos, ").otherwise(" posados, "),
        F.when(k % 3 == 0, "norte, ").otherwise(""), F.lit("tres small ring"), F.when(k % 5 == 0, ", ayer").otherwise("")).alias("text"))


register("segment_observations", lambda t: U.segment_observations(_lists(t), U.read_chunks(
    _lists(t), keys(t), t.station, lexicon_table(t.spark), today=TODAY)).select("utterance_id", "chunk_no", "obs_no", "matched"),
    """SELECT p_partkey AS utterance_id, 0 AS chunk_no, 1 AS obs_no, p_name AS matched FROM part
    UNION ALL SELECT p_partkey, 1, 1, NULL FROM part WHERE p_partkey%3=0
    UNION ALL SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN 2 ELSE 1 END, 2, 'small ring' FROM part""")
register("read_station", lambda t: U.utterance_header(_lists(t), U.read_chunks(
    _lists(t), keys(t), t.station, lexicon_table(t.spark), today=TODAY), today=TODAY).select("utterance_id", "station_code", "unknown_station", "spoken_date", "no_detections"),
    """SELECT p_partkey AS utterance_id, 'EM'||lpad(CAST(p_partkey%50 AS VARCHAR),4,'0') AS station_code, false AS unknown_station,
    CASE WHEN p_partkey%5=0 THEN '2026-09-03' END AS spoken_date, false AS no_detections FROM part""")


def _dated(t):
    k = F.col("p_partkey")
    said = pick(["hoy", "ayer", "anteayer", "antes de ayer", "hace tres dias", "el viernes", "el lunes pasado", "2 de junio", "el 30 de diciembre", "nada"], k % 10)
    return t.raw("part").select(k.alias("utterance_id"), F.concat(said, F.lit(" dos "), F.col("p_name")).alias("text"))


register("read_dates", lambda t: U.read_dates(U.split_chunks(_dated(t)), today=TODAY).select("utterance_id", "spoken_date", "days_ago", "words"),
         """SELECT p_partkey AS utterance_id, strftime(DATE '2026-09-04'-CAST(v.d AS INTEGER),'%Y-%m-%d') AS spoken_date, v.d AS days_ago,
    CASE WHEN v.k=9 THEN 'nada ' ELSE '' END||'dos '||p_name AS words
    FROM part JOIN (VALUES (0,0),(1,1),(2,2),(3,2),(4,3),(5,7),(6,11),(7,94),(8,248),(9,NULL)) AS v(k,d) ON p_partkey%10=v.k""")


def _measured(t):
    k = F.col("p_partkey")
    tail = pick(["a veinte metros", "altura de veinticinco metros", "altura 3", "trampa numero once", "ladera norte este", "hacia el este", "desde el sur", "este rod"], k % 8)
    return t.raw("part").select(k.alias("utterance_id"), F.concat_ws(" ", F.col("p_name"), tail).alias("text"))


register("read_measures", lambda t: U.parse_utterances(_measured(t), keys(t), t.station, lexicon_table(t.spark), today=TODAY)["observations"].select(
    "utterance_id", "detection_distance_m", "flight_height_m", "flight_height_category", "trap_number", "flight_destination", "flight_origin"),
    """SELECT p_partkey AS utterance_id, CASE WHEN k=0 THEN 20 END AS detection_distance_m, CASE WHEN k=1 THEN 25 END AS flight_height_m,
    CASE WHEN k=2 THEN '3' END AS flight_height_category, CASE WHEN k=3 THEN '11' END AS trap_number, CASE WHEN k=5 THEN 'E' END AS flight_destination,
    CASE WHEN k=6 THEN 'S' END AS flight_origin FROM (SELECT *, p_partkey%8 AS k FROM part)""")


def _sentences(t):
    k = F.col("p_partkey")
    return t.raw("part").select(k.alias("utterance_id"), pick(
        ["¿Qué me falta?", "Agregar 3 individuos", "Cambiar estación a EMF 10", "no se realizó, camino cortado", "otros 2 iguales", "Corrige eran dos", "sin registros", "dos chucaos"],
        k % 8).alias("text"))


register("classify_utterance", lambda t: U.classify_utterance(_sentences(t)).select("utterance_id", "command", "argument"),
         """SELECT p_partkey AS utterance_id, v.c AS command, v.a AS argument FROM part JOIN (VALUES (0,'que_me_falta',NULL),(1,'agregar_individuo','3'),
    (2,'cambiar_estacion','EMF10'),(3,'no_realizado','camino cortado'),(4,'otro_igual','2'),(5,'corregir','eran dos'),(6,'sin_detecciones',NULL),(7,NULL,NULL)) AS v(k,c,a)
    ON p_partkey%8=v.k""")
register("no_detection", lambda t: _sentences(t).select("utterance_id", fold("text").rlike(U.NO_DETECTION).alias("absence")),
         "SELECT p_partkey AS utterance_id, p_partkey%8=6 AS absence FROM part")
register("lexicon_union", lambda t: lexicon_table(t.spark, t.taxon.select(
    F.lit("behaviour").alias("lexicon"), F.col("common_name").alias("phrase"), F.lit("Jerga").alias("value")).unionByName(
    t.taxon.select(F.lit("sex").alias("lexicon"), F.lit("macho").alias("phrase"), F.lit("M").alias("value")))).groupBy("lexicon", "value").agg(F.count(F.lit(1)).alias("n")),
    "SELECT lexicon, value, count(*) AS n FROM (SELECT DISTINCT 'behaviour' AS lexicon, p_name AS phrase, 'Jerga' AS value FROM part UNION ALL SELECT 'sex','macho','M' UNION ALL "
    + "SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}','{c}')" for a, b, c, *_ in lexicon_rows() if (a, b) != ("sex", "macho")) + ") AS v(a,b,c)) GROUP BY ALL")


def _session(t):
    k = F.col("p_partkey")
    return t.raw("part").select(k.alias("utterance_id"), F.lit("EM0001").alias("station_code"), F.lit("transecto").alias("method"),
                                F.lit(TODAY).alias("today"), F.concat("p_name").alias("n")).drop("n")


def _drafts(t):
    p = _parsed(t)
    return U.to_drafts(p["observations"], p["headers"], _session(t))


register("to_drafts", lambda t: _drafts(t).select("draft_id", "station_code", "method", "event_date", "taxon_id", "individual_count", "record_type"),
         f"""SELECT utterance_id||'#1' AS draft_id, 'EM0001' AS station_code, 'transecto' AS method, '{TODAY}' AS event_date, taxon AS taxon_id, individual_count, record_type
    FROM obs""", obs=_OBS)


def _committed(t):
    drafts = _drafts(t).withColumns({
        "project_id": F.lit(1), "campaign_id": F.lit(2), "station_id": F.lit(1), "site_id": F.lit(None).cast("bigint"), "event_time": F.lit("10:00"),
        "occurrence_time": F.lit("10:00"), "project_code": F.lit("P-1"), "pending_fields": F.array().cast("array<string>"),
        "can_save": F.col("utterance_id") % 10 != 0,
        "playback_response": F.when(F.col("utterance_id") % 4 == 0, "canta"), "verbatim_taxon": F.col("verbatim_taxon")})
    return H.commit_tables(C.assign_events(drafts, t.event)["drafts"])


register("commit_drafts", lambda t: _committed(t)["occurrence"].groupBy("record_type", "evidence_kind", "source").agg(
    F.count(F.lit(1)).alias("n"), F.count_distinct("batch_id").alias("batches")),
    "SELECT record_type, evidence_kind, 'voz' AS source, count(*) AS n, count(*) AS batches FROM obs WHERE utterance_id%10<>0 GROUP BY ALL", obs=_OBS)
register("commit_measurements", lambda t: _committed(t)["measurement"].agg(F.count(F.lit(1)).alias("n")),
         "SELECT count(*) AS n FROM part WHERE p_partkey%10<>0 AND p_partkey%4=0")
register("apply_correction", lambda t: U.apply_correction(
    t.raw("part").select(F.col("p_partkey").alias("utterance_id"), F.col("p_partkey").alias("record_id"), pick(["eran dos", "era hembra", "eran tres juveniles"], F.col("p_partkey") % 3).alias("text")),
    t.raw("part").select(F.col("p_partkey").alias("record_id"), F.lit(1).cast("bigint").alias("individual_count"), F.lit("Macho").alias("sex"), F.lit(None).cast("string").alias("life_stage"),
                         F.lit("Individuo").alias("record_type"), F.lit(None).cast("string").alias("behaviour"), F.lit(None).cast("string").alias("organism_condition")),
    lexicon_table(t.spark)).select("record_id", "individual_count", "sex", "life_stage"),
    """SELECT p_partkey AS record_id, (ARRAY[2,1,3])[p_partkey%3+1] AS individual_count, CASE WHEN p_partkey%3=1 THEN 'Hembra' ELSE 'Macho' END AS sex,
    CASE WHEN p_partkey%3=2 THEN 'Juvenil' END AS life_stage FROM part""")


def _searches(t):
    return t.raw("part").select(F.col("p_type").alias("query_id"), F.substring(F.lower("p_name"), 1, 6).alias("query")).groupBy("query_id").agg(F.min("query").alias("query"))


register("taxon_search", lambda t: U.taxon_search(
    _searches(t), keys(t), t.taxon.select(F.col("common_name").alias("taxon_id"), "common_name").distinct()).select("query_id", "taxon_id", "score", "rank"),
    """SELECT query_id, key AS taxon_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, key) AS rank FROM (
      SELECT query_id, key, CASE WHEN key=q THEN 0 WHEN starts_with(key,q) THEN 1 WHEN contains(key,q) THEN 2
        WHEN length(q)>=4 AND levenshtein(key,q)<=2 THEN 3 END AS score
      FROM (SELECT p_type AS query_id, trim(min(substr(lower(p_name),1,6))) AS q FROM part GROUP BY 1), (SELECT DISTINCT p_name AS key FROM part))
    WHERE score IS NOT NULL QUALIFY rank<=12""")


def _typed(t):
    """Queries of one, two, three, five and eight letters out of the middle and the begin of names, a misspelt one each, and one in no name."""
    names = keys(t).select("key").distinct()
    cuts = [(1, 1), (1, 2), (3, 2), (2, 3), (1, 5), (3, 5), (1, 8), (2, 8)]
    typed = names.select("key", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in cuts])).alias("c")).select(
        F.expr("substring(key, c.a, c.n)").alias("query"))
    wrong = names.select(F.concat(F.lit("zx"), F.expr("substring(key, 3)")).alias("query"))
    typed = typed.union(wrong).union(names.select(F.lit("qqqq").alias("query"))).distinct()
    return typed.select(F.col("query").alias("query_id"), "query")


register("taxon_search_lengths", lambda t: U.taxon_search(
    _typed(t), keys(t), t.taxon.select(F.col("common_name").alias("taxon_id"), "common_name").distinct()).select("query_id", "taxon_id", "score", "rank"),
    """WITH names AS (SELECT DISTINCT lower(p_name) AS key, p_name AS id FROM part),
    cuts AS (SELECT unnest([1,1,3,2,1,3,1,2]) AS a, unnest([1,2,2,3,5,5,8,8]) AS n),
    typed AS (SELECT DISTINCT substr(key,a,n) AS query FROM names, cuts UNION SELECT DISTINCT 'zx'||substr(key,3) FROM names UNION SELECT 'qqqq')
    SELECT query AS query_id, id AS taxon_id, score, row_number() OVER (PARTITION BY query ORDER BY score, key) AS rank FROM (
      SELECT query, key, id, CASE WHEN key=trim(query) THEN 0 WHEN starts_with(key,trim(query)) THEN 1 WHEN contains(key,trim(query)) THEN 2
        WHEN length(trim(query))>=4 AND levenshtein(key,trim(query))<=2 THEN 3 END AS score FROM typed, names WHERE trim(query)<>'')
    WHERE score IS NOT NULL QUALIFY rank<=12""")


def _half_said(t):
    """Sentences that need the later passes: the begin of a name, an inner word of one, a misspelt one, none."""
    k = F.col("p_partkey")
    words = F.split(F.lower("p_name"), " ")
    wrong = F.concat(F.substring(F.lower("p_name"), 1, 2), F.lit("zz"), F.expr("substring(lower(p_name), 5)"))
    said = F.when(k % 4 == 0, words[0]).when(k % 4 == 1, F.concat(words[1], F.lit("ado"))).when(k % 4 == 2, wrong).otherwise("nada")
    return t.raw("part").select(k.alias("utterance_id"), F.concat(F.lit("veo "), said).alias("text"))


def _inner_names(t):
    """The catalogue and, for each second word of a name, a species with that word, lengthened, inside its name."""
    own = keys(t)
    second = own.select(F.split("key", " ")[1].alias("w")).distinct()
    return own.union(second.select(F.concat(F.lit("qu "), F.col("w"), F.lit("ado fino")), F.concat(F.lit("qu "), F.col("w"))))


register("match_taxa_later_passes", lambda t: U.match_taxa(U.with_tokens(U.read_dates(U.split_chunks(_half_said(t)), today=TODAY)), _inner_names(t)).select(
    "utterance_id", "matched", "start", "n", "confidence", "corrected_from", F.size("taxon_ids").alias("species"), "pass"),
    """WITH names AS (SELECT DISTINCT p_name AS key FROM part UNION SELECT DISTINCT 'qu '||split_part(p_name,' ',2)||'ado fino' FROM part),
    said AS (SELECT p_partkey AS utterance_id, p_partkey%4 AS k, CASE p_partkey%4 WHEN 0 THEN split_part(p_name,' ',1) WHEN 1 THEN split_part(p_name,' ',2)||'ado'
      WHEN 2 THEN substr(p_name,1,2)||'zz'||substr(p_name,5) END AS w FROM part),
    begun AS (SELECT w, count(DISTINCT key) AS species FROM (SELECT DISTINCT w FROM said WHERE k=0 AND length(w)>=4), names WHERE starts_with(key, w||' ') GROUP BY w),
    near AS (SELECT w, key, d FROM (SELECT DISTINCT w FROM said WHERE k=2), names, LATERAL (SELECT levenshtein(w,key) AS d)
      WHERE length(w)>=5 AND d<=CASE WHEN length(w)>=9 THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY w ORDER BY d, key)=1)
    SELECT utterance_id, w AS matched, 2 AS start, 1 AS n, CASE WHEN species=1 THEN 9e-1 ELSE 7e-1 END AS confidence, CAST(NULL AS VARCHAR) AS corrected_from, CAST(species AS INT) AS species, 2 AS pass
      FROM said JOIN begun USING (w) WHERE k=0
    UNION ALL SELECT utterance_id, w, 2, 1, 85e-2, NULL, 1, 3 FROM said WHERE k=1
    UNION ALL SELECT utterance_id, key, 2, CASE WHEN contains(w,' ') THEN 2 ELSE 1 END, CASE WHEN d=1 THEN 8e-1 ELSE 65e-2 END, w, 1, 4 FROM said JOIN near USING (w) WHERE k=2""")


def _doubtful(t):
    """Sentences with a species, an unknown one, a station the project lacks, only a header, nothing at all, an absence."""
    k = F.col("p_partkey")
    said = (F.when(k % 6 == 0, F.concat(F.lit("veo "), F.col("p_name"))).when(k % 6 == 1, "bicharraco raro").when(
        k % 6 == 2, F.concat(F.lit("en ZZ99 hay "), F.col("p_name"))).when(k % 6 == 3, "nublado").when(k % 6 == 4, "hay").otherwise("sin registros"))
    return t.raw("part").select(k.alias("utterance_id"), said.alias("text"))


register("utterance_warnings", lambda t: U.parse_utterances(_doubtful(t), keys(t), t.station, lexicon_table(t.spark), today=TODAY)["warnings"],
    """SELECT p_partkey AS utterance_id, v.kind, v.warning FROM part JOIN (VALUES
    (1,'especie','No conozco "bicharraco raro": queda guardado tal cual para que lo identifiques después.'),
    (2,'estacion','La estación "ZZ99" no está en el catálogo del proyecto.'),
    (4,'nada','No se reconoció ninguna especie en el dictado.')) AS v(k,kind,warning) ON p_partkey%6=v.k""")
