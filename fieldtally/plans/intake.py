"""Catalogue files and foreign spreadsheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions import vocab as V
from fieldtally.functions.headers import CORE_FIELDS, alias_table, match_headers
from fieldtally.operators import intake as I
from fieldtally.plans.registry import register
from fieldtally.plans.views import pick
from fieldtally.sources import catalogs as K
from fieldtally.sources import exchange_files as X

HEADERS = ["Nombre común (1)", "Fecha", "ID Estación", "Abundancia", "Tipo de registro", "Hora", "Columna propia"]
STATION_HEADERS = ["ID Estación", "Region", "UTM Este", "UTM Norte", "Ambiente (no modificar)", "N"]
SPECIES_HEADERS = ["Nombre comun", "Nombre cientifico (2)", "Tipo (4)", "Famila", "Orden"]


def cells(t):
    """The workbooks' cells, written once: what comes after reads one table, as it would a real one."""
    from fieldtally.session import written

    return written(_cells(t), "cells")


def _cells(t):
    """Spreadsheets of 20 files: a record sheet, a station sheet and a species list each."""
    k = F.col("o_orderkey")
    name = F.when(k % 9 == 0, "-").when(k % 9 == 1, F.concat(F.lit("bicho "), (k % 5).cast("string"))).otherwise(
        F.concat_ws(" ", pick(["Small", "red", "BLUE", "old"], k % 4), pick(["rod", "ring", "bolt"], F.floor(k / 4) % 3)))
    values = [
        name,
        F.when(k % 6 == 0, "s/f").when(k % 6 < 3, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(k % 10 != 0, F.concat(F.lit("EM"), (F.col("o_custkey") % 100).cast("string"))),
        (k % 12).cast("string"),
        pick(["Individuo", "fecas", "Avistaje", None], k % 4),
        F.concat((k % 24).cast("string"), F.lit(":30")),
        F.concat(F.lit("x"), k.cast("string")),
    ]
    records = t.raw("orders").select(
        (F.col("o_custkey") % 20).alias("file"), (10 + k).alias("row_no"),
        F.posexplode(F.array(*values)).alias("col_no", "value")).withColumn("sheet", F.lit("Registros"))
    s = F.col("s_suppkey")
    stations = t.raw("supplier").select(
        (s % 20).alias("file"), (5 + s).alias("row_no"),
        F.posexplode(F.array(F.concat(F.lit("EM"), s.cast("string")), F.lit("0"), (300000 + s).cast("string"),
                             F.concat((6300000 + s).cast("string"), F.lit(",5")), F.lit("Bosque"), s.cast("string"))).alias("col_no", "value"),
    ).withColumn("sheet", F.lit("Estaciones"))
    p = F.col("p_partkey")
    species = t.raw("part").select(
        (p % 20).alias("file"), (3 + p).alias("row_no"),
        F.posexplode(F.array(F.when(p % 3 != 0, F.col("p_name")), F.when(p % 5 != 0, F.concat_ws(" ", "p_brand", "p_type")),
                             F.lit("Chordata"), F.col("p_type"), p.cast("string"))).alias("col_no", "value"),
    ).withColumn("sheet", F.lit("Especies"))
    files = t.raw("orders").select((F.col("o_custkey") % 20).alias("file")).distinct()
    heads = None
    for sheet, row, names in (("Registros", 4, HEADERS), ("Estaciones", 2, STATION_HEADERS), ("Especies", 1, SPECIES_HEADERS)):
        part = files.select("file", F.lit(row).cast("bigint").alias("row_no"), F.posexplode(F.array(*map(F.lit, names))).alias("col_no", "value"),
                            F.lit(sheet).alias("sheet"))
        heads = part if heads is None else heads.unionByName(part)
    title = files.select("file", F.lit(1).cast("bigint").alias("row_no"), F.lit(0).alias("col_no"), F.lit("Empresa").alias("value"), F.lit("Registros").alias("sheet"))
    return records.unionByName(stations).unionByName(species).unionByName(heads).unionByName(title)


def keys(t):
    """Search keys: every part name, and a second species for names starting with s."""
    base = t.raw("part").select(F.lower("p_name").alias("key")).distinct()
    ids = F.when(F.col("key").startswith("s"), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return base.select("key", F.explode(ids).alias("v")).select("key", F.concat("key", F.lit("/"), "v").alias("taxon_id"))


_REC = """SELECT file, 10+k AS row_no, k, custkey, CASE WHEN k%9=0 THEN NULL WHEN k%9=1 THEN 'bicho '||(k%5)
    ELSE (['Small','red','BLUE','old'])[k%4+1]||' '||(['rod','ring','bolt'])[(k//4)%3+1] END AS common_name,
  CASE WHEN k%6<>0 THEN strftime(o_orderdate,'%Y-%m-%d') END AS event_date, CASE WHEN k%10<>0 THEN 'EM'||(custkey%100) END AS station_code,
  CASE WHEN k%12<>0 THEN CAST(k%12 AS DOUBLE) END AS individual_count, (['Individuo','fecas','Avistaje',NULL])[k%4+1] AS record_type,
  lpad(CAST(k%24 AS VARCHAR),2,'0')||':30' AS event_time
  FROM (SELECT *, o_orderkey AS k, o_custkey AS custkey, o_custkey%20 AS file FROM orders)"""
_IMP = """SELECT r.*, CASE WHEN common_name LIKE 'bicho%' THEN 0 WHEN lower(common_name) LIKE 's%' THEN 2 ELSE 1 END AS hits,
  CASE WHEN common_name NOT LIKE 'bicho%' AND lower(common_name) NOT LIKE 's%' THEN lower(common_name)||'/a' END AS taxon_id
  FROM rec r WHERE common_name IS NOT NULL"""

register("detect_header_row", lambda t: I.detect_header_row(cells(t)),
         """SELECT DISTINCT o_custkey%20 AS file, s.sheet, s.r AS header_row FROM orders,
    (VALUES ('Registros',4),('Estaciones',2),('Especies',1)) AS s(sheet,r)""")
register("detect_header_row_import", lambda t: I.detect_header_row(cells(t), "import"),
         """SELECT DISTINCT o_custkey%20 AS file, s.sheet, s.r AS header_row FROM orders,
    (VALUES ('Registros',4),('Estaciones',2),('Especies',1)) AS s(sheet,r)""")
_ALIASES = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{f}')" for i, a, f in alias_table()) + ") AS a(ord, alias, field)"
_HEADS = "SELECT * FROM (VALUES " + ", ".join(f"('{h}')" for h in dict.fromkeys(HEADERS + STATION_HEADERS + SPECIES_HEADERS)) + ") AS h(header)"
_FORMS = """SELECT header, form, trim(regexp_replace(strip_accents(lower(t)),'[^a-z0-9]+',' ','g')) AS q FROM (
  SELECT header, 0 AS form, header AS t FROM heads UNION ALL SELECT header, 1, regexp_replace(header,'\\([^)]*\\)',' ','g') FROM heads)"""
_HM = """SELECT header, field AS field_id, conf AS confidence FROM (
    SELECT header, form, field, conf, row_number() OVER (PARTITION BY header ORDER BY conf DESC, form) AS rn FROM (
      SELECT header, form, field, conf FROM (
        SELECT header, form, field, ord, conf, CASE WHEN kind=0 THEN 0 WHEN kind=1 AND conf>=0.7 THEN 1 ELSE 2 END AS tier, kind FROM (
          SELECT header, form, field, ord, 0 AS kind, 1e0 AS conf FROM forms JOIN aliases ON alias=q
          UNION ALL SELECT header, form, field, ord, 1, 0.6e0+0.25e0*(least(length(alias),length(q))/CAST(greatest(length(alias),length(q)) AS DOUBLE))
            FROM forms JOIN aliases ON (contains(q,alias) OR contains(alias,q)) AND length(alias)>=4
            AND least(length(alias),length(q))/CAST(greatest(length(alias),length(q)) AS DOUBLE)>=0.34e0
          UNION ALL SELECT header, form, field, ord, 2, CASE WHEN levenshtein(alias,q)=1 THEN 0.65e0 ELSE 0.55e0 END
            FROM forms JOIN aliases ON abs(length(alias)-length(q))<=2 AND length(q)>=5 AND levenshtein(alias,q)<=2)
        ) QUALIFY row_number() OVER (PARTITION BY header, form ORDER BY tier, conf DESC, kind, ord)=1)) WHERE rn=1"""
_HV = dict(aliases=_ALIASES, heads=_HEADS, forms=_FORMS, matched=_HM)
def _with_rows(t, build, variant="template"):
    c = cells(t)
    return build(c, I.detect_header_row(c, variant))


register("match_headers", lambda t: match_headers(_with_rows(t, I.sheet_headers)).select("header", "field_id", "confidence"),
         "SELECT h.header, m.field_id, coalesce(m.confidence,0) AS confidence FROM heads h LEFT JOIN matched m USING (header)", **_HV)

#: Headers of foreign files and the field that each one names, written down by hand: not read from the code's own list.
EXPECTED_FIELDS = {
    "Origen": "aerial.origin", "Origin": "aerial.origin", "Destino": "aerial.destination", "destination": "aerial.destination",
    "Registro diferido": "trace.deferredEntry", "Tiempo de muestreo": "effort.duration", "Minutos": "effort.duration",
    "occurrenceID": "trace.occurrenceId", "uuid": "trace.occurrenceId", "Trap nights": "effort.trapNights", "Sampling effort": "effort.label",
    "Created by": "trace.createdBy", "Validado": "trace.reviewState", "Procedencia": "conservation.origin", "Class": "taxon.class",
    "class latin": "taxon.classLatin", "Verbatim": "trace.utterance", "Kingdom": "taxon.kingdom", "phylum": "taxon.phylum",
    "Order": "taxon.order", "family": "taxon.family", "Genus": "taxon.genus", "life stage": "occurrence.lifeStage",
    "Common name": "occurrence.commonName", "recorded by": "event.recordedBy", "decimal latitude": "occurrence.latitude",
    "Individual count": "occurrence.count", "eventID": "event.id", "locationID": "station.darwinCoreLocationId", "Nubes": "event.cloud",
    "Rumbo": "aerial.direction", "Turno": "event.timeBlock", "Brigada": "event.team", "Mandante": "project.client", "Anillo": "occurrence.organismId",
    "Metros recorridos": "effort.distance", "Endemismo": "conservation.endemic", "Fecha de creación": "trace.createdAt", "Pendientes": "trace.pendingFields",
}


def _foreign_headers(t):
    """Every order heads one column of a foreign file with one of the names."""
    return t.raw("orders").select(pick(list(EXPECTED_FIELDS), F.col("o_orderkey") % len(EXPECTED_FIELDS)).alias("header"))


def _chosen_rows(t):
    """A header row chosen by hand below row 25: the first one of each record sheet."""
    c = cells(t)
    return I.sheet_headers(c, c.filter("row_no > 25 and sheet = 'Registros'").groupBy("file", "sheet").agg(F.min("row_no").alias("header_row")))


register("match_headers_all", lambda t: match_headers(_foreign_headers(t)).select("header", "field_id", "confidence"),
         "SELECT DISTINCT h AS header, f AS field_id, 1e0 AS confidence FROM orders JOIN (VALUES "
         + ", ".join(f"({k}, '{h}', '{f}')" for k, (h, f) in enumerate(EXPECTED_FIELDS.items())) + f") AS e(k, h, f) ON o_orderkey%{len(EXPECTED_FIELDS)}=k")
register("sheet_headers_chosen_row", lambda t: _chosen_rows(t).filter("col_no >= 5").select("file", "header_row", "col_no", "header"),
         """WITH low AS (SELECT o_custkey%20 AS file, min(10+o_orderkey) AS r FROM orders WHERE 10+o_orderkey>25 GROUP BY 1)
    SELECT file, r AS header_row, 5 AS col_no, ((r-10)%24)||':30' AS header FROM low UNION ALL SELECT file, r, 6, 'x'||(r-10) FROM low""")
register("header_candidates", lambda t: I.header_candidates(cells(t)).filter("sheet = 'Registros'").groupBy("file").agg(
    F.count(F.lit(1)).alias("n"), F.min_by("preview", "row_no").alias("first"), F.max_by("row_no", "row_no").alias("last")),
    """SELECT file, count(*) AS n, 'Empresa' AS first, max(row_no) AS last FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_no) AS rn FROM (
      SELECT file, row_no FROM rec WHERE row_no<=25 UNION ALL SELECT DISTINCT file, v.r FROM rec, (VALUES (1),(4)) AS v(r)))
    WHERE rn<=12 GROUP BY file""", rec=_REC)


def _detected(t, overrides=None):
    return I.detect_template(cells(t), overrides)


def _columns(t):
    return _detected(t).columns


register("column_samples", lambda t: _with_rows(t, I.column_samples).filter("sheet = 'Registros' and col_no = 0").select(
    "file", "rank", "sample"),
    """SELECT file, row_number() OVER (PARTITION BY file ORDER BY r, v) AS rank, v AS sample FROM (
      SELECT file, v, min(row_no) AS r FROM (SELECT file, row_no, common_name AS v FROM rec) WHERE v IS NOT NULL GROUP BY file, v) QUALIFY rank<=3""", rec=_REC)
register("detect_columns", lambda t: _columns(t).filter("sheet <> 'Especies'").groupBy("sheet", "header", "field_id", "omitted").agg(F.count(F.lit(1)).alias("n")),
         """SELECT s.sheet, s.header, CASE WHEN s.numeric THEN NULL ELSE m.field_id END AS field_id, s.omitted,
    (SELECT count(DISTINCT o_custkey%20) FROM orders) AS n FROM (VALUES """ + ", ".join(
             [f"('Registros','{h}',false,NULL)" for h in HEADERS]
             + [f"('Estaciones','{h}',{'true' if h == 'Region' else 'false'},{chr(39) + 'correlativo' + chr(39) if h == 'N' else 'NULL'})" for h in STATION_HEADERS])
         + ") AS s(sheet,header,numeric,omitted) LEFT JOIN matched m ON m.header=s.header", **_HV)
register("classify_sheet", lambda t: _with_rows(t, I.import_sheets, "import"),
         """SELECT DISTINCT o_custkey%20 AS file, s.sheet, s.r AS role FROM orders,
    (VALUES ('Registros','registros'),('Estaciones','estaciones'),('Especies','catalogo_especies')) AS s(sheet,r)""")
register("guess_scope", lambda t: _detected(t).sheets.select("file", "sheet", "scope", "ignored"),
         """SELECT DISTINCT o_custkey%20 AS file, s.sheet, s.r AS scope, false AS ignored FROM orders,
    (VALUES ('Registros','registros'),('Estaciones','estaciones'),('Especies','registros')) AS s(sheet,r)""")
register("template_gaps", lambda t: I.template_gaps(_detected(t).sheets).select(
    "file", "total_columns", F.size("missing").alias("n_missing")),
    f"""SELECT DISTINCT o_custkey%20 AS file, {len(HEADERS) + len(STATION_HEADERS) + len(SPECIES_HEADERS)} AS total_columns,
    {len(CORE_FIELDS) - 7} AS n_missing FROM orders""")
def _template(t):
    found = _detected(t)
    return I.template_from_detection(found.columns, found.sheets, found.preamble)


register("template_from_detection", lambda t: _template(t).select(
    "file", "sheet", "scope", F.array_join("columns.header", "|").alias("headers")),
    f"""SELECT DISTINCT o_custkey%20 AS file, s.sheet, s.r AS scope, s.h AS headers FROM orders,
    (VALUES ('Registros','registros','{'|'.join(HEADERS)}'),('Estaciones','estaciones','{'|'.join(STATION_HEADERS)}'),
    ('Especies','registros','{'|'.join(SPECIES_HEADERS)}')) AS s(sheet,r,h)""")
register("template_preamble", lambda t: _template(t).select("file", "sheet", F.posexplode(F.coalesce("preamble", F.array().cast("array<array<string>>"))).alias("at", "cells")).select(
    "file", "sheet", (F.col("at") + 1).alias("row_no"), F.array_join("cells", "|").alias("cells")),
    """SELECT DISTINCT o_custkey%20 AS file, s.sheet, s.r AS row_no, s.c AS cells FROM orders,
    (VALUES ('Registros',1,'Empresa'),('Registros',2,''),('Registros',3,''),('Estaciones',1,'')) AS s(sheet,r,c)""")


def _corrections(t):
    """Each third file: its species list isn't used; its records are samplings; its record sheet has its header in the first row, and counts."""
    third = F.col("o_custkey") % 20 % 3
    pick_ = lambda a, b, c: F.when(third == 0, a).when(third == 1, b).otherwise(c)
    none = F.lit(None)
    return t.raw("orders").select(
        (F.col("o_custkey") % 20).alias("file"), pick_(F.lit("Especies"), F.lit("Registros"), F.lit("Registros")).alias("sheet"),
        pick_(none, none, F.lit(1)).cast("bigint").alias("header_row"), pick_(none, F.lit("muestreos"), F.lit("plan")).alias("scope"),
        pick_(F.lit(False), none, F.lit(True)).alias("use")).distinct()


register("detect_overrides", lambda t: _detected(t, _corrections(t)).sheets.select("file", "sheet", "header_row", "scope", "ignored", "n_columns"),
    f"""SELECT DISTINCT f AS file, s.sheet, CASE WHEN o AND f%3=2 THEN 1 ELSE s.r END AS header_row,
    CASE WHEN o AND f%3=1 THEN 'muestreos' WHEN o AND f%3=2 THEN 'plan' ELSE s.scope END AS scope, o AND f%3=0 AS ignored,
    CASE WHEN o AND f%3=2 THEN 1 ELSE s.n END AS n_columns FROM (
      SELECT o_custkey%20 AS f, s.*, sheet=CASE WHEN o_custkey%20%3=0 THEN 'Especies' ELSE 'Registros' END AS o FROM orders,
      (VALUES ('Registros',4,'registros',{len(HEADERS)}),('Estaciones',2,'estaciones',{len(STATION_HEADERS)}),('Especies',1,'registros',{len(SPECIES_HEADERS)})) AS s(sheet,r,scope,n)) s""")
register("resolve_taxa", lambda t: I.resolve_taxa(cells(t).filter("sheet = 'Registros' and col_no = 0 and row_no > 4").withColumnRenamed("value", "common_name"), keys(t)).filter(
    "common_name <> '-'"),
    "SELECT DISTINCT common_name, hits, taxon_id FROM imp", rec=_REC, imp=_IMP)


def _imported(t):
    c = cells(t)
    return I.import_records(c, I.detect_header_row(c, "import"), keys(t))


register("import_records", lambda t: _imported(t).select(
    "file", "row_no", "common_name", "taxon_id", "event_date", "event_time", "station_code", "individual_count", "record_type"),
    "SELECT file, row_no, common_name, taxon_id, event_date, event_time, station_code, individual_count, record_type FROM imp", rec=_REC, imp=_IMP)
_ISS = """SELECT file, row_no, 'Nombre común' AS col, CASE WHEN hits=0 THEN 'error' ELSE 'warning' END AS severity FROM imp WHERE hits<>1
  UNION ALL SELECT file, row_no, 'Fecha', 'error' FROM imp WHERE event_date IS NULL
  UNION ALL SELECT file, row_no, 'ID Estación', 'error' FROM imp WHERE station_code IS NULL
  UNION ALL SELECT file, row_no, 'Registro', 'warning' FROM imp WHERE record_type='Avistaje'"""
register("import_issues", lambda t: I.import_issues(_imported(t), V.RECORD_TYPES).select("file", "row_no", F.col("column").alias("col"), "severity"),
         "SELECT * FROM iss", rec=_REC, imp=_IMP, iss=_ISS)


def _verdict(t):
    """The records are written once; counts and issues read them, not the cells."""
    from fieldtally.session import written

    records = written(_imported(t).select(*I.ISSUE_COLUMNS), "imported")
    return I.import_verdict(records, I.import_issues(records, V.RECORD_TYPES))


register("import_verdict", _verdict,
         """SELECT file, records, coalesce(n,0) AS errors, coalesce(n,0)=0 AS can_import FROM (SELECT file, count(*) AS records FROM imp GROUP BY file)
    LEFT JOIN (SELECT file, count(*) AS n FROM iss WHERE severity='error' GROUP BY file) USING (file)""", rec=_REC, imp=_IMP, iss=_ISS)
register("import_stations", lambda t: _with_rows(t, I.import_stations, "import").select(
    "file", "row_no", "station_code", "final_code", "region", "habitat", "utm_east", "utm_north"),
    """SELECT s_suppkey%20 AS file, 5+s_suppkey AS row_no, 'EM'||s_suppkey AS station_code, 'EM'||s_suppkey AS final_code,
    CAST(NULL AS VARCHAR) AS region, 'Bosque' AS habitat, 3e5+s_suppkey AS utm_east, 63e5+s_suppkey+5e-1 AS utm_north FROM supplier""")
register("detect_species_sheet", lambda t: I.detect_species_sheet(cells(t)),
         """SELECT file, CASE WHEN nr>ns THEN 'Registros' ELSE 'Especies' END AS sheet, 1 AS header_row, ns AS named_rows FROM (
      SELECT p_partkey%20 AS file, count(*) FILTER (p_partkey%3<>0 OR p_partkey%5<>0) AS ns, -1 AS nr FROM part GROUP BY 1)""")


def _red_cells(t):
    """A red list of the parts, two processes per name, with its official headers."""
    heads = ["NOMBRE CIENTÍFICO\n(válido)", "NOMBRE COMÚN", "CATEGORÍA VIGENTE", "NÚMERO PROCESO RCE", "ENDÉMICA", "CLASE"]
    p = F.col("p_partkey")
    category = pick(["CR", "vu", "EN (JF); LC (Chile)", "Nombre NO válido; sinónimo", None, "EN-R"], p % 6)
    body = t.raw("part").select(
        (p + 2).alias("row_no"),
        F.posexplode(F.array(F.concat_ws(" ", "p_brand", "p_type"), F.col("p_name"), category,
                             F.concat(F.lit("Proceso "), (p % 4).cast("string")), F.when(p % 2 == 0, "Sí").otherwise("No"), F.lit("Aves"))).alias("col_no", "value"))
    head = t.raw("part").agg(F.max("p_partkey")).select(
        F.lit(1).cast("bigint").alias("row_no"), F.posexplode(F.array(*map(F.lit, heads))).alias("col_no", "value"))
    return body.unionByName(head).withColumns({"file": F.lit("nomina"), "sheet": F.lit("Especies")})


_NOM = """SELECT *, row_number() OVER (PARTITION BY sci ORDER BY coalesce(pr,0) DESC, p_partkey DESC) AS rn FROM (
  SELECT p_partkey, p_brand||' '||p_type AS sci, (['CR','vu','EN (JF); LC (Chile)','Nombre NO válido; sinónimo',NULL,'EN-R'])[p_partkey%6+1] AS category,
  nullif(p_partkey%4,0) AS pr, p_partkey%2=0 AS endemic FROM part)"""
register("read_nomina", lambda t: I.read_nomina(I.red_list_rows(_red_cells(t)))["species"].select(
    "scientific_name", "category", "code", "composite", "synonym", "process", "endemic"),
    """SELECT sci AS scientific_name, category, CASE WHEN upper(category) IN ('CR','VU','EN-R') THEN upper(category) END AS code,
    category IS NOT NULL AND upper(category) NOT IN ('CR','VU','EN-R') AS composite, coalesce(category LIKE '%NO v%',false) AS synonym, pr AS process, endemic
    FROM nom WHERE rn=1""", nom=_NOM)
register("nomina_duplicates", lambda t: I.read_nomina(I.red_list_rows(_red_cells(t)))["resolved"],
         """SELECT a.sci AS scientific_name, coalesce(a.category,'—')||' (proceso '||coalesce(CAST(a.pr AS VARCHAR),'?')||')' AS discarded,
    coalesce(b.category,'—')||' (proceso '||coalesce(CAST(b.pr AS VARCHAR),'?')||')' AS kept FROM nom a JOIN nom b ON a.sci=b.sci AND b.rn=1 WHERE a.rn>1""", nom=_NOM)
register("nomina_summary", lambda t: I.nomina_summary(I.read_nomina(I.red_list_rows(_red_cells(t)))["species"]),
         """SELECT count(*) AS total, count(category) AS with_category, count(*) FILTER (category LIKE 'EN (%') AS composite,
    count(*) FILTER (category LIKE 'Nombre%') AS synonyms, count(*) FILTER (upper(category) IN ('CR','VU','EN-R')) AS threatened FROM nom WHERE rn=1""", nom=_NOM)

def _as_files(t, rows, kind):
    """Rows as CSV files with a header and comment lines, as the catalogues are kept."""
    from fieldtally.session import shared_folder

    path = shared_folder(t.spark, kind)
    rows.write.csv(path, header=True, escape='"', emptyValue="")
    return path


def _typed_files(t):
    """The workbooks' cells as CSV files with their types: counts as numbers with a decimal part, ISO dates as dates, a spoilt cell."""
    c = _cells(t)
    day, count = F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$"), (F.col("sheet") == "Registros") & (F.col("col_no") == 3) & (F.col("row_no") > 4)
    kind = F.when(day, "d").when(count, "n").when(F.col("value") == "s/f", "e").otherwise("text")
    value = F.when(day, F.concat("value", F.lit("T00:00:00"))).when(count, F.concat("value", F.lit(".0"))).otherwise(F.col("value"))
    path = _as_files(t, c.select("file", "sheet", "row_no", "col_no", value.alias("value"), kind.alias("value_type")), "cells-csv")
    return X.read_cells(t.spark, path)


register("cells", lambda t: _typed_files(t).groupBy("sheet", "value_type").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("value").alias("different")),
    """SELECT sheet, kind AS value_type, count(*) AS cells, count(DISTINCT v) AS different FROM (
      SELECT 'Registros' AS sheet, unnest(['s','d','s','n','s','s','s']) AS kind, unnest([CASE WHEN k%9=0 THEN '-' ELSE common_name END,
        CASE WHEN k%6>=3 THEN event_date||'T00:00:00' END, station_code, CAST(k%12 AS VARCHAR), record_type, (k%24)||':30', 'x'||k]) AS v FROM rec
      UNION ALL SELECT 'Registros', 's', CAST(day(o_orderdate) AS VARCHAR)||'/'||month(o_orderdate)||'/'||year(o_orderdate) FROM orders WHERE o_orderkey%6 IN (1,2)
      UNION ALL SELECT 'Registros', 's', h FROM (SELECT DISTINCT file FROM rec), (SELECT unnest(%s) AS h)
      UNION ALL SELECT 'Registros', 's', 'Empresa' FROM (SELECT DISTINCT file FROM rec)
      UNION ALL SELECT 'Estaciones', 's', unnest(['EM'||s_suppkey, '0', CAST(300000+s_suppkey AS VARCHAR), (6300000+s_suppkey)||',5', 'Bosque', CAST(s_suppkey AS VARCHAR)]) FROM supplier
      UNION ALL SELECT 'Estaciones', 's', h FROM (SELECT DISTINCT file FROM rec), (SELECT unnest(%s) AS h)
      UNION ALL SELECT 'Especies', 's', unnest([CASE WHEN p_partkey%%3<>0 THEN p_name END, CASE WHEN p_partkey%%5<>0 THEN p_brand||' '||p_type END, 'Chordata', p_type, CAST(p_partkey AS VARCHAR)]) FROM part
      UNION ALL SELECT 'Especies', 's', h FROM (SELECT DISTINCT file FROM rec), (SELECT unnest(%s) AS h))
    WHERE v IS NOT NULL GROUP BY ALL""".replace("k%9", "k%%9").replace("k%6", "k%%6").replace("k%12", "k%%12").replace("k%24", "k%%24").replace(
        "o_orderkey%6", "o_orderkey%%6") % (HEADERS, STATION_HEADERS, SPECIES_HEADERS), rec=_REC)
register("import_typed_cells", lambda t: I.import_records(c := _typed_files(t), I.detect_header_row(c, "import"), keys(t)).select(
    "file", "row_no", "common_name", "event_date", "event_time", "individual_count"),
    "SELECT CAST(file AS VARCHAR) AS file, row_no, common_name, event_date, event_time, individual_count FROM imp", rec=_REC, imp=_IMP)

# --- catalogue files ---


def _species_rows(t):
    p = F.col("p_partkey")
    return t.raw("part").select(
        F.col("p_name").alias("nombre comun"),
        F.when(p % 3 == 0, F.lower("p_type")).otherwise(F.concat_ws(" ", "p_type", F.lower("p_brand"))).alias("nombre cientifico"),
        pick(["Aves", "mamíferos", "Reptilia", "Insectos"], p % 4).alias("clase"), F.lit("").alias("orden"),
        F.when(p % 5 == 0, F.concat("p_brand", F.lit("; "), "p_type")).otherwise("").alias("nombres alternativos"))


register("read_taxon_csv", lambda t: K.taxa_from_rows(_species_rows(t)).select(
    "common_name", "scientific_name", "genus", "specific_epithet", "taxon_rank", "tax_group", "is_placeholder", "ambiguous",
    F.size("other_names").alias("n_other")),
    """SELECT p_name AS common_name, sci AS scientific_name, string_split(sci,' ')[1] AS genus, nullif(string_split(sci,' ')[2],'') AS specific_epithet,
    CASE WHEN p_partkey%3=0 THEN 'genus' ELSE 'species' END AS taxon_rank, (['aves','mamiferos','reptiles','otros'])[p_partkey%4+1] AS tax_group,
    false AS is_placeholder, count(*) OVER (PARTITION BY p_name)>1 AS ambiguous, CASE WHEN p_partkey%5=0 THEN 2 ELSE 0 END AS n_other
    FROM (SELECT *, CASE WHEN p_partkey%3=0 THEN lower(p_type) ELSE p_type||' '||lower(p_brand) END AS sci FROM part)
    UNION ALL SELECT n, NULL, NULL, NULL, r, g, true, false, 0 FROM (VALUES ('Ave no identificada','class','aves'),('Rapaz no identificada','class','aves'),
    ('Mamífero no identificado','class','mamiferos'),('Roedor no identificado','order','mamiferos'),('Quiróptero no identificado','order','mamiferos'),
    ('Reptil no identificado','class','reptiles'),('Lagartija no identificada','order','reptiles'),('Anfibio no identificado','order','anfibios')) AS v(n,r,g)""")


def _station_rows(t):
    s = F.col("s_suppkey")
    return t.raw("supplier").select(
        F.when(s % 11 != 0, F.col("s_name")).otherwise("").alias("id estacion"), F.lit("").alias("proyecto"),
        F.concat((300000 + s).cast("string"), F.lit(",5")).alias("utm este"), F.lit("n/d").alias("utm norte"),
        pick(["si", "S", "no", "x"], s % 4).alias("transecto"), F.when(s % 2 == 0, "TRUE").otherwise("0").alias("camara trampa"))


register("read_station_csv", lambda t: K.stations_from_rows(_station_rows(t)).select(
    "station_code", "final_code", "project", "utm_east", "utm_north", F.array_join("methods", ",").alias("methods")),
    """SELECT s_name AS station_code, s_name AS final_code, 'Proyecto' AS project, 3e5+s_suppkey+5e-1 AS utm_east, CAST(NULL AS DOUBLE) AS utm_north,
    concat_ws(',', CASE WHEN s_suppkey%4<>2 THEN 'transecto' END, CASE WHEN s_suppkey%2=0 THEN 'camara_trampa' END) AS methods FROM supplier WHERE s_suppkey%11<>0""")


def _list_rows(t):
    p = F.col("p_partkey")
    return t.raw("part").select(
        p.alias("row_no"), F.upper(F.concat_ws("  ", "p_brand", F.when(p % 10 == 0, F.lit("AUSENTE")).otherwise(F.col("p_type")))).alias("especie"),
        pick(["cr", "LC", "ZZ"], p % 3).alias("categoria"), pick(["Si", "no", ""], p % 3).alias("endemica"))


_LIST = """SELECT upper(p_brand)||' '||CASE WHEN p_partkey%10=0 THEN 'AUSENTE' ELSE p_type END AS k, arg_max((['CR','LC','-'])[p_partkey%3+1], p_partkey) AS c,
  arg_max(p_partkey%3, p_partkey) AS m FROM part GROUP BY 1"""
register("load_conservation", lambda t: K.load_conservation(t.taxon, K.conservation_rows(_list_rows(t), default_source="lista")).select(
    "taxon_id", "rce", "endemic", "conservation_source", "listed"),
    """SELECT taxon_id, nullif(c,'-') AS rce, CASE m WHEN 0 THEN true WHEN 1 THEN false END AS endemic, CASE WHEN k IS NOT NULL THEN 'lista' END AS conservation_source,
    k IS NOT NULL AS listed FROM taxon LEFT JOIN list ON k=upper(scientific_name)""", list=_LIST)
register("conservation_report", lambda t: K.conservation_report(t.taxon, K.conservation_rows(_list_rows(t), default_source="lista")),
         """SELECT count(*) FILTER (k IS NOT NULL) AS matched, count(*) FILTER (c='CR') AS threatened,
    (SELECT count(*) FROM list WHERE k NOT IN (SELECT upper(scientific_name) FROM taxon)) AS unmatched
    FROM taxon LEFT JOIN list ON k=upper(scientific_name)""", list=_LIST)
register("preserve_conservation", lambda t: K.preserve_conservation(
    t.taxon.select("taxon_id", "common_name", F.upper("scientific_name").alias("scientific_name"), *[F.lit(None).cast("string").alias(c) if c not in (
        "endemic", "migratory") else F.lit(None).cast("boolean").alias(c) for c in K.STATUS_COLUMNS]), t.taxon).select("taxon_id", "rce", "origin", "preserved"),
    """SELECT t.taxon_id, x.rce, x.origin, true AS preserved FROM taxon t JOIN (SELECT lower(scientific_name) AS k, max(taxon_id) AS id FROM taxon GROUP BY 1) m
    ON m.k=lower(t.scientific_name) JOIN taxon x ON x.taxon_id=m.id""")


def _pieces(t):
    """KML text derived from the GPS points: one placemark per point, a folder every hundred."""
    e = F.col("point_id")
    head = F.when(e % 100 == 0, F.concat(F.when(e > 0, F.lit("</Folder>")).otherwise(""), F.lit('<Folder id="f"><name>Dia '), F.floor(e / 100).cast("string"), F.lit("</name>"))).otherwise("")
    coords = F.concat_ws(",", F.lit("-71.5"), F.round("lat", 4).cast("string"), F.lit("12"))
    body = F.when(e % 3 == 0, F.concat(F.lit("<Point><coordinates>"), coords, F.lit("</coordinates></Point>"))).otherwise(
        F.concat(F.lit("<LineString><coordinates>"), coords, F.lit(" x,y -71.5,95,0 -71.4,-33.1</coordinates></LineString>")))
    text = F.concat(head, F.lit('<Placemark id="p"><name>A &amp; '), e.cast("string"), F.lit("</name>"), body)
    return t.track_point.select(F.lit("mapa.kml").alias("file"), F.lit(0).cast("long").alias("block"), e.alias("piece"), text.alias("value"))


register("read_kml", lambda t: X.placemarks(_pieces(t)).select(
    "placemark_no", "name", "folder", "kind", F.size("points").alias("n"), F.element_at("points", 1)["lon"].alias("lon")),
    """SELECT event_id AS placemark_no, 'A & '||event_id AS name, 'Dia '||(event_id//100) AS folder, CASE WHEN event_id%3=0 THEN 'punto' ELSE 'linea' END AS kind,
    CASE WHEN event_id%3=0 THEN 1 ELSE 2 END AS n, -71.5e0 AS lon FROM events""")


def _map_files(t):
    """The same placemarks as real files of a thousand each, written to the shared folder and read back."""
    from fieldtally.session import shared_folder

    path = shared_folder(t.spark, "maps")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda p: F.concat(p["value"], F.lit("</Placemark>"))), "\n")
    body = _pieces(t).groupBy(F.floor(F.col("piece") / 1000).alias("map")).agg(texts.alias("body"))
    # A folder that the map before left open ends there; this one's own last folder ends with the document.
    body = F.concat(F.lit("<kml><Document>"), F.regexp_replace("body", "^</Folder>", ""), F.lit("</Folder></Document></kml>\n")), body
    body[1].select(body[0].alias("value"), "map").write.partitionBy("map").text(path)
    marks = X.read_kml(t.spark, f"{path}/*")
    return marks.select((F.regexp_extract("file", r"map=(\d+)", 1).cast("long") * 1000 + F.col("placemark_no")).alias("placemark_no"), "name", "folder", "kind", F.size("points").alias("n"))


register("read_kml_files", _map_files,
    """SELECT event_id AS placemark_no, 'A & '||event_id AS name, 'Dia '||(event_id//100) AS folder, CASE WHEN event_id%3=0 THEN 'punto' ELSE 'linea' END AS kind,
    CASE WHEN event_id%3=0 THEN 1 ELSE 2 END AS n FROM events""")


register("read_taxon_csv_files", lambda t: K.read_taxon_csv(t.spark, _as_files(t, _species_rows(t), "species-csv")).filter("not is_placeholder").select(
    "common_name", "scientific_name", "genus", "taxon_rank", "tax_group", "ambiguous", F.size("other_names").alias("n_other")),
    """SELECT p_name AS common_name, sci AS scientific_name, string_split(sci,' ')[1] AS genus,
    CASE WHEN p_partkey%3=0 THEN 'genus' ELSE 'species' END AS taxon_rank, (['aves','mamiferos','reptiles','otros'])[p_partkey%4+1] AS tax_group,
    count(*) OVER (PARTITION BY p_name)>1 AS ambiguous, CASE WHEN p_partkey%5=0 THEN 2 ELSE 0 END AS n_other
    FROM (SELECT *, CASE WHEN p_partkey%3=0 THEN lower(p_type) ELSE p_type||' '||lower(p_brand) END AS sci FROM part)""")
register("read_station_csv_files", lambda t: K.read_station_csv(t.spark, _as_files(t, _station_rows(t), "station-csv")).select(
    "station_code", "project", "utm_east", F.array_join("methods", ",").alias("methods")),
    """SELECT s_name AS station_code, 'Proyecto' AS project, 3e5+s_suppkey+5e-1 AS utm_east,
    concat_ws(',', CASE WHEN s_suppkey%4<>2 THEN 'transecto' END, CASE WHEN s_suppkey%2=0 THEN 'camara_trampa' END) AS methods FROM supplier WHERE s_suppkey%11<>0""")


def _list_files(t):
    """The list read from files: its row numbers are the order of its lines, kept as a column of their own."""
    rows = K.read_rows(t.spark, _as_files(t, _list_rows(t), "status-csv"))
    return K.conservation_rows(rows.withColumnRenamed("row no", "row_no").withColumn("row_no", F.col("row_no").cast("long")), default_source="lista")


register("load_conservation_files", lambda t: K.load_conservation(t.taxon, _list_files(t)).select("taxon_id", "rce", "endemic", "conservation_source", "listed"),
    """SELECT taxon_id, nullif(c,'-') AS rce, CASE m WHEN 0 THEN true WHEN 1 THEN false END AS endemic, CASE WHEN k IS NOT NULL THEN 'lista' END AS conservation_source,
    k IS NOT NULL AS listed FROM taxon LEFT JOIN list ON k=upper(scientific_name)""", list=_LIST)
register("dropped_categories", lambda t: K.dropped_categories(_list_rows(t)),
    "SELECT 'rce' AS list, 'ZZ' AS category, count(*) AS rows FROM part WHERE p_partkey%3=2 HAVING count(*)>0")
