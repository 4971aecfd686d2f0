"""Column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.functions import geo as G
from fieldtally.functions import survey as S
from fieldtally.functions import text as T
from fieldtally.functions import vocab as V
from fieldtally.plans.registry import register

_FOLD = "trim(regexp_replace(strip_accents(lower({c})),'[^a-z0-9]+',' ','g'))"


def _fold(c):
    return _FOLD.format(c=c)


register("fold", lambda t: t.raw("documents").select("doc_id", F.md5(T.fold("text")).alias("key_md5")),
         f"SELECT doc_id, md5({_fold('text')}) AS key_md5 FROM documents")
register("tokenize", lambda t: t.raw("documents").select("doc_id", F.size(T.tokenize("text")).alias("n_tokens"),
                                                         F.get(T.tokenize("text"), F.lit(0)).alias("first_token")),
         f"""SELECT doc_id, CASE WHEN k='' THEN 0 ELSE len(string_split(k,' ')) END AS n_tokens,
    nullif(string_split(k,' ')[1],'') AS first_token FROM (SELECT doc_id, {_fold('text')} AS k FROM documents)""")
register("singular_candidates", lambda t: t.raw("documents").select(F.explode(T.tokenize("text")).alias("word")).distinct().select(
    "word", F.array_join(T.singular_candidates("word"), ",").alias("forms")),
    f"""SELECT w AS word, concat_ws(',', w, CASE WHEN length(w)>3 AND w LIKE '%ces' THEN substr(w,1,length(w)-3)||'z' END,
    CASE WHEN length(w)>3 AND w LIKE '%es' THEN substr(w,1,length(w)-2) END, CASE WHEN length(w)>3 AND w LIKE '%s' THEN substr(w,1,length(w)-1) END) AS forms
    FROM (SELECT DISTINCT unnest(string_split({_fold('text')},' ')) AS w FROM documents) WHERE w<>''""")
register("dwc_ids", lambda t: t.raw("customer").select("c_custkey", S.dwc_id("survey", "c_mktsegment", "occ", "c_custkey").alias("occ_id"),
                                                       S.dwc_id("survey", "c_mktsegment", "loc", "c_name").alias("loc_id")),
         """SELECT c_custkey, 'urn:survey:'||s||':occ:'||c_custkey AS occ_id, 'urn:survey:'||s||':loc:'||n AS loc_id FROM (
      SELECT c_custkey, regexp_replace(regexp_replace(lower(c_mktsegment),'[^a-z0-9]+','-','g'),'^-|-$','','g') AS s,
      regexp_replace(regexp_replace(lower(c_name),'[^a-z0-9]+','-','g'),'^-|-$','','g') AS n FROM customer)""")


def _raw_cells(t):
    """Cell texts of many shapes, derived from the orders."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    value = (
        F.when(k % 8 == 0, "-").when(k % 8 == 1, " 0 ").when(k % 8 == 2, "N/A")
        .when(k % 8 == 3, F.concat(F.lit("$ "), F.regexp_replace(price, r"\.", ",")))
        .when(k % 8 == 4, F.concat(price, F.lit(" m"))).when(k % 8 == 5, F.concat(F.lit("1.2."), price))
        .when(k % 8 == 6, "sin dato").otherwise(F.concat(F.lit("-"), price))
    )
    return t.raw("orders").select(k.alias("k"), value.alias("v"))


_CELLS = """SELECT o_orderkey AS k, CASE o_orderkey%8 WHEN 0 THEN '-' WHEN 1 THEN ' 0 ' WHEN 2 THEN 'N/A'
  WHEN 3 THEN '$ '||replace(p,'.',',') WHEN 4 THEN p||' m' WHEN 5 THEN '1.2.'||p WHEN 6 THEN 'sin dato' ELSE '-'||p END AS v
  FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders)"""
register("clean_cell", lambda t: _raw_cells(t).select("k", T.clean_cell("v").alias("import"), T.clean_cell("v", "template").alias("template"),
                                                      T.clean_cell("v", "catalog").alias("catalog")),
         """SELECT k, CASE WHEN lower(trim(v)) NOT IN ('','-','0','n/a') THEN trim(v) END AS import,
    CASE WHEN lower(trim(v)) NOT IN ('','-','n/a') THEN trim(v) END AS template,
    CASE WHEN trim(v) NOT IN ('','-','--','n/a','N/A') THEN trim(v) END AS catalog FROM raw_cells""", raw_cells=_CELLS)
register("parse_number", lambda t: _raw_cells(t).select("k", T.parse_number("v").alias("n"), T.parse_seed_number("v").alias("seed")),
         """SELECT k, CASE WHEN lower(trim(v)) IN ('','-','0','n/a') THEN NULL WHEN s='' THEN 0 ELSE TRY_CAST(regexp_replace(s,',','.') AS DOUBLE) END AS n,
    CASE WHEN d='' THEN 0 ELSE TRY_CAST(d AS DOUBLE) END AS seed
    FROM (SELECT *, regexp_replace(v,'[^0-9.,-]','','g') AS s, regexp_replace(v,'[^0-9.-]','','g') AS d FROM raw_cells)""", raw_cells=_CELLS)


def _date_cells(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    value = (
        F.when(k % 4 == 0, (F.datediff(d, F.lit("1899-12-30").cast("date"))).cast("string"))
        .when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd HH:mm")).when(k % 4 == 2, F.date_format(d, "d/M/yyyy")).otherwise("ayer")
    )
    minute = (k * 37) % 1440
    when = (
        F.when(k % 3 == 0, (minute / 1440).cast("string"))
        .when(k % 3 == 1, F.concat(F.lit("a las "), F.floor(minute / 60).cast("string"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0")))
        .otherwise("tarde")
    )
    return t.raw("orders").select(k.alias("k"), value.alias("d"), when.alias("h"))


register("excel_date", lambda t: _date_cells(t).select("k", T.excel_date("d").alias("day")),
         "SELECT o_orderkey AS k, CASE WHEN o_orderkey%4<3 THEN strftime(o_orderdate,'%Y-%m-%d') END AS day FROM orders")
register("excel_time", lambda t: _date_cells(t).select("k", T.excel_time("h").alias("hhmm")),
         """SELECT o_orderkey AS k, CASE WHEN o_orderkey%3<2 THEN lpad(CAST(((o_orderkey*37)%1440)//60 AS VARCHAR),2,'0')||':'||
    lpad(CAST(((o_orderkey*37)%1440)%60 AS VARCHAR),2,'0') END AS hhmm FROM orders""")
register("utm_zone", lambda t: t.raw("customer").select("c_custkey", G.utm_zone((F.col("c_custkey") % 360 - 180).cast("double")).alias("zone")),
         "SELECT c_custkey, CAST(floor((c_custkey%360)/6e0) AS INTEGER)+1 AS zone FROM customer")

_E2 = "(1e0/298.257223563e0*(2e0-1e0/298.257223563e0))"
_UTM = f"""SELECT station_id, floor(east*1e2+5e-1)/1e2 AS east, floor((north+1e7)*1e2+5e-1)/1e2 AS north FROM (
  SELECT *, 9996e-4*nu*(a+(1-t+c)*pow(a,3)/6+(5-18*t+t*t+72*c-58*ep2)*pow(a,5)/120)+5e5 AS east,
    9996e-4*(m+nu*tan(phi)*(a*a/2+(5-t+9*c+4*c*c)*pow(a,4)/24+(61-58*t+t*t+600*c-330*ep2)*pow(a,6)/720)) AS north FROM (
  SELECT *, 6378137e0/sqrt(1-e2*pow(sin(phi),2)) AS nu, pow(tan(phi),2) AS t, ep2*pow(cos(phi),2) AS c, cos(phi)*(radians(lon)-radians(-69e0)) AS a,
    6378137e0*((1-e2/4-3*e2*e2/64-5*pow(e2,3)/256)*phi-(3*e2/8+3*e2*e2/32+45*pow(e2,3)/1024)*sin(2*phi)
      +(15*e2*e2/256+45*pow(e2,3)/1024)*sin(4*phi)-35*pow(e2,3)/3072*sin(6*phi)) AS m FROM (
  SELECT station_id, lon, radians(lat) AS phi, {_E2} AS e2, {_E2}/(1e0-{_E2}) AS ep2 FROM station)))"""
register("to_utm", lambda t: t.station.select("station_id", G.to_utm("lat", "lon", F.lit(19)).alias("u")).select(
    "station_id", "u.east", "u.north"), _UTM)
register("from_utm", lambda t: t.station.select("station_id", "lat", "lon", G.to_utm("lat", "lon", F.lit(19)).alias("u")).select(
    "station_id", "lat", "lon", G.from_utm("u.east", "u.north", "u.zone", "u.hemisphere").alias("p")).select(
    "station_id", (G.haversine_m("lat", "lon", "p.lat", "p.lon") < 0.5).alias("round_trip_ok")),
    "SELECT station_id, true AS round_trip_ok FROM station")
register("ensure_latlon", lambda t: G.ensure_latlon(t.station.withColumn("lat", F.when(F.col("station_id") % 2 == 0, F.col("lat"))), 19, "S").select(
    "station_id", F.col("lat").isNotNull().alias("has_lat"), (F.col("station_id") % 2 == 1).alias("was_missing")),
    "SELECT station_id, station_id%2=0 OR utm_east IS NOT NULL AS has_lat, station_id%2=1 AS was_missing FROM station")
register("haversine_m", lambda t: t.occurrence.filter("fix_lat is not null").select("occurrence_id", G.rounded_m(
    "fix_lat", "fix_lon", F.lit(-33.0), F.lit(-71.0)).alias("m")),
    """SELECT occurrence_id, CAST(floor(2*6371000e0*asin(sqrt(pow(sin(radians(-33e0-fix_lat)/2),2)+cos(radians(fix_lat))*cos(radians(-33e0))*
    pow(sin(radians(-71e0-fix_lon)/2),2)))+5e-1) AS BIGINT) AS m FROM occurrence WHERE fix_lat IS NOT NULL""")
register("cardinal_of", lambda t: t.raw("events").select("event_id", S.cardinal_of(F.col("event_id") % 1000 - 500).alias("cardinal")),
         """SELECT event_id, (['N','NE','E','SE','S','SO','O','NO'])[CAST(floor((((event_id%1000-500)%360+360)%360)/45e0+5e-1) AS BIGINT)%8+1] AS cardinal FROM events""")
register("evidence_kind", lambda t: t.occurrence.select("occurrence_id", S.evidence_kind("record_type").alias("kind")),
         "SELECT occurrence_id, evidence_kind AS kind FROM occurrence")

_ALLOWED = " ".join(f"WHEN '{m}' THEN '{','.join(ts)}'" for m, ts in V.RECORD_TYPES_BY_METHOD.items())
register("record_types_for_method", lambda t: t.event.select("event_id", F.array_join(S.record_types_for_method("method"), ",").alias("types")),
         f"SELECT event_id, CASE method {_ALLOWED} ELSE '{','.join(V.RECORD_TYPES)}' END AS types FROM event")
register("impossible_record_type", lambda t: t.flat.filter(S.impossible_record_type("method", "record_type")).select("occurrence_id", "method", "record_type"),
         f"""SELECT occurrence_id, method, record_type FROM flat WHERE NOT list_contains(string_split(
    CASE method {_ALLOWED} ELSE '{','.join(V.RECORD_TYPES)}' END, ','), record_type)""")
register("infer_period", lambda t: t.event.select("event_id", S.infer_period("event_time").alias("period"), S.am_pm("event_time").alias("half")),
         """SELECT event_id, CASE WHEN h>=21 OR h<5 THEN 'Nocturno' WHEN h<8 OR h>=19 THEN 'Crepuscular' ELSE 'Diurno' END AS period,
    CASE WHEN h>11 THEN 'PM' ELSE 'AM' END AS half FROM (SELECT event_id, minute_of_day//60 AS h FROM event)""")
register("am_pm", lambda t: t.occurrence.select("occurrence_id", S.am_pm("occurrence_time").alias("half")),
         "SELECT occurrence_id, CASE WHEN occurrence_minute>=720 THEN 'PM' ELSE 'AM' END AS half FROM occurrence")
register("field_day", lambda t: t.raw("events").groupBy(F.date_format(S.field_day("ts"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")),
         "SELECT strftime(ts-INTERVAL 4 HOUR,'%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
register("days_between", lambda t: t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
    S.days_between("o_orderdate", "l_shipdate").alias("days")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1""")
register("season_of", lambda t: t.event.select("event_id", S.season_of("event_date").alias("season")),
         """SELECT event_id, CASE WHEN m IN (12,1,2) THEN 'Verano' WHEN m<=5 THEN 'Otoño' WHEN m<=8 THEN 'Invierno' ELSE 'Primavera' END AS season
    FROM (SELECT event_id, CAST(substr(event_date,6,2) AS INTEGER) AS m FROM event)""")
_LABELS = ["Inicio", " partida", "TÉRMINO", "llegada ", "mitad", "100", "Cero"]
register("normalize_waypoint_label", lambda t: t.raw("events").select("event_id", S.normalize_waypoint_label(
    F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("event_id") % 7 + 1).cast("int"))).alias("label")),
    "SELECT event_id, (['inicio','inicio','final','final','medio','100','inicio'])[event_id%7+1] AS label FROM events")
register("format_effort", lambda t: t.event.select("event_id", S.format_duration(F.col("event_id") % 500).alias("duration"),
                                                   S.format_distance(F.col("event_id") * 3).alias("distance")),
         """SELECT event_id, CASE WHEN event_id%500<60 THEN (event_id%500)||' min' WHEN (event_id%500)%60=0 THEN ((event_id%500)//60)||' h'
    ELSE ((event_id%500)//60)||' h '||((event_id%500)%60)||' min' END AS duration,
    CASE WHEN event_id*3<1000 THEN (event_id*3)||' m' ELSE ((event_id*3+5)//10)//100||','||lpad(CAST(((event_id*3+5)//10)%100 AS VARCHAR),2,'0')||' km' END AS distance FROM event""")
register("conservation_level", lambda t: t.taxon.select("taxon_id", S.conservation_level("rce", "iucn").alias("level")),
         "SELECT taxon_id, level FROM flag")
register("conservation_flag", lambda t: t.taxon.select("taxon_id", S.conservation_flag().alias("f")).select(
    "taxon_id", "f.badge", "f.detail", F.array_join("f.traits", "|").alias("traits"), "f.sensitive_location"),
    """SELECT taxon_id, badge, CASE WHEN cat<>'' THEN cat_label||coalesce(', '||rce_decree,'')||coalesce(' · fuente: '||conservation_source,'') END AS detail,
    concat_ws('|', CASE WHEN endemic THEN 'Endémica' END, origin, CASE WHEN migratory THEN 'Migratoria' END, legal_protection) AS traits,
    sensitive AS sensitive_location FROM flag""")
register("is_exotic", lambda t: t.taxon.select("taxon_id", S.is_exotic("origin").alias("exotic"), S.is_threatened("rce", "iucn").alias("threatened")),
         "SELECT taxon_id, exotic, threatened FROM flag")
register("is_threatened", lambda t: t.taxon.filter(S.is_threatened("rce", "iucn")).select("taxon_id", "rce"),
         "SELECT taxon_id, rce FROM flag WHERE threatened")
register("mobility_of", lambda t: t.taxon.select("taxon_id", S.mobility_of("tax_group", "tax_order").alias("mobility")),
         "SELECT taxon_id, mobility FROM flag")
_NEED = """SELECT o.occurrence_id, o.record_type, o.confidence, coalesce(t.threatened,false) AS threatened,
  o.record_type IN ('Fecas','Huella','Madriguera','Nido') AS fixed, t.mobility FROM occurrence o LEFT JOIN flag t ON t.taxon_id=o.taxon_id"""
register("location_fix_need", lambda t: t.occurrence.join(t.taxon, "taxon_id", "left").select("occurrence_id", S.location_fix_need(
    "rce", "iucn", "tax_group", "tax_order", "record_type").alias("n")).select("occurrence_id", "n.required", "n.reason"),
    """SELECT occurrence_id, CASE WHEN threatened THEN 'especie en categoría de conservación' WHEN fixed THEN lower(record_type)||': la evidencia queda en un punto fijo'
    WHEN mobility='baja' THEN 'especie de baja movilidad' END AS reason, reason IS NOT NULL AS required FROM need""", need=_NEED)
register("suggests_photo", lambda t: t.occurrence.join(t.taxon, "taxon_id", "left").select("occurrence_id", S.suggests_photo(
    "rce", "iucn", "record_type", "confidence").alias("photo")),
    "SELECT occurrence_id, threatened OR confidence<>'seguro' OR fixed AS photo FROM need", need=_NEED)
register("basis_of_record", lambda t: t.event.select("event_id", S.basis_of_record("method").alias("basis")),
         "SELECT event_id, CASE WHEN method='camara_trampa' THEN 'MachineObservation' ELSE 'HumanObservation' END AS basis FROM event")
register("identification_qualifier", lambda t: t.occurrence.join(t.taxon, "taxon_id", "left").select(
    "occurrence_id", S.identification_qualifier("confidence", "is_placeholder").alias("q")),
    """SELECT occurrence_id, CASE confidence WHEN 'probable' THEN 'cf.' WHEN 'posible' THEN '?' ELSE CASE WHEN t.is_placeholder THEN 'sp.' ELSE '' END END AS q
    FROM occurrence o LEFT JOIN taxon t ON t.taxon_id=o.taxon_id""")
