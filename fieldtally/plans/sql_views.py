"""SQL twins of ``views``: common table expressions over the same parquet tables.

``compose`` prepends the views a statement mentions, and theirs. Decimals are written with an
exponent so that both engines compute in doubles.
"""

from __future__ import annotations

import re


def pick(values: list, index: str) -> str:
    whens = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"(CASE {index} {whens} END)"


def hhmm(minute: str) -> str:
    return f"(lpad(CAST(({minute})//60 AS VARCHAR),2,'0')||':'||lpad(CAST(({minute})%60 AS VARCHAR),2,'0'))"


def code(k: str) -> str:
    return f"('EM'||lpad(CAST({k} AS VARCHAR),4,'0'))"


_METHOD = pick(
    ["transecto", "camara_trampa", "trampa_sherman", "playback_aves", "punto_conteo", "transito_aereo",
     "registro_oportunista"], "o_orderkey%7")
_RTYPE = pick(
    ["Individuo", "Vocalización", "Fecas", "Huella", "Nido", "Registro de audio", "Madriguera"], "l_linenumber%7")

_OID = ("concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,"
        " CAST(floor(l_extendedprice*1e2+5e-1) AS BIGINT))")

VIEWS: dict[str, str] = {
    "station": f"""SELECT s_suppkey AS station_id, s_suppkey%3 AS project_id, {code('s_suppkey')} AS station_code,
  'urn:survey:p-'||(s_suppkey%3)||':loc:'||lower({code('s_suppkey')}) AS dwc_location_id,
  CASE WHEN s_suppkey%4<>0 THEN 'Region '||(s_suppkey%5) END AS region, 'Sector '||(s_suppkey%7) AS sector,
  CASE WHEN s_suppkey%2=0 THEN 'Verano' ELSE 'Invierno' END AS season,
  {pick(['Bosque','Matorral','Pradera'],'s_suppkey%3')} AS habitat,
  {pick(['Norte','Sur'],'s_suppkey%2')} AS slope_aspect,
  CASE WHEN s_suppkey%6<>0 THEN 3e5+s_suppkey END AS utm_east,
  CASE WHEN s_suppkey%6<>0 THEN 63e5+s_suppkey*2 END AS utm_north,
  -33e0-(s_suppkey%10)*4e-3 AS lat,
  -71e0-((s_suppkey%100)//10)*4e-3-(s_suppkey//100)*4e-2 AS lon,
  CASE WHEN s_suppkey%9<>0 THEN 'Jefe'||(s_suppkey%4) END AS station_recorded_by,
  'Exp'||(s_suppkey%3) AS identified_by FROM supplier""",
    "grid": """SELECT station_id, station_code, project_id, m.method FROM station,
  (VALUES ('transecto',1),('camara_trampa',2),('trampa_sherman',3),('playback_aves',5),('punto_conteo',7)) AS m(method,k)
  WHERE station_id%m.k=0""",
    "project": """SELECT DISTINCT s_suppkey%3 AS project_id, 'P-'||(s_suppkey%3) AS project_code,
  'Proyecto '||(s_suppkey%3) AS project_name, CASE WHEN s_suppkey%3=1 THEN 'Cliente 1' END AS client,
  'Region P'||(s_suppkey%3) AS project_region, 19 AS utm_zone FROM supplier""",
    "campaign": """SELECT DISTINCT (s_suppkey%3)*2+h.half AS campaign_id, s_suppkey%3 AS project_id,
  'Campaña '||((s_suppkey%3)*2+h.half) AS campaign_name, CASE WHEN h.half=0 THEN 'Verano' END AS campaign_season
  FROM supplier, (VALUES (0),(1)) AS h(half)""",
    "taxon": f"""SELECT p_partkey AS taxon_id, p_name AS common_name, p_brand||' '||p_type AS scientific_name,
  {pick(['Aves','Mammalia','Reptilia','Amphibia','Insecta'],'p_partkey%5')} AS tax_class,
  CASE WHEN p_size%4=0 THEN 'Rodentia' ELSE 'Carnivora' END AS tax_order, p_type AS family, p_brand AS genus,
  {pick(['aves','mamiferos','reptiles','anfibios','otros'],'p_partkey%5')} AS tax_group,
  p_partkey%13=0 AS is_placeholder,
  {pick(['CR','EN','VU','NT','LC','LC','LC','LC','DD','EN (JF); LC (Chile)',None,None],'p_partkey%12')} AS rce,
  CASE WHEN p_partkey%8=0 THEN 'LC' END AS iucn,
  CASE WHEN p_partkey%6=0 THEN 'Exótica' WHEN p_partkey%6=1 THEN 'Endémica' ELSE 'Nativa' END AS origin,
  p_partkey%6=1 AS endemic, p_partkey%7=0 AS migratory,
  CASE WHEN p_partkey%10=0 THEN 'Ley de Caza' END AS legal_protection,
  CASE WHEN p_partkey%4=0 THEN 'DS 1/2020' END AS rce_decree,
  CASE WHEN p_partkey%3<>0 THEN 'Lista '||(p_partkey%4) END AS conservation_source FROM part""",
    "flag": """SELECT *, CASE cat WHEN 'EX' THEN 'Extinta' WHEN 'EW' THEN 'Extinta en estado silvestre'
    WHEN 'RE' THEN 'Extinta regionalmente' WHEN 'CR' THEN 'En peligro crítico' WHEN 'EN' THEN 'En peligro'
    WHEN 'VU' THEN 'Vulnerable' WHEN 'NT' THEN 'Casi amenazada' WHEN 'LC' THEN 'Preocupación menor'
    WHEN 'DD' THEN 'Datos insuficientes' WHEN 'NE' THEN 'No evaluada' ELSE cat END AS cat_label,
  CASE WHEN cat='' THEN 'sin-clasificar' WHEN cat IN ('EX','EW','RE','CR','EN','VU') THEN 'amenazada'
    WHEN cat='NT' THEN 'casi-amenazada' ELSE 'sin-riesgo' END AS level,
  cat IN ('EX','EW','RE','CR','EN','VU') AS threatened, origin='Exótica' AS exotic,
  cat IN ('EX','EW','RE','CR','EN','VU') OR (endemic AND cat='NT') AS sensitive,
  CASE WHEN cat<>'' THEN cat||' · '||cat_label||CASE WHEN rce IS NOT NULL THEN ' (RCE)' ELSE ' (UICN)' END END AS badge,
  CASE WHEN tax_group IN ('reptiles','anfibios') THEN 'baja' WHEN tax_group='aves' THEN 'alta'
    WHEN tax_group='mamiferos' THEN CASE WHEN tax_order='Rodentia' THEN 'baja' ELSE 'alta' END
    ELSE 'desconocida' END AS mobility
  FROM (SELECT *, trim(upper(coalesce(rce,iucn,''))) AS cat FROM taxon)""",
    "event": f"""SELECT o_orderkey AS event_id, o_custkey%(SELECT count(*) FROM supplier) AS station_id,
  (o_custkey%(SELECT count(*) FROM supplier))%3 AS project_id,
  ((o_custkey%(SELECT count(*) FROM supplier))%3)*2+o_orderkey%2 AS campaign_id,
  CASE WHEN o_orderkey%2=0 THEN (o_custkey%(SELECT count(*) FROM supplier))*10 END AS site_id,
  {_METHOD} AS method, strftime(o_orderdate,'%Y-%m-%d') AS event_date, (o_orderkey*37)%1440 AS minute_of_day,
  {hhmm('(o_orderkey*37)%1440')} AS event_time,
  CASE WHEN o_custkey%11<>0 THEN 'Obs'||(o_custkey%5) END AS recorded_by,
  {pick(['Despejado','Nublado',None,'Lluvia'],'o_orderkey%4')} AS weather,
  CASE WHEN o_orderkey%8=0 THEN 'nota' END AS event_notes,
  CASE o_orderpriority WHEN '5-LOW' THEN false WHEN '4-NOT SPECIFIED' THEN NULL ELSE true END AS performed,
  CASE WHEN o_orderpriority='5-LOW' THEN {pick(['camino cortado','lluvia'],'o_orderkey%2')} END AS not_performed_reason,
  o_orderstatus='P' AND o_orderkey%4=0 AS no_detections,
  o_orderkey%7=6 AS incidental,
  CASE WHEN o_orderkey%31=0 THEN o_orderdate END AS deleted_at,
  o_orderkey%6<>0 AS started,
  CASE WHEN o_orderkey%6<>0 THEN 20+o_orderkey%100 END AS duration_min,
  CASE WHEN o_orderkey%4<>0 THEN CAST(floor(o_totalprice/100) AS BIGINT) END AS distance_m,
  CASE WHEN o_orderkey%7 IN (1,2) AND o_orderkey%5<>0 THEN 10+o_orderkey%9 END AS trap_nights,
  CASE WHEN o_orderkey%3=0 THEN o_orderkey%30 END AS temperature_c,
  CASE WHEN o_orderkey%5=0 THEN o_orderkey%12 END AS wind_beaufort,
  CASE WHEN o_orderkey%7=0 THEN o_orderkey%9 END AS cloud_octas,
  CASE WHEN o_orderkey%11=0 THEN 'Llovizna' END AS precipitation,
  CASE WHEN o_orderkey%10<>0 THEN o_orderkey%40 END AS device_accuracy_m FROM orders""",
    "live_event": "SELECT * FROM event WHERE deleted_at IS NULL",
    "effort": """SELECT *, CASE WHEN e.method IN ('transecto','registro_oportunista') THEN 'distancia'
    WHEN e.method IN ('camara_trampa','trampa_sherman') THEN 'trampas-noche'
    WHEN e.method IN ('punto_conteo','playback_aves','transito_aereo') THEN 'duración' ELSE 'sin-esfuerzo' END AS unit,
  (started OR distance_m IS NOT NULL OR trap_nights IS NOT NULL) AS measured,
  (started OR distance_m IS NOT NULL OR trap_nights IS NOT NULL) AND
    ((unit='distancia' AND distance_m IS NULL) OR (unit='trampas-noche' AND trap_nights IS NULL)
     OR (unit='duración' AND duration_min IS NULL)) AS incomplete,
  concat_ws(' · ',
    CASE WHEN duration_min IS NULL THEN NULL WHEN duration_min<60 THEN duration_min||' min'
      WHEN duration_min%60=0 THEN (duration_min//60)||' h'
      ELSE (duration_min//60)||' h '||(duration_min%60)||' min' END,
    CASE WHEN unit='distancia' AND distance_m IS NOT NULL THEN CASE WHEN distance_m<1000 THEN distance_m||' m'
      ELSE (((distance_m+5)//10)//100)||','||lpad(CAST(((distance_m+5)//10)%100 AS VARCHAR),2,'0')||' km' END END,
    CASE WHEN unit='trampas-noche' AND trap_nights IS NOT NULL THEN trap_nights||' trampa-noche'||
      CASE WHEN trap_nights=1 THEN '' ELSE 's' END END) AS label_text,
  CASE WHEN label_text<>'' THEN label_text WHEN measured THEN 'esfuerzo incompleto' ELSE 'sin medición de esfuerzo' END AS effort_label
  FROM event AS e""",
    "occurrence": f"""SELECT {_OID} AS occurrence_id, 'urn:survey:occ:'||{_OID} AS dwc_occurrence_id,
  l_orderkey AS event_id, (l_orderkey*37+l_linenumber)%1440 AS occurrence_minute,
  {hhmm('(l_orderkey*37+l_linenumber)%1440')} AS occurrence_time,
  CASE WHEN l_partkey%17<>0 THEN l_partkey%40 END AS taxon_id,
  CASE WHEN l_partkey%17=0 THEN 'sp'||(l_partkey%9) END AS verbatim_taxon,
  {_RTYPE} AS record_type, CASE WHEN l_linenumber%7>=2 THEN 'Indirecto' ELSE 'Directo' END AS evidence_kind,
  CASE WHEN l_linenumber%7<2 AND l_partkey%19<>0 THEN CAST(l_quantity AS BIGINT) END AS individual_count,
  {pick(['Macho','Hembra','Indeterminado',None],'l_partkey%4')} AS sex,
  {pick(['todos','algunos','sin_definir'],'l_suppkey%3')} AS sex_scope,
  {pick(['Adulto','Juvenil',None],'l_partkey%3')} AS life_stage,
  {pick(['sin_definir','algunos','todos'],'l_suppkey%3')} AS life_stage_scope,
  {pick(['Vivo','Muerto',None],'l_suppkey%3')} AS organism_condition,
  CASE WHEN l_suppkey%2=0 THEN 'Posado' END AS behaviour,
  CASE WHEN l_suppkey%5=0 THEN 'nota de terreno' END AS notes,
  CASE WHEN l_partkey%4<>0 THEN -33e0-(l_suppkey%100)*5e-4 END AS fix_lat,
  CASE WHEN l_partkey%4<>0 THEN -71e0-(l_partkey%100)*5e-4 END AS fix_lon,
  CASE WHEN l_partkey%4<>0 AND l_partkey%5<>0 THEN CAST(l_partkey%50 AS DOUBLE) END AS fix_accuracy_m,
  CASE WHEN l_orderkey%7=5 AND l_partkey%3<>0 THEN 5+l_suppkey%80 END AS flight_height_m,
  CASE WHEN l_orderkey%7=5 AND l_partkey%3=0 THEN CAST((l_suppkey%5)+1 AS VARCHAR) END AS flight_height_category,
  CASE WHEN l_orderkey%7=5 THEN {pick(['N','S','E','O'],'l_suppkey%4')} END AS flight_direction,
  CASE WHEN l_orderkey%7=5 AND l_suppkey%2=0 THEN 'S' END AS flight_origin,
  CASE WHEN l_orderkey%7=5 AND l_suppkey%3=0 THEN 'N' END AS flight_destination,
  CASE WHEN l_orderkey%7=5 AND l_suppkey%4=0 THEN 'rotor' END AS flight_height_reference,
  CASE WHEN l_orderkey%7=5 AND l_suppkey%5=0 THEN 'planeo' END AS flight_type, l_partkey AS pk,
  CASE WHEN l_suppkey%6<>0 THEN CAST(l_suppkey%4 AS VARCHAR) END AS batch_id,
  l_suppkey%3 AS media_count,
  CASE WHEN l_partkey%6=0 THEN 'sex, notes' WHEN l_partkey%10=0 THEN 'behaviour' ELSE '' END AS pending_text,
  CASE l_returnflag WHEN 'R' THEN 'seguro' WHEN 'A' THEN 'probable' ELSE 'posible' END AS confidence,
  CASE WHEN l_partkey%8=0 THEN l_partkey%60 END AS detection_distance_m,
  CASE WHEN l_partkey%21=0 THEN 'M-'||(l_partkey%90) END AS organism_id,
  CASE WHEN l_partkey%14=0 THEN 'en celo' END AS reproductive_condition,
  l_partkey%23=0 AS recapture,
  CASE WHEN l_orderkey%7=2 THEN CAST(l_suppkey%20 AS VARCHAR) END AS trap_number,
  CASE WHEN l_linestatus='F' THEN 'validado' ELSE 'terreno' END AS review_state,
  1700000000+l_orderkey*600+(l_suppkey*13+l_linenumber*29)%180 AS created_s,
  CASE WHEN (l_orderkey+l_linenumber)%23=0 THEN l_shipdate END AS deleted_at FROM lineitem""",
    "draft": """SELECT o.occurrence_id AS draft_id, o.* REPLACE (coalesce(individual_count, CASE WHEN pk%10=0 THEN 2 END) AS individual_count,
  CASE WHEN pk%25=0 THEN 'NE' ELSE flight_direction END AS flight_direction), e.method, e.recorded_by, e.weather, e.station_id, e.project_id,
  CASE WHEN e.event_id%5=0 THEN 'Bloque 1' END AS time_block, o.verbatim_taxon AS verbatim_said,
  CASE WHEN o.taxon_id IS NULL AND pk%9<3 THEN 2 ELSE 0 END AS n_candidates, pk%12=0 AS inferred, pk%29=0 AND o.taxon_id IS NOT NULL AS corrected,
  CASE WHEN o.event_id%7=3 AND pk%2=0 THEN 'respondió' END AS playback_response, pk%15=0 AS ack_behaviour,
  t.common_name, t.tax_group, t.rce, t.badge, t.cat_label, t.rce_decree, t.conservation_source, coalesce(t.exotic,false) AS exotic,
  coalesce(t.threatened,false) AS threatened,
  CASE WHEN t.threatened THEN 'especie en categoría de conservación'
    WHEN o.record_type IN ('Fecas','Huella','Madriguera','Nido') THEN lower(o.record_type)||': la evidencia queda en un punto fijo'
    WHEN t.mobility='baja' THEN 'especie de baja movilidad' END AS why
  FROM live_occ o JOIN event e USING (event_id) LEFT JOIN flag t ON t.taxon_id=o.taxon_id""",
    "live_occ": "SELECT * FROM occurrence WHERE deleted_at IS NULL",
    "flat": """SELECT o.*, e.station_id, e.project_id, e.campaign_id, e.site_id, e.method, e.event_date, e.event_time,
  e.recorded_by, e.weather, s.station_code, s.dwc_location_id, s.region, s.habitat, s.lat, s.lon, s.utm_east, s.utm_north,
  s.station_recorded_by, s.identified_by, p.project_name, p.project_region, c.campaign_name, c.campaign_season, s.season,
  t.common_name, t.scientific_name, t.tax_group, t.tax_class, t.tax_order, t.family, t.genus, t.is_placeholder, t.badge,
  t.level, t.sensitive, t.threatened, t.exotic
  FROM live_occ o JOIN event e USING (event_id) LEFT JOIN station s ON s.station_id=e.station_id
  LEFT JOIN project p ON p.project_id=e.project_id LEFT JOIN campaign c ON c.campaign_id=e.campaign_id
  LEFT JOIN flag t ON t.taxon_id=o.taxon_id""",
    "track_point": """SELECT user_id AS track_id, event_id AS point_id,
  CAST(floor(epoch_us(ts)/1000000/600) AS BIGINT) AS t_s, CAST(CAST(floor(value) AS BIGINT)%45 AS DOUBLE) AS acc,
  -33e0+(event_id*7%40)*1e-4 AS lat, -71e0 AS lon FROM events""",
    "photo": f"""SELECT 'IMG_'||event_id AS file, strftime(ts,'%Y-%m-%d %H:%M:%S') AS taken_at,
  CASE WHEN event_id%13<>0 THEN -33e0-(s%10)*4e-3+(event_id%9-4)*8e-4 END AS lat,
  CASE WHEN event_id%13<>0 THEN -71e0-((s%100)//10)*4e-3-(s//100)*4e-2+(event_id%9-4)*8e-4 END AS lon,
  CASE WHEN event_id%5<>0 THEN event_id%50 END AS acc,
  CASE WHEN event_id%7=0 THEN NULL WHEN event_id%11=0 THEN 'XX99'
    WHEN event_id%10=0 THEN {code('(s+n-1)%n')} ELSE {code('s')} END AS label,
  CAST(floor(value) AS BIGINT)%360 AS heading, s AS chosen_station_id
  FROM (SELECT *, user_id%(SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM supplier) AS n FROM events)""",
    "photo_dist": """SELECT p.file, p.lat AS p_lat, st.station_id,
  CAST(floor(2*6371000e0*asin(sqrt(pow(sin(radians(st.lat-p.lat)/2),2)+cos(radians(p.lat))*cos(radians(st.lat))*
    pow(sin(radians(st.lon-p.lon)/2),2)))+5e-1) AS BIGINT) AS d,
  2*6371000e0*asin(sqrt(pow(sin(radians(st.lat-p.lat)/2),2)+cos(radians(p.lat))*cos(radians(st.lat))*
    pow(sin(radians(st.lon-p.lon)/2),2))) AS exact_d
  FROM photo p, station st WHERE p.lat IS NOT NULL""",
    "photo_near": """SELECT file, arg_min(station_id, d*1000000+station_id) AS nearest_station_id, min(d) AS nearest_m
  FROM photo_dist GROUP BY file""",
    "photo_check": """SELECT p.*, n.nearest_station_id, n.nearest_m, l.station_id AS label_id, dl.d AS to_label,
  CASE WHEN trim(coalesce(p.label,''))='' THEN 'sin-etiqueta' WHEN l.station_id IS NULL THEN 'desconocida'
    WHEN dl.d IS NULL THEN 'sin-verificar' WHEN dl.d<=200 OR n.nearest_station_id=l.station_id THEN 'coincide'
    ELSE 'desfasada' END AS status
  FROM photo p LEFT JOIN photo_near n USING (file) LEFT JOIN station l ON lower(l.station_code)=lower(trim(p.label))
  LEFT JOIN photo_dist dl ON dl.file=p.file AND dl.station_id=l.station_id""",
    "journey": """SELECT file, taken_at, lat, lon, heading, coalesce(substr(taken_at,1,10),'sin fecha') AS date,
  CASE WHEN nearest_m<=300 THEN nearest_station_id END AS station_id, nearest_m, status,
  (['N','NE','E','SE','S','SO','O','NO'])[CAST(floor(heading/45e0+5e-1) AS BIGINT)%8+1] AS cardinal FROM photo_check""",
    "change_log": """SELECT user_id AS entity_id, event_id AS seq, ts AS moment,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'review' WHEN 'error' THEN 'delete'
    ELSE 'update' END AS op, value AS payload FROM events""",
    "outbox_item": """SELECT CASE WHEN user_id%3=0 THEN 'event' ELSE 'occurrence' END||':'||user_id AS item_id,
  event_id AS seq, CASE WHEN user_id%3=0 THEN 'event' ELSE 'occurrence' END AS entity, user_id AS entity_id,
  CASE WHEN event_id%9=0 THEN 'delete' ELSE 'upsert' END AS op, ts AS queued_at, event_id%10 AS attempts,
  ts AS next_attempt_at,
  CASE WHEN event_type IN ('view','click') THEN 'ok' WHEN event_type='purchase' THEN 'conflict'
    WHEN event_type='signup' THEN 'retry' ELSE 'error' END AS outcome,
  CASE WHEN event_id%4=0 THEN CASE WHEN event_id%8=0 THEN 'conflicto' ELSE 'sin red' END END AS last_error FROM events""",
    "backup_local": """SELECT o_orderkey AS id, o_custkey AS station_id, strftime(o_orderdate,'%Y-%m-%d') AS event_date,
  o_totalprice AS amount, CASE WHEN o_custkey%11<>0 THEN 'Obs'||(o_custkey%5) END AS recorded_by,
  CASE WHEN o_orderkey%31=0 THEN o_orderdate END AS deleted_at FROM orders WHERE o_orderkey%3<>0""",
    "backup_incoming": """SELECT o_orderkey AS id, o_custkey AS station_id, strftime(o_orderdate,'%Y-%m-%d') AS event_date,
  CASE WHEN o_orderkey%5=0 THEN o_totalprice+1 ELSE o_totalprice END AS amount,
  CASE WHEN o_custkey%11<>0 THEN 'Obs'||(o_custkey%5) END AS recorded_by,
  CASE WHEN o_orderkey%31=0 THEN o_orderdate END AS deleted_at FROM orders WHERE o_orderkey%3<>1""",
    "utterance": f"""SELECT p_partkey AS utterance_id,
  {pick(['cero','un','dos','tres','cuatro','cinco','seis','siete','ocho','nueve'],'p_size%10')}||' '||p_name||' '||
  {pick(['macho','hembra','volando','cantando','fecas'],'p_partkey%5')} AS text FROM part""",
}


def compose(sql: str, **extra: str) -> str:
    """The statement with the views it needs, in dependency order."""
    views = {**VIEWS, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in views.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in needed) + "\n" + sql
