"""Files in, files out, headers and workbook cells."""

import json
import random

from pyspark.sql import functions as F

from fieldtally.functions.headers import match_headers
from fieldtally.operators import export as X
from fieldtally.operators import intake as I
from fieldtally.operators import spatial as P
from fieldtally.plans.registry import Tables
from fieldtally.sources import catalogs as K
from fieldtally.sources import exchange_files as W

SF = "/root/testdata/sf0.001"

KML = """<?xml version="1.0" encoding="UTF-8"?>
<kml><Document><name>Demo</name>
<Folder id="a"><name>Puntos &amp; m&#225;s</name>
 <Placemark id="1"><name>P1</name><LookAt><longitude>-71.6</longitude></LookAt><Point><coordinates>-71.62,-31.23,0</coordinates></Point></Placemark>
 <Folder><name>Dentro</name>
  <Placemark><name>P2</name><description><![CDATA[Con <b>agua</b>]]></description><Point><coordinates>-71.63,-31.24</coordinates></Point></Placemark>
 </Folder>
 <Placemark><name>P2</name><Point><coordinates>-71.64,-31.25,9</coordinates></Point></Placemark>
</Folder>
<Placemark><name>T1</name><LineString><coordinates>
 -71.62,-31.23,0 bad,x -71.61,-31.23,0 -71.60,-95,0
</coordinates></LineString></Placemark>
<Placemark><name>Zona</name><Polygon><coordinates>-71,-31 -71,-32</coordinates></Polygon></Placemark>
</Document></kml>"""


def test_kml(spark, tmp_path):
    (tmp_path / "m.kml").write_text(KML, encoding="utf8")
    rows = W.read_kml(spark, str(tmp_path))
    got = {(r.name, r.folder, r.kind, len(r.points)) for r in rows.collect()}
    assert got == {("P1", "Puntos & m&#225;s", "punto", 1), ("P2", "Dentro", "punto", 1), ("P2", "Puntos & m&#225;s", "punto", 1),
                   ("T1", None, "linea", 2), ("Zona", None, "area", 2)}
    assert rows.filter("name = 'P2' and folder = 'Dentro'").first().description == "Con <b>agua</b>"
    cand = {r.name: r for r in P.station_candidates(rows).filter("name <> 'P2'").collect()}
    assert set(cand) == {"P1", "T1"} and 940 < cand["T1"].length_m < 960 and cand["T1"].end_lon == -71.61
    assert P.station_candidates(rows).filter("repeated_name").count() == 2


def test_taxon_and_station_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "# comentario\nNombre_Comun,Nombre_cientifico,Clase,Orden,Familia,Nombres_alternativos\n"
        "Chucao,Scelorchilus rubecula,Aves,Passeriformes,Rhinocryptidae,Chucao tapaculo; Tricao\n"
        "Ratón,Abrothrix olivacea,Mamíferos,Rodentia,Cricetidae,\nRatón,Abrothrix longipilis,mamiferos,Rodentia,Cricetidae,\n", encoding="utf8")
    taxa = K.read_taxon_csv(spark, str(tmp_path / "t.csv"))
    rows = {r.scientific_name: r for r in taxa.filter("not is_placeholder").collect()}
    assert rows["Scelorchilus rubecula"].search_keys == ["chucao", "chucao tapaculo", "s rubecula", "scelorchilus rubecula", "tricao"]
    assert rows["Abrothrix olivacea"].ambiguous and rows["Abrothrix olivacea"].tax_group == "mamiferos"
    assert not rows["Scelorchilus rubecula"].ambiguous
    assert taxa.filter("is_placeholder").count() == 8
    (tmp_path / "s.csv").write_text("id_estacion,proyecto,utm_este,utm_norte,transecto,camara_trampa\nE1,P,300000,\"6300000,5\",Sí,x\nE2,,n/d,1,no,\n", encoding="utf8")
    st = {r.station_code: r for r in K.read_station_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert st["E1"].methods == ["transecto", "camara_trampa"] and st["E1"].utm_north == 6300000.5
    assert st["E2"].methods == [] and st["E2"].final_code == "E2" and st["E2"].utm_east is None


def test_backups(spark, tmp_path):
    good = {"format": "field-backup", "version": 1, "deviceId": "d1", "counts": {"events": 2}, "data": {"events": [{"id": "e1"}, {"id": "e2"}]}}
    newer = dict(good, version=9)
    for name, doc in (("a", good), ("b", newer), ("c", {"format": "x"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    out = W.read_backups(spark, str(tmp_path), {"events": "id: string"}, marker="field-backup")
    assert sorted(r.id for r in out["events"].collect()) == ["e1", "e2"]
    assert [(r.table, r.rows) for r in out["counts"].collect()] == [("events", 2)]
    assert sorted(r.reason for r in out["rejected"].collect()) == ["newer version", "not a backup"]
    folder = str(tmp_path / "out")
    W.write_backup({"events": out["events"].select("id")}, folder, marker="field-backup", device_id="d2", created_at="2026-01-01T00:00:00Z")
    back = W.read_backup_folder(spark, folder, {"events": "id: string"}, marker="field-backup")
    assert sorted((r.id, r.source_device) for r in back["events"].collect()) == [("e1", "d2"), ("e2", "d2")]
    assert [(r.table, r.rows) for r in back["counts"].collect()] == [("events", 2)] and back["rejected"].isEmpty()
    foreign = W.read_backup_folder(spark, folder, {"events": "id: string"}, marker="other")
    assert foreign["events"].isEmpty() and [r.reason for r in foreign["rejected"].collect()] == ["not a backup"]


def test_a_large_backup_is_read_by_many_tasks(spark, tmp_path):
    """One document of nested rows, braces and quotes inside of texts, tables in any order: split by bytes, put together exactly."""
    rng = random.Random(2)
    odd = ["}", "{", "]", '"', "\\", "a}b{", '\\"}', "plain", "ñ}", "], \"events\": [{", "\n", "}" * 5]
    events = [{"id": k, "note": "".join(rng.choices(odd, k=rng.randint(0, 6))), "place": {"lat": k / 7, "tags": ["x", "}"] * rng.randint(0, 3)}, "n": None} for k in range(1500)]
    audit = [{"id": k, "note": rng.choice(odd)} for k in range(300)]
    for name, order, indent in (("a", ["format", "version", "deviceId", "counts", "data"], None), ("b", ["data", "counts", "deviceId", "version", "format"], 1)):
        whole = {"format": "field-backup", "version": 1, "deviceId": f"{name} }}{{\"[", "counts": {"events": 1500, "audit": 300, "none": 0},
                 "data": {"events": events, "none": [], "audit": audit, "settings": [{"key": "k", "value": {"deep": [[{"a": 1}]]}}]}}
        (tmp_path / f"{name}.json").write_text(json.dumps({k: whole[k] for k in order}, indent=indent, ensure_ascii=name == "a") + "\n", encoding="utf8")
    (tmp_path / "cut.json").write_text(json.dumps({"format": "field-backup", "version": 1, "data": {"events": events}})[:5000])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 10
        out = W.read_backups(spark, str(tmp_path), {"events": "id: bigint, note: string, place: struct<lat: double, tags: array<string>>, n: int",
                                                    "audit": "id: bigint, note: string", "none": "id: bigint", "settings": "key: string, value: string"}, marker="field-backup")
        got = {(r.file.rsplit("/", 1)[1], r.source_device): [] for r in out["events"].select("file", "source_device").distinct().collect()}
        for r in out["events"].collect():
            got[r.file.rsplit("/", 1)[1], r.source_device].append((r.id, r.note, r.place.lat, tuple(r.place.tags)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((e["id"], e["note"], e["place"]["lat"], tuple(e["place"]["tags"])) for e in events)
    assert {k: sorted(v) for k, v in got.items()} == {("a.json", 'a }{"['): want, ("b.json", 'b }{"['): want}
    assert sorted((r.id, r.note) for r in out["audit"].collect()) == sorted((a["id"], a["note"]) for a in audit * 2)
    assert out["none"].isEmpty() and [json.loads(r.value) for r in out["settings"].collect()] == [{"deep": [[{"a": 1}]]}] * 2
    assert sorted((r.table, r.rows) for r in out["counts"].collect()) == sorted([("events", 1500), ("audit", 300), ("none", 0)] * 2)
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in out["rejected"].collect()] == [("cut.json", "not a backup")]


def test_kml_order_holds_over_splits(spark, tmp_path):
    marks = "".join(f"<Folder><name>F{k // 10}</name>" * (k % 10 == 0) + f"<Placemark><name>P{k}</name><Point><coordinates>-71,{-30 - k / 1000}</coordinates></Point></Placemark>"
                    + "</Folder>" * (k % 10 == 9) for k in range(500))
    (tmp_path / "m.kml").write_text(f"<kml>{marks}</kml>", encoding="utf8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = W.read_kml(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.placemark_no, r.name, r.folder) for r in rows} == {(k, f"P{k}", f"F{k // 10}") for k in range(500)}


def test_typed_cells(spark, tmp_path):
    """Digits in a cell of text are no date; numbers, dates, truth values and spoilt cells come as their type says."""
    heads = ["Nombre común", "Fecha", "ID Estación", "Abundancia", "Hora"]
    rows = [("f", "Registros", 1, c, h, "s") for c, h in enumerate(heads)]
    body = [("puma", "s"), ("45000", "n"), ("E1", "s"), ("3.0", "n"), ("0.5", "n")], [("puma", "x"), ("45000", "s"), ("E1", "s"), ("#N/A", "e"), ("0.5", "s")], \
           [("puma", "s"), ("2024-05-06T10:30:00", "d"), ("1", "b"), ("", "s"), ("2024-05-06T10:30:00", "d")]
    rows += [("f", "Registros", 2 + r, c, v, k) for r, line in enumerate(body) for c, (v, k) in enumerate(line)]
    spark.createDataFrame(rows, W.CELLS).coalesce(1).write.csv(str(tmp_path / "c"), header=True, escape='"', emptyValue="")
    cells = W.read_cells(spark, str(tmp_path / "c"))
    keys = spark.createDataFrame([("puma", 1)], "key string, taxon_id int")
    got = I.import_records(cells, I.detect_header_row(cells, "import"), keys).orderBy("row_no").collect()
    assert [(r.event_date, r.event_time, r.station_code, r.individual_count) for r in got] == [
        ("2023-03-15", "12:00", "E1", 3.0), (None, None, "E1", None), ("2024-05-06", "10:30", "true", None)]


def test_darwin_core_files(spark, tmp_path):
    t = Tables(spark, SF)
    flat = t.flat
    W.write_dwca(X.dwca_event(flat), X.dwca_occurrence(flat, t.event, t.occurrence), X.dwca_measurement(flat, t.fact), str(tmp_path))
    occ = spark.read.csv(str(tmp_path / "occurrence"), sep="\t", header=True, quote="")
    assert len(occ.columns) == 37 and occ.count() == flat.count() + X.absences(t.event, t.occurrence).count()
    assert len(spark.read.csv(str(tmp_path / "event"), sep="\t", header=True, quote="").columns) == 27
    dirty = spark.createDataFrame([("a\tb\nc ", None)], "x string, y string")
    assert tuple(W.one_line(dirty).first()) == ("a b c", "")
    W.write_occurrence_csv(X.dwca_present(flat), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').filter("occurrenceStatus = 'absent'").count() == 0


def test_masked_species_cannot_be_found(spark):
    t = Tables(spark, SF)
    hidden = X.dwca_present(t.flat, policy="omitida").filter("informationWithheld <> ''")
    assert hidden.count() > 0 and hidden.filter("decimalLatitude <> '' or decimalLongitude <> ''").count() == 0
    event = X.dwca_event(t.flat, policy="omitida").join(t.station.select(F.col("station_code").alias("locality"), "lat"), "locality")
    assert event.filter(F.abs(F.col("decimalLatitude").cast("double") - F.col("lat")) > 1e-9).count() == 0


def test_template_files(spark, tmp_path):
    t = Tables(spark, SF)
    sheet = X.NATIVE_TEMPLATE[0]
    rows = X.build_sheet(sheet, X.sheet_rows(sheet.scope, t.flat))
    W.write_template({sheet.name: rows}, {sheet.name: [c.header for c in sheet.columns]}, str(tmp_path))
    assert len(spark.read.csv(str(tmp_path / "Registros/header")).columns) == len(sheet.columns) == 53
    assert X.fill_placeholders([["Cliente: {{cliente}}", "{{nada}}"]], {"cliente": "ACME"}) == [["Cliente: ACME", ""]]


def test_headers(spark):
    cases = {
        "Fecha": ("event.date", 1.0), "Nombre común (1)": ("occurrence.commonName", 1.0), "UTM -E (no modificar)": ("occurrence.utmEast", 1.0),
        "Registro: Individuo, feca, vocalización": ("occurrence.recordType", 1.0), "Tipo registro: Directo/Indirecto": ("occurrence.evidenceKind", 1.0),
        "Abundansia": ("occurrence.count", 0.65), "ID Temporada DwC": (None, 0.0), "UTM este": ("station.utmEast", 1.0),
        "Referencia de altura": ("aerial.heightCategory", 1.0), "TIPO": (None, 0.0), "Zzz": (None, 0.0), "Scientific name": ("taxon.scientificName", 1.0),
    }
    df = spark.createDataFrame([(h,) for h in cases], "header string")
    got = {r.header: (r.field_id, round(r.confidence, 2)) for r in match_headers(df).collect()}
    assert got == cases
    own = match_headers(df, extra=[("Zzz", "event.team")]).filter("header = 'Zzz'").first()
    assert own.field_id == "event.team"


def test_red_list(spark):
    rows = [(2, "Aegla papudo", "EN", "5"), (3, "Aegla papudo", "CR", "18"), (4, "Otra sp", "EN (JF); LC (Chile)", None), (5, "Otra sp", "VU", None),
            (6, "Mala", "Nombre científico NO válido; sinonimia", "1")]
    df = spark.createDataFrame(rows, "row_no int, scientific_name string, category string, process string")
    for c in ("common_name", "source", "decree", "endemic"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    out = I.read_nomina(df)
    got = {r.scientific_name: (r.category, r.code, r.composite, r.synonym) for r in out["species"].collect()}
    assert got["Aegla papudo"] == ("CR", "CR", False, False) and got["Otra sp"] == ("VU", "VU", False, False)
    assert got["Mala"][2:] == (True, True)
    assert out["resolved"].count() == 2
    assert tuple(I.nomina_summary(out["species"]).first()) == (3, 3, 0, 1, 2)


def test_exchange_files_are_compressed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 5000)], "id long, text string")
    W.write_backup({"events": rows}, str(tmp_path / "b"), marker="m", device_id="d", created_at="2026-01-01T00:00:00Z")
    assert sum(p.stat().st_size for p in (tmp_path / "b/events").glob("part*")) < 1000
    back = W.read_backup_folder(spark, str(tmp_path / "b"), {"events": "id bigint, text string"}, marker="m")
    assert [(r.id, r.text) for r in back["events"].collect()] == [(1, "x" * 5000)]
    W.write_dwca(rows, rows, rows, str(tmp_path / "d"))
    W.write_occurrence_csv(rows, str(tmp_path / "c"))
    for folder in ("d/event", "d/occurrence", "d/measurementorfact", "c"):
        assert sum(p.stat().st_size for p in (tmp_path / folder).glob("part*")) < 1000


def test_headers_are_cleaned_after_the_join(spark):
    """Only header rows are written and cleaned; no cell of a body meets the null markers."""
    from fieldtally.operators import intake as I

    cells = spark.createDataFrame([("f", "s", r, c, v) for r, line in enumerate([["x"], [" Fecha ", "-", "Hora\t"], ["1", "2", "3"]], 1) for c, v in enumerate(line)]
                                  + [("f", "s", None, 0, "y"), ("g", "s", 2, 0, None)], "file string, sheet string, row_no long, col_no int, value string")
    rows = spark.createDataFrame([("f", "s", 2), ("g", "s", 2)], "file string, sheet string, header_row long")
    found = I.sheet_headers(cells, rows, "import")
    assert all("/header-cells-" in f for f in found.inputFiles()) and found.inputFiles()
    assert sorted((r.file, r.header_row, r.col_no, r.header) for r in found.collect()) == [("f", 2, 0, "Fecha"), ("f", 2, 2, "Hora")]


def test_verdict_reads_the_cells_once(spark, monkeypatch):
    from datetime import date

    from fieldtally.plans import intake as P

    tables = {
        "orders": spark.createDataFrame([(k, k % 2, date(2024, 1, 1 + k % 28)) for k in range(1, 41)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "supplier": spark.createDataFrame([(1,)], "s_suppkey long"),
        "part": spark.createDataFrame([(1, "blue bolt", "b", "t"), (2, "red rod", "b", "u")], "p_partkey long, p_name string, p_brand string, p_type string")}

    class Some:
        def raw(self, name):
            return tables[name]

    built, cells = [], P.cells
    monkeypatch.setattr(P, "cells", lambda t: built.append(1) or cells(t))
    got = {r.file: (r.records, r.errors, r.can_import) for r in P._verdict(Some()).collect()}
    assert len(built) == 1
    imported = P._imported(Some()).collect()
    assert {f: n for f, (n, _, _) in got.items()} == {f: sum(r.file == f for r in imported) for f in (0, 1)}
    for f, (_, errors, can) in got.items():
        own = [r for r in imported if r.file == f]
        assert errors == sum((r.hits == 0) + (r.event_date is None) + (r.station_code is None) for r in own) > 0 and not can


def test_empty_truth_values_and_other_empty_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text("file,sheet,row_no,col_no,value,value_type\nf,s,1,0,,b\nf,s,1,1,,n\nf,s,1,2,,s\nf,s,1,3,2.0,n\nf,s,1,4,x,e\nf,s,1,5,y,\n")
    got = W.read_cells(spark, str(tmp_path / "c.csv"))
    assert sorted((r.col_no, r.value, r.value_type) for r in got.collect()) == [(0, "false", "b"), (3, "2", "n"), (5, "y", "s")]
