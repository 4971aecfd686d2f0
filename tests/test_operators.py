"""Operators on small hand-made tables, with brute-force twins where the rule is a fold."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldtally.operators import cell_tree
from fieldtally.operators import changes as H
from fieldtally.operators import coverage as C
from fieldtally.operators import effort as E
from fieldtally.operators import merge as M
from fieldtally.operators import quality as Q
from fieldtally.operators import spatial as P

EVENT = ("event_id bigint, station_id string, method string, event_date string, performed boolean, not_performed_reason string, "
         "no_detections boolean, deleted_at timestamp, campaign_id bigint, project_id bigint")


def events(spark, rows):
    full = [(i, s, m, d, p, None, False, None, 1, 1) for i, s, m, d, p in rows]
    return spark.createDataFrame(full, EVENT)


def test_chosen_event_matches_the_fold(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), "transecto", f"2026-01-{rng.randint(1, 9):02d}", rng.choice([True, False, None])) for i in range(60)]
    best = {}
    for i, s, m, d, p in rows:
        before = best.get(s)
        if before is None or p is False or d > before[1]:
            best[s] = (i, d)
    got = {r.station_id: r.event_id for r in C.chosen_events(events(spark, rows)).collect()}
    assert got == {s: i for s, (i, _) in best.items()}


def test_plan_states(spark):
    stations = spark.createDataFrame([("1", "EM01", 1, ["transecto", "camara_trampa"]), ("2", "EM02", 1, ["transecto"]), ("3", "EM03", 1, ["transecto"])],
                                     "station_id string, station_code string, project_id bigint, methods array<string>")
    ev = events(spark, [(1, "1", "transecto", "2026-01-01", True), (2, "2", "transecto", "2026-01-01", False), (3, "9", "transecto", "2026-01-01", True)])
    cov = C.plan_coverage(stations, ev)
    states = {(r.station_code, r.method): r.state for r in cov.collect()}
    assert states == {("EM01", "transecto"): "realizado", ("EM01", "camara_trampa"): "pendiente",
                      ("EM02", "transecto"): "no realizado", ("EM03", "transecto"): "pendiente"}
    assert C.plan_summary(cov).first().coverage == 0.25
    assert [r.event_id for r in C.off_plan(stations, ev).collect()] == [3]


def test_late_entries(spark):
    ev = events(spark, [(1, "s", "transecto", "2026-09-02", True), (2, "s", "transecto", "2026-09-03", True)])
    cases = [(1, "s", "transecto", "2026-09-03", "2026-09-03"), (2, "s", "transecto", "2026-09-02", "2026-09-03"),
             (3, "s", "transecto", "2026-09-01", "2026-09-03"), (4, "s", "transecto", "2026-09-04", "2026-09-04"),
             (5, "z", "transecto", "2026-09-01", "2026-09-04"), (6, None, "transecto", "2026-09-01", "2026-09-04")]
    df = spark.createDataFrame(cases, "entry_id int, station_id string, method string, sighting_date string, today string")
    got = {r.entry_id: r for r in C.resolve_entry(df, ev).collect()}
    assert [got[i].mode for i in range(1, 7)] == ["normal", "olvido", "otro_dia", "quizas_replica", "olvido", "normal"]
    assert got[3].final_method == "registro_oportunista" and got[4].alternative_method == "transecto"
    assert "3 de septiembre" in got[4].notice


def fold_track(points):
    last, out = None, []
    for pid, t, lat, lon, acc in points:
        reason = E.judge_point(last, (t, lat, lon, acc))
        out.append((pid, reason))
        if reason is None:
            last = (t, lat, lon)
    return dict(out)


def test_filter_track_in_chunks_equals_the_fold(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for track in range(3):
        pts = []
        lat = -31.2465
        for i in range(200):
            lat += rng.choice([0.00002, 0.0001, 0.003])
            pts.append((track * 1000 + i, i * rng.randint(10, 12) + i, lat, -71.5312, float(rng.choice([3, 10, 60]))))
        pts.sort(key=lambda p: (p[1], p[0]))
        expected.update(fold_track(pts))
        rows += [(track, *p) for p in pts]
    df = spark.createDataFrame(rows, "track_id bigint, point_id bigint, t_s bigint, lat double, lon double, acc double")
    for chunk in (50, 100000):
        got = {r.point_id: r.reason for r in E.filter_track(df, chunk_s=chunk).collect()}
        assert got == expected


def test_track_rounds_walk_only_what_changed(spark):
    """Chunks are entered anew only while the point before them changes, and no round writes settled rows."""
    rng = random.Random(6)
    rows, expected = [], {}
    for track in range(4):
        pts, lat, t = [], -31.2465, 0
        for i in range(300):
            lat += rng.choice([0.0, 0.00001, 0.00002])
            t += rng.randint(1, 5)
            pts.append((track * 1000 + i, t, lat, -71.5312, float(rng.choice([3, 10, 60]))))
        expected.update(fold_track(pts))
        rows += [(track, *p) for p in pts]
    df = spark.createDataFrame(rows, "track_id bigint, point_id bigint, t_s bigint, lat double, lon double, acc double")
    written = [part.count() for part, _ in E.track_rounds(df, chunk_s=20)]
    assert written[0] == len(rows) and len(written) > 2 and all(a > b for a, b in zip(written, written[1:]))
    assert {r.point_id: r.reason for r in E.filter_track(df, chunk_s=20).collect()} == expected
    # A point without a time is judged, but can't be where a later chunk is entered.
    hidden = [(None, 1, None, -31.0, -71.0, None), (None, 2, 5, -31.0, -71.0, None), (1, 3, None, -31.0, -71.0, 99.0)]
    odd = spark.createDataFrame(hidden, df.schema)
    assert {(r.point_id, r.accepted) for r in E.filter_track(odd).collect()} == {(1, True), (2, True), (3, False)}


def test_track_length_over_buckets(spark):
    rows = [(1, i, i * 60, -31.2465 + i * 0.0001, -71.5312) for i in range(40)] + [(2, 1, 5, -31.0, -71.0)]
    df = spark.createDataFrame(rows, "track_id bigint, point_id bigint, t_s bigint, lat double, lon double")
    want = round(sum(E.metres_between(a[3], a[4], b[3], b[4]) for a, b in zip(rows[:39], rows[1:40])))
    for bucket in (300, 86400):
        got = {r.track_id: r.length_m for r in E.track_length(df, bucket_s=bucket).collect()}
        assert got == {1: want, 2: 0}
    assert {r.track_id: r.length_m for r in E.waypoint_distance(df).collect()}[2] is None


OCC = "occurrence_id string, event_id bigint, taxon_id bigint, verbatim_taxon string, record_type string, batch_id string, created_at timestamp, deleted_at timestamp"


def test_duplicates_match_the_chain(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        rows.append((f"o{i:03d}", rng.randint(1, 3), rng.choice([1, None]), rng.choice(["x", None]), "Individuo",
                     rng.choice(["a", "b", None]), 1700000000 + rng.randint(0, 9000)))
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2] if r[2] is not None else (r[3] or "?"), r[4]), []).append(r)
    expected = set()
    for g in groups.values():
        g.sort(key=lambda r: (r[6], r[0]))
        cluster = [g[0]]
        for a, b in zip(g, g[1:]):
            same = bool(b[5]) and b[5] == a[5]
            if b[6] - a[6] <= 60 and not same:
                cluster.append(b)
            else:
                expected |= {(cluster[0][0], r[0]) for r in cluster if len(cluster) > 1}
                cluster = [b]
        expected |= {(cluster[0][0], r[0]) for r in cluster if len(cluster) > 1}
    df = spark.createDataFrame([(*r[:6], r[6]) for r in rows], OCC.replace("created_at timestamp, deleted_at timestamp", "s bigint"))
    df = df.withColumns({"created_at": F.timestamp_seconds("s"), "deleted_at": F.lit(None).cast("timestamp")}).drop("s")
    for bucket in (120, 3600):
        got = {(r.cluster_id, r.occurrence_id) for r in Q.duplicate_clusters(df, bucket_s=bucket).collect()}
        assert got == expected and expected


def test_nearest_station_is_exact_at_any_range(spark):
    rng = random.Random(5)
    stations = [(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(60)] + [(100 + i, -33 + i * 1e-4, -71.0) for i in range(20)]
    fixes = [(f"f{i}", rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(40)] + [("near", -33.00005, -71.0), ("seam", 10.0, 179.9999)]
    st = spark.createDataFrame(stations, "station_id bigint, lat double, lon double")
    fx = spark.createDataFrame(fixes, "file string, lat double, lon double")
    got = {r.file: (r.nearest_station_id, r.nearest_m) for r in P.nearest_station(fx, st).collect()}
    for name, lat, lon in fixes:
        best = min((math.floor(E.metres_between(lat, lon, a, b) + 0.5), i) for i, a, b in stations)
        assert got[name] == (best[1], best[0])


def test_nearest_of_many_stations_looks_at_few(spark):
    """10^5 stations, half of them in one square kilometre; positions near, far, at the poles, and without a place."""
    rng = np.random.default_rng(8)
    lat = np.concatenate([rng.uniform(-33.005, -32.995, 50_000), rng.uniform(-56, -17, 30_000), rng.uniform(-89, 89, 20_000)])
    lon = np.concatenate([rng.uniform(-71.005, -70.995, 50_000), rng.uniform(-76, -66, 30_000), rng.uniform(-180, 180, 20_000)])
    st = spark.createDataFrame(pd.DataFrame({"station_id": np.arange(len(lat)), "lat": lat, "lon": lon}))
    spots = [(float(a), float(b)) for a, b in zip(np.append(rng.uniform(-34, -32, 60), rng.uniform(-90, 90, 60)), np.append(rng.uniform(-72, -70, 60), rng.uniform(-180, 180, 60)))]
    spots += [(-33.0, -71.0), (90.0, 0.0), (-90.0, 12.0), (0.0, 180.0), (0.0, -180.0), (float(lat[7]), float(lon[7]))]
    fixes = [(f"f{k}", a, b) for k, (a, b) in enumerate(spots)] + [("same", *spots[0]), ("no lat", None, 3.0), ("nowhere", None, None), ("nan", float("nan"), 1.0)]
    fx = spark.createDataFrame(fixes, "file string, lat double, lon double")
    got = {r.file: (r.nearest_station_id, r.nearest_m) for r in P.nearest_station(fx, st).collect()}
    near = {r.file: (r.nearest_station_id, r.nearest_m) for r in P.nearest_station(fx, st, max_m=2000).collect()}
    phi, lam = np.radians(lat), np.radians(lon)
    for name, a, b in fixes:
        if a is None or a != a:
            assert got[name] == near[name] == (None, None)
            continue
        h = np.sin((phi - math.radians(a)) / 2) ** 2 + math.cos(math.radians(a)) * np.cos(phi) * np.sin((lam - math.radians(b)) / 2) ** 2
        metres = np.floor(2 * 6371000.0 * np.arcsin(np.sqrt(h)) + 0.5).astype(int)
        best = int(metres.argmin())
        assert got[name] == (best, metres[best])
        assert near[name] == ((best, metres[best]) if metres[best] <= 2000 else (None, None))
    places = st.select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.col("station_id").alias("n_station_id"))
    looked = cell_tree.candidates(fx.select("lat", "lon").distinct(), places).groupBy("lat", "lon").agg(F.sum(F.size("near")).alias("n"), F.max(F.size("near")).alias("most"))
    worst = looked.agg(F.max("n").alias("n"), F.avg("n").alias("mean"), F.max("most").alias("most")).first()
    assert worst.n <= 600 and worst.mean <= 150 and worst.most <= cell_tree.CAPACITY


def test_nearest_station_of_few_or_crowded_ones(spark):
    fx = spark.createDataFrame([("a", -33.0, -71.0), ("b", 40.0, 3.0), ("c", None, None)], "file string, lat double, lon double")
    none = spark.createDataFrame([], "station_id bigint, lat double, lon double")
    assert {tuple(r) for r in P.nearest_station(fx, none).select("file", "nearest_station_id", "nearest_m").collect()} == {("a", None, None), ("b", None, None), ("c", None, None)}
    one = spark.createDataFrame([(7, -33.0, -71.0), (3, -33.0, -71.0), (9, None, 1.0)], "station_id bigint, lat double, lon double")
    assert {r.file: r.nearest_station_id for r in P.nearest_station(fx, one).collect()} == {"a": 3, "b": 3, "c": None}
    # Hundreds of stations within a metre: the last cells are split by a hash, and ties go to the lowest id.
    crowd = spark.createDataFrame([(1000 - k, -33.0 + k * 1e-9, -71.0) for k in range(300)], "station_id bigint, lat double, lon double")
    assert {r.file: (r.nearest_station_id, r.nearest_m) for r in P.nearest_station(fx, crowd).collect() if r.file == "a"} == {"a": (701, 0)}
    assert P.nearest_station(fx.limit(0), crowd).count() == 0


def test_double_counts(spark):
    schema = ("occurrence_id string, station_id string, event_date string, occurrence_time string, taxon_id bigint, verbatim_taxon string, "
              "recorded_by string, deleted_at timestamp")
    a = spark.createDataFrame([("a1", "s", "d", "10:20", 1, None, "Ana", None), ("a2", "s", "d", "10:40", 1, None, "Ana", None),
                               ("a3", "s", "d", "10:06", None, " Zorro ", "Ana", None)], schema)
    b = spark.createDataFrame([("b1", "s", "d", "10:05", 1, None, "Luis", None), ("b2", "s", "d", "10:10", 1, None, "Ana", None),
                               ("b3", "s", "d", "10:00", 5, "zorro", None, None)], schema)
    got = {(r.local_id, r.incoming_id) for r in M.double_counts(a, b).collect()}
    assert got == {("b1", "a1"), ("b3", "a3")}


def test_double_counts_with_half_of_all_rows_in_one_slot(spark):
    """One observer's many records in one slot meet each other in no join; the few of others find all of theirs."""
    schema = ("occurrence_id string, station_id string, event_date string, occurrence_time string, taxon_id bigint, verbatim_taxon string, "
              "recorded_by string, deleted_at timestamp")
    rng = random.Random(12)

    def rows(side, crowd):
        hot = [(f"{side}h{k}", "s", "d", f"10:{k % 30:02d}", 1, None, "Ana", None) for k in range(crowd)]
        return hot + [(f"{side}{k}", "s", rng.choice("de"), f"{rng.randint(8, 12):02d}:{rng.randint(0, 59):02d}", rng.choice([1, 1, 2, None]),
                       rng.choice([None, "Zorro ", "zorro"]), rng.choice(["Ana", "Ana", "Luis", None, ""]), None) for k in range(60)]

    here, there = rows("a", 400), rows("b", 400)
    minute = lambda t: int(t[:2]) * 60 + int(t[3:])
    said = lambda v: (v or "").strip().lower()
    want = set()
    for b in there:
        for a in here:
            same = b[4] == a[4] if b[4] is not None and a[4] is not None else said(b[5]) != "" and said(b[5]) == said(a[5])
            other = not (b[6] and b[6] == a[6])
            if same and other and a[2] == b[2] and abs(minute(a[3]) - minute(b[3])) <= 30:
                want.add((a[0], b[0]))
    for split in (50, 5000):
        found = M.double_counts(spark.createDataFrame(there, schema), spark.createDataFrame(here, schema), split_rows=split).collect()
        assert len(found) == len(want) and {(r.local_id, r.incoming_id) for r in found} == want


def test_merge_modes(spark):
    local = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    other = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    rows = lambda mode: {(r.id, r.v, r.action) for r in M.merge_backups(local, other, mode=mode).collect()}
    assert rows("fusionar") == {(1, "x", "local"), (2, "y", "conflict"), (3, "w", "inserted")}
    assert rows("reemplazar") == {(1, "x", "local"), (2, "z", "replaced"), (3, "w", "inserted")}


def test_audit_diff_of_nested_values(spark):
    before = spark.createDataFrame([(1, "a", ["x"], "t1"), (2, "b", [], "t2")], "id int, name string, tags array<string>, track string")
    after = spark.createDataFrame([(1, "a", ["x", "y"], "t9"), (2, "b", [], "t3")], "id int, name string, tags array<string>, track string")
    rows = H.audit_rows(H.audit_diff(before, after, "id", ["name", "tags", "track"]), "id").collect()
    assert [(r.id, r.field, r.before, r.after) for r in rows] == [(1, "tags", '["x"]', '["x","y"]')]


def test_outbox_backoff(spark):
    q = spark.createDataFrame([("a", "upsert", 0, "retry", True), ("b", "upsert", 7, "retry", True), ("c", "upsert", 0, "conflict", True),
                               ("d", "upsert", 0, "ok", False), ("e", "delete", 0, "ok", False)],
                              "item_id string, op string, attempts int, outcome string, entity_exists boolean")
    got = {r.item_id: r.result for r in H.fold_outcomes(q, now="2026-01-01 00:00:00").collect()}
    assert got == {"a": "retry", "b": "error", "c": "conflict", "d": "skipped", "e": "synced"}


def test_only_seen_species_are_joined(spark):
    """A catalogue beyond the broadcast limit does not have the records shuffled by species."""
    from fieldtally.operators.star import seen_taxa

    taxa = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "taxon_id long, common_name string")
    records = spark.createDataFrame([(1,), (1,), (None,)], "taxon_id long")
    assert sorted(r.common_name for r in seen_taxa(taxa, records).collect()) == ["a", "b"]
    many = spark.range(200_000).select((F.col("id") % 200_000).alias("taxon_id"), F.sha2(F.col("id").cast("string"), 512).alias("common_name"))
    joined = records.join(seen_taxa(many, records), "taxon_id", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_double_counts_reads_each_side_once(spark):
    """Both sides and the local slots are tables in the shared folder by the time the pairs are looked for."""
    schema = ("occurrence_id string, station_id int, event_date string, occurrence_time string, taxon_id int,"
              " verbatim_taxon string, recorded_by string, deleted_at string")
    a = spark.createDataFrame([("a", 1, "2024-01-01", "10:00", 5, "Ave", "Ana", None), ("c", 1, "2024-01-01", "12:00", 5, "Ave", "Ana", None)], schema)
    b = spark.createDataFrame([("b", 1, "2024-01-01", "10:20", 5, "Ave", "Eva", None)], schema)
    found = M.double_counts(a, b)
    kinds = {f.split("/")[-2].rsplit("-", 1)[0] for f in found.inputFiles()}
    assert kinds == {"local-records", "incoming-records", "local-slots"}
    assert [(r.incoming_id, r.local_id) for r in found.collect()] == [("a", "b")]


def flat_records(spark, n=40):
    """Two records an event; the later one comes first in the table."""
    return spark.range(n).select(
        (F.col("id") % (n // 2)).alias("event_id"), F.lit("2026-01-01").alias("event_date"), F.when(F.col("id") < n // 2, "10:00").otherwise("09:00").alias("occurrence_time"),
        F.timestamp_seconds("id").alias("created_at"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("occurrence_id"), (F.col("id") % 3).alias("station_id"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("notes"), F.array(F.lit("m")).alias("media_ids"), F.lit(None).cast("string").alias("method"))


def written_columns(spark, frame):
    folders = {f.rsplit("/", 1)[0] for f in frame.inputFiles() if "/star-" in f}
    return set(spark.read.parquet(*folders).columns)


def test_star_is_written_with_what_its_report_reads(spark):
    """Keys, conditions and outputs of every part of a report are written, whole rows only where a report asks for them."""
    from fieldtally.operators import star

    flat = flat_records(spark)
    order = {"event_date", "occurrence_time", "created_at", "occurrence_id", "event_id"}
    first = lambda rows: star.one_per_key(rows, "event_id").select("event_id", "notes")
    stations = spark.createDataFrame([(1, "a"), (2, None)], "station_id long, code string")
    joined = lambda rows: rows.filter("method is null").join(stations, "station_id").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    both = lambda rows: first(rows).select("event_id", "notes").union(rows.select("station_id", F.get("media_ids", F.lit(0))))
    whole = lambda rows: rows.union(star.one_per_key(rows, "event_id"))
    for report, read in ((first, order | {"notes"}), (joined, {"event_id", "method", "station_id"}), (both, order | {"notes", "station_id", "media_ids"}), (whole, set(flat.columns))):
        out = star.on_star(flat, report)
        assert written_columns(spark, out) == read
        assert sorted(map(str, out.collect())) == sorted(map(str, report(flat).collect()))
    assert {(r.event_id, r.notes) for r in first(flat).collect()} == {(e, None if (e + 20) % 5 == 0 else f"n{e + 20}") for e in range(20)}


def test_native_sheets_write_few_columns(spark):
    from fieldtally.plans import registry

    out = registry.queries()["native_sheets"](spark, "/root/testdata/sf0.001")
    assert written_columns(spark, out) == {"event_date", "occurrence_time", "created_at", "occurrence_id", "event_id", "method", "station_id", "station_code", "has_station"}
    assert {(r.sheet, r.n_columns) for r in out.collect()} >= {("Registros", 53), ("Plan", 14), ("Muestreos", 17)}


def test_sheet_plan_writes_few_columns(spark):
    from fieldtally.plans import registry

    out = registry.queries()["sheet_plan"](spark, "/root/testdata/sf0.001")
    assert written_columns(spark, out) == {"event_date", "occurrence_time", "created_at", "occurrence_id", "event_id", "method", "station_code", "record_type"}


def test_sheet_muestreos_writes_few_columns(spark):
    from fieldtally.plans import registry

    out = registry.queries()["sheet_muestreos"](spark, "/root/testdata/sf0.001")
    assert written_columns(spark, out) == {"event_date", "occurrence_time", "created_at", "occurrence_id", "event_id", "station_code", "record_type"}
