"""A stream over the tables gives what the batch operator gives; and every query has a stable schema."""

import random

from pyspark.sql import functions as F

from fieldtally.operators import effort as E
from fieldtally.operators import quality as Q
from fieldtally.plans import registry
from fieldtally.plans.registry import Tables
from fieldtally.plans.streams import streamed
from fieldtally.streaming import flows as W

SF = "/root/testdata/sf0.001"


def in_files(spark, rows, schema, folder, parts=3):
    """A stream over several files of one table, one a micro-batch."""
    frame = spark.createDataFrame(rows, schema)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.parquet(str(folder / f"p={k}"))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "p=*"))


def test_track_stream_equals_batch(spark):
    t = Tables(spark, SF)
    rows, close = W.with_closing(streamed(t, "events").track_point.withColumn("at_time", F.timestamp_seconds("t_s")), "at_time")
    out = W.run_batched(W.stream_track(rows, idle="40000 days"), close=close)
    live = {(r.point_id, r.accepted, r.reason) for r in out.filter("closed_at is null").collect()}
    batch = {(r.point_id, r.accepted, r.reason) for r in E.filter_track(t.track_point).collect()}
    assert live == batch
    assert out.filter("closed_at is not null").count() == t.track_point.select("track_id").distinct().count()


def test_silent_tracks_close_and_open_anew(spark, tmp_path):
    """Files out of order, gaps above and below the limit, a refused point that still counts as a sign of life."""
    pick = random.Random(4)
    rows, k = [], 0
    for track in range(6):
        t = 1_000_000 + 977 * track
        for _ in range(40):
            t += pick.choice([5, 20, 60, 3000, 8000])
            k += 1
            rows.append((track, k, t, -33 + pick.randint(0, 30) * 1e-4, -71.0, pick.choice([5.0, 40.0, None])))
    pick.shuffle(rows)
    source = in_files(spark, rows, "track_id long, point_id long, t_s long, lat double, lon double, acc double", tmp_path)
    open_rows, close = W.with_closing(source.withColumn("at_time", F.timestamp_seconds("t_s")), "at_time")
    got = W.run_batched(W.stream_track(open_rows, idle="2 hours", watermark="30 days"), close=close).collect()
    want_points, want_closed = set(), set()
    for track in range(6):
        own = sorted((r for r in rows if r[0] == track), key=lambda r: (r[2], r[1]))
        last, seen, n = None, None, 0
        for _, point, t, lat, lon, acc in own:
            if seen is not None and t - seen > 7200:
                want_closed.add((track, n, (seen + 7200) * 1000))
                last, n = None, 0
            reason = E.judge_point(last, (t, lat, lon, acc))
            last = (t, lat, lon) if reason is None else last
            seen, n = t, n + 1
            want_points.add((point, reason))
        want_closed.add((track, n, (seen + 7200) * 1000))
    assert {(r.point_id, r.reason) for r in got if r.closed_at is None} == want_points
    assert {(r.track_id, r.points, r.closed_at) for r in got if r.closed_at is not None} == want_closed


def test_outbox_items_wake_and_leave_log_rows(spark, tmp_path):
    at = "2026-01-01 00:00:"
    rows = [("a", 1, f"{at}00", "upsert", "retry", True), ("a", 2, f"{at}01", "upsert", "retry", True), ("a", 3, f"{at}30", "upsert", "ok", True),
            ("a", 4, f"{at}40", "upsert", "retry", True), ("b", 5, f"{at}00", "upsert", "conflict", True), ("c", 6, f"{at}00", "upsert", "retry", False),
            ("c", 7, f"{at}05", "delete", "error", False)] + [("d", 10 + k, f"{at}{k + 10}", "upsert", "retry", True) for k in range(8)]
    source = in_files(spark, rows, "item_id string, seq long, at string, op string, outcome string, entity_exists boolean", tmp_path)
    open_rows, close = W.with_closing(source.withColumn("at", F.to_timestamp("at")), "at")
    out = W.run_batched(W.stream_outcomes(open_rows, watermark="1 hour"), close=close)
    got = {(r.item_id, r.kind, r.seq, r.attempt, r.result) for r in out.filter("item_id <> 'd'").collect()}
    assert got == {
        ("a", "answer", 1, 1, "retry"), ("a", "log", 1, 1, "retry"),  # answered again before it was due
        ("a", "answer", 2, 2, "retry"), ("a", "log", 2, 2, "retry"), ("a", "due", 2, 2, None),
        ("a", "answer", 3, 3, "synced"), ("a", "log", 3, 3, "ok"),
        ("a", "answer", 4, 1, "retry"), ("a", "log", 4, 1, "retry"), ("a", "due", 4, 1, None),
        ("b", "answer", 5, 1, "conflict"), ("b", "log", 5, 1, "conflict"), ("b", "due", 5, 1, None),
        ("c", "answer", 6, 0, "skipped"), ("c", "answer", 7, 1, "error"), ("c", "log", 7, 1, "error"), ("c", "due", 7, 1, None)}
    last = out.filter("item_id = 'd' and kind = 'answer'").orderBy("seq").collect()[-1]
    assert (last.attempt, last.result, last.wait_s) == (8, "error", 365 * 24 * 3600)
    woken = {r.seq: r.at_ms for r in out.filter("kind = 'due' and item_id = 'a'").collect()}
    base = 1_767_225_600_000
    assert woken == {2: base + 1000 + 4000, 4: base + 40_000 + 2000}


def test_visits_saved_and_deleted_in_the_stream_are_seen(spark, tmp_path):
    day = "2026-03-{:02d}"
    visits = [(1, "punto_conteo", day.format(d), f"{day.format(d)} 08:00:00", False) for d in (1, 5)]
    visits += [(1, "punto_conteo", day.format(5), f"{day.format(6)} 08:00:00", True), (2, "transecto", day.format(3), f"{day.format(3)} 08:00:00", False)]
    asked = [(10, 1, "punto_conteo", day.format(1), day.format(1), f"{day.format(1)} 07:00:00"),  # before the visit is saved
             (11, 1, "punto_conteo", day.format(1), day.format(1), f"{day.format(1)} 08:00:00"),  # of the same moment
             (12, 1, "punto_conteo", day.format(5), day.format(6), f"{day.format(6)} 07:59:59"),
             (13, 1, "punto_conteo", day.format(5), day.format(6), f"{day.format(6)} 08:00:01"),  # the visit is deleted
             (14, 2, "transecto", day.format(4), day.format(4), f"{day.format(4)} 10:00:00"),
             (15, None, "transecto", day.format(4), day.format(4), f"{day.format(4)} 10:00:00")]
    (tmp_path / "v").mkdir(), (tmp_path / "e").mkdir()
    saved = in_files(spark, visits, "station_id long, method string, event_date string, at string, removed boolean", tmp_path / "v").withColumn("at", F.to_timestamp("at"))
    entries = in_files(spark, asked, "entry_id long, station_id long, method string, sighting_date string, today string, at string", tmp_path / "e").withColumn("at", F.to_timestamp("at"))
    both, close = W.with_closing(entries, "at")
    out = W.run_batched(W.late_entries(both, saved, watermark="90 days"), close=close).filter("entry_id is not null").collect()
    assert {r.entry_id: r.mode for r in out} == {10: "normal", 11: "normal", 12: "olvido", 13: "otro_dia", 14: "quizas_replica", 15: "normal"}
    assert "(el último fue el 1 de marzo)" in next(r.notice for r in out if r.entry_id == 13)


def test_late_sightings_are_met_bucket_by_bucket(spark, tmp_path):
    """Two buckets of many stations: visits saved, deleted and asked for of each station and method stay apart."""
    pick = random.Random(8)
    visits, asked = [], []
    for k in range(400):
        day = pick.randint(1, 28)
        visits.append((pick.randint(1, 12), pick.choice(["transecto", 'punto "a"']), f"2026-01-{day:02d}", 86_400_000 * (20_453 + day), False))
    visits += [(*v[:3], v[3] + 7_200_000, True) for v in visits[::3]]
    for k in range(600):
        day = pick.randint(1, 28)
        asked.append((2**60 + k, pick.randint(1, 13), pick.choice(["transecto", 'punto "a"']), f"2026-01-{day:02d}", f"2026-01-{pick.randint(day, 28):02d}", 86_400_000 * (20_453 + day) + pick.choice([-1, 0, 3_600_000, 7_200_000, 9_000_000])))
    (tmp_path / "v").mkdir(), (tmp_path / "e").mkdir()
    saved = in_files(spark, visits, "station_id long, method string, event_date string, at long, removed boolean", tmp_path / "v").withColumn("at", F.timestamp_millis("at"))
    entries = in_files(spark, asked, "entry_id long, station_id long, method string, sighting_date string, today string, at long", tmp_path / "e").withColumn("at", F.timestamp_millis("at"))
    both, close = W.with_closing(entries, "at")
    out = W.run_batched(W.late_entries(both, saved, watermark="90 days", salts=2, buckets=2), close=close)
    got = {(r.entry_id, r.mode) for r in out.filter("entry_id is not null").collect()}
    want = set()
    for entry, station, method, said, today, at in asked:
        days = {}
        for v in sorted((v for v in visits if v[:2] == (station, method) and v[3] <= at), key=lambda v: (v[3], v[4])):
            days[v[2]] = days.get(v[2], 0) + (-1 if v[4] else 1)
        days, late = {d for d, n in days.items() if n > 0}, said != today
        want.add((entry, ("olvido" if late else "normal") if said in days or not days else "otro_dia" if late else "quizas_replica"))
    assert got == want and len(got) == 600 and len({m for _, m in got}) == 4


def test_late_sightings_and_visits_without_a_time(spark, tmp_path):
    """They come first; a day that isn't known is no one's day."""
    visits = [(1, "transecto", None, None, False), (1, "transecto", "2026-03-02", "2026-03-02 00:00:00", False), (2, "transecto", None, None, False)]
    asked = [(20, 1, "transecto", None, "2026-03-04", "2026-03-04 00:00:00"), (21, 1, "transecto", "2026-03-02", "2026-03-04", "2026-03-04 00:00:00"),
             (22, 2, "transecto", "2026-03-02", "2026-03-04", "2026-03-04 00:00:00"), (23, 1, "transecto", "2026-03-02", "2026-03-04", None)]
    (tmp_path / "v").mkdir(), (tmp_path / "e").mkdir()
    saved = in_files(spark, visits, "station_id long, method string, event_date string, at string, removed boolean", tmp_path / "v").withColumn("at", F.to_timestamp("at"))
    entries = in_files(spark, asked, "entry_id long, station_id long, method string, sighting_date string, today string, at string", tmp_path / "e").withColumn("at", F.to_timestamp("at"))
    both, close = W.with_closing(entries, "at")
    out = W.run_batched(W.late_entries(both, saved, watermark="90 days"), close=close).filter("entry_id is not null").collect()
    assert {r.entry_id: r.mode for r in out} == {20: "quizas_replica", 21: "olvido", 22: "olvido", 23: "olvido"}


def test_dedup_stream_equals_batch(spark, tmp_path):
    """Rows arrive in two files; the closing row brings out the last ones, and all live rows come out once."""
    t = Tables(spark, SF)
    occ = t.occurrence.select("occurrence_id", "event_id", "taxon_id", "verbatim_taxon", "record_type", "batch_id", "created_at", "deleted_at")
    middle = occ.selectExpr("percentile_approx(created_at, 0.5)").first()[0]
    for i, part in enumerate((occ.filter(F.col("created_at") <= middle), occ.filter(F.col("created_at") > middle))):
        part.coalesce(1).write.parquet(str(tmp_path / f"p={i}"))
    src = spark.readStream.schema(occ.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p=*"))
    rows, close = W.with_closing(src, "created_at")
    out = W.run_batched(W.stream_dedup(rows, watermark="3650 days"), close=close)
    assert sorted(r.occurrence_id for r in out.collect()) == sorted(r.occurrence_id for r in occ.filter("deleted_at is null").collect())
    clusters = out.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = {(r.cluster_id, r.occurrence_id) for r in out.join(clusters, "cluster_id").collect()}
    batch = {(r.cluster_id, r.occurrence_id) for r in Q.duplicate_clusters(t.occurrence).collect()}
    assert live == batch and batch


def test_dedup_calls_its_function_for_buckets_of_events(spark, tmp_path):
    """Two buckets of many events: as many keys of state as buckets, and events apart."""
    rows = spark.range(60).select(
        (F.col("id") % 20).alias("event_id"), F.lit(1).alias("taxon_id"), F.lit(None).cast("string").alias("verbatim_taxon"), F.lit("r").alias("record_type"),
        F.concat(F.lit("o"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("occurrence_id"), F.lit(None).cast("string").alias("batch_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 20).alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream, close = W.with_closing(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "created_at")
    out = W.run_batched(W.stream_dedup(stream, buckets=2), close=close).collect()
    assert len(out) == 60 and {(r.occurrence_id, r.cluster_id, r.position) for r in out} == {
        (f"o{e + 20 * n:02}", f"o{e:02}", n + 1) for e in range(20) for n in range(3)}


def test_registry_is_complete(spark):
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150
    assert not any(q.startswith(("pipeline", "op")) for q in queries)
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["taxon_id", "name", "scientific_name", "records", "individuals", "threatened", "exotic"]
    assert df.count() > 0
