"""Photos and positions against stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.operators import spatial as P
from fieldtally.plans.registry import register


def _fixes(t):
    return t.photo.withColumn("fix_id", F.col("file"))


register("nearest_station", lambda t: P.nearest_station(t.photo, t.station).select("file", "nearest_station_id", "nearest_m"),
         "SELECT file, nearest_station_id, nearest_m FROM photo LEFT JOIN photo_near USING (file)")
register("suggest_stations", lambda t: P.suggest_stations(_fixes(t), t.station),
         """SELECT file AS fix_id, station_id, d AS distance_m, row_number() OVER (PARTITION BY file ORDER BY d, station_id) AS rank,
    exact_d<=coalesce(acc,0) AS within_accuracy FROM photo_dist JOIN photo USING (file) WHERE d<=500 QUALIFY rank<=3""")
register("station_drift", lambda t: P.station_drift(_fixes(t), t.station),
         """SELECT file AS fix_id, chosen_station_id, x.d AS distance_m,
    CASE WHEN nearest_m<x.d THEN nearest_station_id END AS nearer_station_id, CASE WHEN nearest_m<x.d THEN nearest_m END AS nearer_m
    FROM photo p JOIN photo_dist x USING (file) JOIN photo_near USING (file)
    WHERE x.station_id=p.chosen_station_id AND x.d>200 AND x.d>coalesce(acc,0)""")
register("check_photo_label", lambda t: P.check_photo_label(t.photo, t.station),
         """SELECT file, label, status, CASE WHEN status IN ('coincide','desfasada') THEN to_label END AS label_m,
    CASE WHEN status='desfasada' THEN nearest_station_id END AS nearest_station_id,
    CASE WHEN status='desfasada' THEN nearest_m END AS nearest_m FROM photo_check""")
register("journey_groups", lambda t: P.journey_groups(P.journey_photos(t.photo, t.station)),
         """SELECT date, station_id, count(*) AS photos, arg_min(file, taken_at||file) AS first_file,
    arg_max(file, taken_at||file) AS last_file, count(*) FILTER (status='desfasada') AS mislabelled
    FROM journey GROUP BY date, station_id""")
register("journey_summary", lambda t: P.journey_summary(P.journey_photos(t.photo, t.station)),
         """SELECT count(DISTINCT date) AS days, count(DISTINCT station_id) AS stations, count(*) AS photos,
    count(*) FILTER (lat IS NULL) AS without_gps, count(*) FILTER (station_id IS NULL) AS unassigned,
    count(*) FILTER (status='desfasada') AS mislabelled FROM journey""")
register("propose_photo_roles", lambda t: P.propose_photo_roles(P.journey_photos(t.photo, t.station)).select("file", "role"),
         """SELECT file, CASE WHEN k>0 AND k<least(4,n) THEN 'sin-clasificar' WHEN rn<=k THEN 'orientacion' ELSE 'especie' END AS role
    FROM (SELECT *, max(CASE WHEN ok AND rn<=4 THEN rn ELSE 0 END) OVER g AS k, count(*) OVER g AS n FROM (
      SELECT *, min(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY date, station_id ORDER BY rn)=1 AS ok FROM (
        SELECT *, row_number() OVER w AS rn, row_number() OVER (PARTITION BY date, station_id, cardinal ORDER BY taken_at, file)=1 AS fresh
        FROM journey WINDOW w AS (PARTITION BY date, station_id ORDER BY taken_at, file)))
      WINDOW g AS (PARTITION BY date, station_id))""")
register("photo_suggestion", lambda t: P.photo_suggestion(t.photo, t.station).select("file", "station_code", "date", "time", "heading"),
         """SELECT file, s.station_code, substr(taken_at,1,10) AS date, substr(taken_at,12,5) AS time, heading
    FROM photo p LEFT JOIN station s ON lower(s.station_code)=lower(trim(p.label))""")
register("default_station", lambda t: P.default_station(
    t.photo.select(F.col("file").alias("draft_id"), F.when(F.length("file") % 2 == 0, F.col("chosen_station_id")).alias("station_id"),
                   (F.col("chosen_station_id") % 3).alias("project_id"), "lat", "lon", F.substring("taken_at", 12, 5).alias("time")),
    t.station).select("draft_id", "station_id", "new_station_code"),
    """SELECT file AS draft_id, CASE WHEN length(file)%2=0 THEN chosen_station_id ELSE near END AS station_id,
    CASE WHEN length(file)%2=1 AND near IS NULL AND lat IS NOT NULL THEN 'PUNTO-'||substr(taken_at,12,2)||substr(taken_at,15,2) END AS new_station_code
    FROM photo LEFT JOIN (SELECT d.file, arg_min(d.station_id, d.d*1000000+d.station_id) AS near FROM photo_dist d JOIN photo p USING (file)
      JOIN station s ON s.station_id=d.station_id WHERE s.project_id=p.chosen_station_id%3 AND d.d<=150 GROUP BY d.file) USING (file)""")


def _placemarks(t):
    """Placemarks drawn from the GPS points: a third are points, a third lines, a third areas."""
    e = F.col("point_id")
    point = F.struct(F.col("lat"), F.col("lon"), F.lit(None).cast("double").alias("alt"))
    end = F.struct((F.col("lat") + 0.001).alias("lat"), F.col("lon"), F.lit(None).cast("double").alias("alt"))
    kind = F.element_at(F.array(F.lit("punto"), F.lit("linea"), F.lit("area")), (e % 3 + 1).cast("int"))
    return t.track_point.select(
        (F.col("track_id") % 50).alias("file"), e.alias("placemark_no"), F.concat(F.lit("P"), (e % 97).cast("string")).alias("name"),
        F.lit(None).cast("string").alias("folder"), kind.alias("kind"),
        F.when(e % 3 == 0, F.array(point)).otherwise(F.array(point, end)).alias("points"),
    )


register("station_candidates", lambda t: P.station_candidates(_placemarks(t)).select(
    "file", "placemark_no", "name", "kind", "length_m", "repeated_name"),
    """SELECT track_id%50 AS file, point_id AS placemark_no, 'P'||(point_id%97) AS name,
    CASE point_id%3 WHEN 0 THEN 'punto' ELSE 'linea' END AS kind, CASE WHEN point_id%3=1 THEN 111 END AS length_m,
    count(*) OVER (PARTITION BY track_id%50, point_id%97)>1 AS repeated_name FROM track_point WHERE point_id%3<>2""")
