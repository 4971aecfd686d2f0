"""Stations near a position: cell joins instead of comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.geo import haversine_m, rounded_m, spread_to_neighbours, with_cell
from fieldtally.functions.survey import cardinal_of
from fieldtally.operators.cell_tree import nearest_places

CELL = ["cx", "cy", "cz"]


def _distinct_places(stations: DataFrame) -> DataFrame:
    """Stations with coordinates; of several at one exact place the lowest id speaks."""
    return (
        stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
        .agg(F.min("station_id").alias("n_station_id"))
    )


def nearest_by_position(positions: DataFrame, stations: DataFrame, max_m: float | None = None) -> DataFrame:
    """(lat, lon, nearest_station_id, nearest_m) of each distinct position that has a nearest station (within ``max_m``):
    rounded metres, ties to the lowest id."""
    spots = positions.select("lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    best = nearest_places(spots, _distinct_places(stations), max_m)
    if best is None:
        return spots.filter(F.lit(False)).select("lat", "lon", F.lit(None).cast("bigint").alias("nearest_station_id"), F.lit(None).cast("bigint").alias("nearest_m"))
    return best.select("lat", "lon", F.col("best.station_id").alias("nearest_station_id"), F.col("best.d").alias("nearest_m"))


def nearest_station(fixes: DataFrame, stations: DataFrame, max_m: float | None = None) -> DataFrame:
    """Adds nearest_station_id and nearest_m (null without coordinates, without stations, or with none within ``max_m``).

    Fixes without coordinates go past the join: as one null key they would all meet in one task.
    """
    nearest = nearest_by_position(fixes, stations, max_m)
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    blank = fixes.filter(~placed).withColumns({c: F.lit(None).cast("bigint") for c in ("nearest_station_id", "nearest_m")})
    return fixes.filter(placed).join(nearest, ["lat", "lon"], "left").unionByName(blank)


def suggest_stations(fixes: DataFrame, stations: DataFrame, *, max_m: float = 500, k: int = 3) -> DataFrame:
    """The nearest ``k`` stations within ``max_m``; ``within_accuracy`` uses the unrounded distance.

    ``fixes``: fix_id, lat, lon, acc. The top k is an aggregate of at most k best per partial
    group, so that a crowded cell never sits in one task.
    """
    size = float(max_m) + 1.0
    places = with_cell(
        stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
            "station_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")
        ),
        "s_lat", "s_lon", size,
    )
    spots = fixes.select("lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    candidates = (
        spread_to_neighbours(spots, "lat", "lon", size)
        .join(places, CELL)
        .withColumn("exact_m", haversine_m("lat", "lon", "s_lat", "s_lon"))
        .withColumn("distance_m", F.floor(F.col("exact_m") + 0.5).cast("bigint"))
        .filter(F.col("distance_m") <= max_m)
    )
    from pyspark.sql import Window

    # row_number with a constant bound is cut per partition before the shuffle.
    order = Window.partitionBy("lat", "lon").orderBy("distance_m", "station_id")
    best = candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return fixes.join(best.select("lat", "lon", "station_id", "distance_m", "exact_m", "rank"), ["lat", "lon"]).select(
        "fix_id", "station_id", "distance_m", "rank",
        (F.col("exact_m") <= F.coalesce("acc", F.lit(0.0))).alias("within_accuracy"),
    )


def station_drift(fixes: DataFrame, stations: DataFrame, *, limit_m: int = 200) -> DataFrame:
    """Fixes farther than ``limit_m`` and than their own accuracy from the chosen station, with the
    nearest other station that is strictly closer, if any.

    ``fixes``: fix_id, lat, lon, acc, chosen_station_id.
    """
    chosen = stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col("station_id").alias("chosen_station_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")
    )
    distance = rounded_m("lat", "lon", "c_lat", "c_lon")
    drifted = (
        fixes.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .join(chosen, "chosen_station_id")
        .withColumn("distance_m", distance)
        .filter((F.col("distance_m") > limit_m) & (F.col("distance_m") > F.coalesce("acc", F.lit(0.0))))
    )
    closer = F.col("nearest_m") < F.col("distance_m")
    return nearest_station(drifted, stations).select(
        "fix_id", "chosen_station_id", "distance_m",
        F.when(closer, F.col("nearest_station_id")).alias("nearer_station_id"),
        F.when(closer, F.col("nearest_m")).alias("nearer_m"),
    )


def _codes(stations: DataFrame) -> DataFrame:
    """One station per lower-cased code (the lowest id when a code repeats)."""
    return stations.groupBy(F.lower("station_code").alias("_code")).agg(
        F.min_by(F.struct("station_id", "lat", "lon"), "station_id").alias("labelled")
    )


def locate_photos(photos: DataFrame, stations: DataFrame) -> DataFrame:
    """Photos with their nearest station and the station their label names, computed once."""
    trimmed = F.trim(F.coalesce("label", F.lit("")))
    return nearest_station(photos, stations).join(
        _codes(stations), F.lower(trimmed) == F.col("_code"), "left"
    ).drop("_code")


def label_status(tolerance_m: int = 200):
    """sin-etiqueta, desconocida, sin-verificar, coincide or desfasada, over ``locate_photos``."""
    text = F.trim(F.coalesce("label", F.lit("")))
    to_label = rounded_m("lat", "lon", "labelled.lat", "labelled.lon")
    return (
        F.when(text == "", "sin-etiqueta")
        .when(F.col("labelled").isNull(), "desconocida")
        .when(to_label.isNull(), "sin-verificar")
        .when(
            (to_label <= tolerance_m) | F.col("nearest_station_id").isNull()
            | (F.col("nearest_station_id") == F.col("labelled.station_id")),
            "coincide",
        )
        .otherwise("desfasada")
    )


def check_photo_label(photos: DataFrame, stations: DataFrame, *, tolerance_m: int = 200) -> DataFrame:
    """Label against GPS for each photo (file, lat, lon, label)."""
    located = locate_photos(photos, stations).withColumn("status", label_status(tolerance_m))
    to_label = rounded_m("lat", "lon", "labelled.lat", "labelled.lon")
    checked = F.col("status").isin("coincide", "desfasada")
    off = F.col("status") == "desfasada"
    return located.select(
        "file", "label", "status",
        F.when(checked, to_label).alias("label_m"),
        F.when(off, F.col("nearest_station_id")).alias("nearest_station_id"),
        F.when(off, F.col("nearest_m")).alias("nearest_m"),
    )


def journey_photos(photos: DataFrame, stations: DataFrame, *, max_station_m: int = 300) -> DataFrame:
    """Each photo with its date, GPS-assigned station, compass point and label check."""
    located = locate_photos(photos, stations).withColumn("status", label_status())
    near = F.col("nearest_m") <= max_station_m
    return located.select(
        "file", "taken_at", "lat", "lon", "heading",
        F.coalesce(F.substring("taken_at", 1, 10), F.lit("sin fecha")).alias("date"),
        F.when(near, F.col("nearest_station_id")).alias("station_id"),
        "nearest_m",
        cardinal_of("heading").alias("cardinal"),
        "status",
    )


def propose_photo_roles(journey: DataFrame, *, shots: int = 4) -> DataFrame:
    """Role of each photo: orientacion, especie or sin-clasificar.

    Only the first ``shots`` photos of a group decide, so a bounded head per group is enough;
    the rest of a large group is never sorted. The journey is read three times, so it is
    written to the checkpoint folder once instead of being located three times.
    """
    from pyspark.sql import Window

    from fieldtally.session import cut_lineage

    journey = cut_lineage(journey)
    group = ["date", "station_id"]
    moment = F.struct(F.coalesce("taken_at", F.lit("")).alias("t"), F.col("file").alias("f"))
    order = Window.partitionBy(*group).orderBy(F.coalesce("taken_at", F.lit("")), "file")
    head = (
        journey.select(*group, "cardinal", moment.alias("moment"), F.row_number().over(order).alias("rn"))
        .filter(F.col("rn") <= shots)
    )
    ordered = head.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rn", "cardinal", "moment"))).alias("head"))
    points = F.col("head.cardinal")
    # Longest prefix whose compass points are all known and different.
    prefix = F.greatest(
        F.lit(0),
        *[
            F.when(
                (F.size("head") >= n)
                & F.forall(F.slice(points, 1, n), lambda p: p.isNotNull())
                & (F.size(F.array_distinct(F.slice(points, 1, n))) == n),
                F.lit(n),
            ).otherwise(0)
            for n in range(1, shots + 1)
        ],
    )
    totals = journey.groupBy(*group).agg(F.count(F.lit(1)).alias("n_photos"))
    nulls = (F.col("a.date").eqNullSafe(F.col("b.date"))) & (F.col("a.station_id").eqNullSafe(F.col("b.station_id")))
    decided = (
        ordered.withColumn("assigned", prefix).alias("a").join(totals.alias("b"), nulls)
        .select(
            F.col("a.date").alias("g_date"), F.col("a.station_id").alias("g_station"), "assigned", "n_photos",
            F.when(F.col("assigned") > 0, F.element_at("head", F.col("assigned").cast("int"))["moment"]).alias("last"),
        )
    )
    same = F.col("date").eqNullSafe(F.col("g_date")) & F.col("station_id").eqNullSafe(F.col("g_station"))
    role = (
        F.when((F.col("assigned") > 0) & (F.col("assigned") < F.least(F.lit(shots), "n_photos")), "sin-clasificar")
        .when(moment <= F.col("last"), "orientacion")
        .otherwise("especie")
    )
    return journey.join(decided, same).select(*journey.columns, role.alias("role"))


def journey_groups(journey: DataFrame) -> DataFrame:
    """Photos per date and assigned station, with the time span instead of the list itself."""
    return journey.groupBy("date", "station_id").agg(
        F.count(F.lit(1)).alias("photos"),
        F.min_by("file", F.struct(F.coalesce("taken_at", F.lit("")), "file")).alias("first_file"),
        F.max_by("file", F.struct(F.coalesce("taken_at", F.lit("")), "file")).alias("last_file"),
        F.count_if(F.col("status") == "desfasada").alias("mislabelled"),
    )


def journey_summary(journey: DataFrame) -> DataFrame:
    # First per (date, station), so that distinct counts see one row per group.
    small = journey.groupBy("date", "station_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("no_gps"),
        F.count_if(F.col("status") == "desfasada").alias("off"),
    )
    return small.agg(
        F.count_distinct("date").alias("days"),
        F.count_distinct("station_id").alias("stations"),
        F.sum("n").alias("photos"),
        F.sum("no_gps").alias("without_gps"),
        F.coalesce(F.sum(F.when(F.col("station_id").isNull(), F.col("n"))), F.lit(0)).alias("unassigned"),
        F.sum("off").alias("mislabelled"),
    )


def photo_suggestion(photos: DataFrame, stations: DataFrame) -> DataFrame:
    """Prefill of a photo's form: the station only when its label is a known code."""
    trimmed = F.trim(F.coalesce("label", F.lit("")))
    known = stations.groupBy(F.lower("station_code").alias("_code")).agg(F.min("station_code").alias("station_code"))
    return photos.join(known, F.lower(trimmed) == F.col("_code"), "left").select(
        "file", "station_code",
        F.substring("taken_at", 1, 10).alias("date"), F.substring("taken_at", 12, 5).alias("time"),
        "lat", "lon", "heading",
    )


def default_station(drafts: DataFrame, stations: DataFrame, *, max_m: int = 150) -> DataFrame:
    """Drafts without a station take the nearest one within ``max_m``, else a new PUNTO-hhmm station.

    ``drafts``: draft_id, station_id, project_id, lat, lon, time. Only stations of the draft's
    own project count.
    """
    size = float(max_m) + 1.0
    places = with_cell(
        stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
            "project_id", F.col("station_id").alias("s_id"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")
        ),
        "s_lat", "s_lon", size,
    )
    open_spots = (
        drafts.filter(F.col("station_id").isNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .select("project_id", "lat", "lon").distinct()
    )
    near = (
        spread_to_neighbours(open_spots, "lat", "lon", size)
        .join(places, CELL + ["project_id"])
        .withColumn("d", rounded_m("lat", "lon", "s_lat", "s_lon"))
        .filter(F.col("d") <= max_m)
        .groupBy("project_id", "lat", "lon")
        .agg(F.min_by("s_id", F.struct("d", "s_id")).alias("near_id"))
    )
    joined = drafts.join(near, ["project_id", "lat", "lon"], "left")
    needs_new = F.col("station_id").isNull() & F.col("near_id").isNull() & F.col("lat").isNotNull()
    return joined.select(
        "draft_id", "project_id",
        F.coalesce("station_id", "near_id").alias("station_id"),
        F.when(needs_new, F.concat(F.lit("PUNTO-"), F.translate("time", ":", ""))).alias("new_station_code"),
        F.when(needs_new, F.col("lat")).alias("new_lat"),
        F.when(needs_new, F.col("lon")).alias("new_lon"),
    )


def station_candidates(placemarks: DataFrame) -> DataFrame:
    """Stations proposed by map placemarks: areas dropped, lines give an end point and a length.

    Names are compared as written; one that repeats in its file is flagged.

    ``placemarks``: file, placemark_no, name, folder, kind, points array<struct<lat,lon,alt>>.
    """
    from fieldtally.functions.geo import path_length_m

    usable = placemarks.filter((F.col("kind") != "area") & (F.size("points") > 0))
    names = usable.groupBy("file", "name").agg(F.count(F.lit(1)).alias("_n"))
    line = F.col("kind") == "linea"
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    ends = line & (F.size("points") > 1)
    return usable.join(names, ["file", "name"], "left").select(
        "file", "placemark_no", "name", "folder", "kind",
        first["lat"].alias("lat"), first["lon"].alias("lon"), first["alt"].alias("alt"),
        F.when(ends, last["lat"]).alias("end_lat"), F.when(ends, last["lon"]).alias("end_lon"),
        F.when(line, path_length_m(F.col("points"))).alias("length_m"),
        (F.col("_n") > 1).alias("repeated_name"),
    )
