"""Joining what two devices recorded: previews, restores, upserts and possible double counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.geo import ensure_latlon
from fieldtally.functions.survey import live
from fieldtally.functions.text import blank, fold, hhmm_to_minutes
from fieldtally.session import written


def _differs(columns: list[str]) -> Column:
    """Null-safe comparison field by field: the order in which a device wrote its keys is no change."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return out


def _paired(local: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    columns = [c for c in incoming.columns if c != key]
    pack = lambda df, name: df.select(F.col(key), F.struct(*[F.col(c) for c in columns]).alias(name))
    return pack(local, "l").join(pack(incoming, "r"), key, "full_outer"), columns


def merge_preview(local: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """One row: live incoming rows that are new, already there, or there with other content."""
    pairs, columns = _paired(local, live(incoming), key)
    arrived = F.col("r").isNotNull()
    both = arrived & F.col("l").isNotNull()
    return pairs.agg(
        F.count_if(arrived & F.col("l").isNull()).alias("new_rows"),
        F.count_if(both).alias("already_there"),
        F.count_if(both & _differs(columns)).alias("in_conflict"),
    )


def merge_reach(incoming_events: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """Long list (what, value) of the days, stations and observers the other device covers."""
    rows = incoming_events
    if stations is not None:
        rows = rows.join(stations.select("station_id", "station_code"), "station_id", "left")
        station = F.coalesce(F.col("station_code"), F.col("station_id").cast("string"))
    else:
        station = F.col("station_id").cast("string")
    alive = F.col("deleted_at").isNull()
    items = F.array_compact(
        F.array(
            F.when(alive, F.struct(F.lit("day").alias("what"), F.col("event_date").alias("value"))),
            F.when(alive, F.struct(F.lit("station").alias("what"), station.alias("value"))),
            F.when(~blank("recorded_by"), F.struct(F.lit("observer").alias("what"), F.col("recorded_by").alias("value"))),
        )
    )
    return rows.select(F.explode(items).alias("i")).select("i.what", "i.value").distinct()


def merge_warnings(reach: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Warnings about a backup: photographs left out, or no sampling at all."""
    no_days = reach.agg(F.count_if(F.col("what") == "day").alias("n")).filter(F.col("n") == 0).select(
        F.lit("El respaldo no trae ningún muestreo.").alias("warning")
    )
    if media is None:
        return no_days
    omitted = media.agg(F.coalesce(F.max("blob_omitted"), F.lit(False)).alias("any")).filter("any").select(
        F.lit("El respaldo se exportó sin las fotografías: se van a unir los registros, pero las imágenes de tu"
              " compañero no vienen.").alias("warning")
    )
    return omitted.unionByName(no_days)


def merge_backups(local: DataFrame, incoming: DataFrame, *, mode: str = "fusionar", key: str = "id") -> DataFrame:
    """The table after a restore, with an ``action`` per row.

    fusionar: local rows stay, missing ones are inserted, differing ones are reported.
    reemplazar: the incoming row wins per key; rows only known locally stay.
    """
    if mode not in ("fusionar", "reemplazar"):
        raise ValueError(f"unknown mode {mode!r}")
    keyed = incoming.filter(F.col(key).isNotNull())
    pairs, columns = _paired(local, keyed, key)
    first, second = ("l", "r") if mode == "fusionar" else ("r", "l")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    action = (
        F.when(F.col("r").isNull(), "local")
        .when(F.col("l").isNull(), "inserted")
        .when(F.lit(mode == "reemplazar"), "replaced")
        .when(_differs(columns), "conflict")
        .otherwise("skipped")
    )
    chosen = F.when(both | F.col(first).isNotNull(), F.col(first)).otherwise(F.col(second))
    return pairs.select(key, chosen.alias("row"), action.alias("action")).select(key, "row.*", "action")


def merge_report(merged: DataFrame) -> DataFrame:
    """inserted, skipped and conflicts as the restore reports them (a conflict is also skipped)."""
    return merged.agg(
        F.count_if(F.col("action").isin("inserted", "replaced")).alias("inserted"),
        F.count_if(F.col("action").isin("skipped", "conflict")).alias("skipped"),
        F.count_if(F.col("action") == "conflict").alias("conflicts"),
    )


def declared_count_gaps(read_counts: DataFrame, declared: DataFrame) -> DataFrame:
    """Tables whose declared row count differs from what was read (both: table, rows)."""
    return (
        declared.withColumnRenamed("rows", "declared")
        .join(read_counts, "table", "left")
        .select("table", "declared", F.coalesce("rows", F.lit(0)).alias("read"))
        .filter(F.col("declared") != F.col("read"))
    )


def double_counts(incoming: DataFrame, local: DataFrame, *, window_min: int = 30, split_rows: int = 5_000) -> DataFrame:
    """Pairs of records that two people probably took of one animal.

    Same station, date and taxon (or the same name as said when either lacks a taxon), other id,
    other observer, at most ``window_min`` minutes apart. Inputs: occurrence_id, station_id,
    event_date, occurrence_time, taxon_id, verbatim_taxon, recorded_by, deleted_at.

    Minutes are cut into slots of the window's length, so a row meets its own and the two touching
    slots. One summary row a slot (its first and last observer, its earliest and latest minute) goes
    ahead: rows that meet no slot with another observer in reach never enter the join, however many one
    person took. Slots of more than ``split_rows`` local rows are dealt over several tasks.
    """
    key = ["subject", "station_id", "event_date", "slot"]

    def prepared(df: DataFrame) -> DataFrame:
        rows = live(df).withColumn("minute", hhmm_to_minutes("occurrence_time")).filter(F.col("minute").isNotNull())
        said = F.nullif(F.lower(F.trim(F.coalesce("verbatim_taxon", F.lit("")))), F.lit(""))
        # Two subjects: the taxon when both have one, else the name as said.
        subjects = F.array_compact(
            F.array(
                F.when(F.col("taxon_id").isNotNull(), F.concat(F.lit("t:"), F.col("taxon_id").cast("string"))),
                F.when(said.isNotNull(), F.concat(F.lit("v:"), said)),
            )
        )
        return rows.select(
            F.explode(subjects).alias("subject"), "station_id", "event_date", F.floor(F.col("minute") / window_min).alias("slot"),
            "occurrence_id", "minute", "occurrence_time", "taxon_id", F.coalesce("recorded_by", F.lit("")).alias("observer"),
        )

    touching = F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))
    extent = [F.min("first").alias("first"), F.max("last").alias("last"), F.min("from").alias("from"), F.max("to").alias("to")]
    # The empty observer comes first, and is another one to anybody.
    another = (F.col("observer") == "") | (F.col("first") != F.col("observer")) | (F.col("last") != F.col("observer"))
    reach = another & (F.col("minute") >= F.col("from") - window_min) & (F.col("minute") <= F.col("to") + window_min)

    def slots(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(
            F.min("observer").alias("first"), F.max("observer").alias("last"), F.min("minute").alias("from"), F.max("minute").alias("to"),
            F.ceil(F.count(F.lit(1)) / split_rows).cast("int").alias("parts"))

    # Both sides and the slots are read twice each, and come out of joins: they are written once.
    ours, theirs = written(prepared(local), "local-records"), written(prepared(incoming), "incoming-records")
    our_slots = written(slots(ours), "local-slots")
    # Incoming rows go to each touching slot that is worth it, once for each of its parts.
    a = theirs.withColumn("slot", touching).join(our_slots, key).filter(reach).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Local rows stay in their slot, in one of its parts, if any touching slot of the other side is worth it.
    their_reach = slots(theirs).withColumn("slot", touching).groupBy(*key).agg(*extent)
    b = ours.join(their_reach, key).filter(reach).drop("first", "last", "from", "to").join(our_slots.select(*key, "parts"), key)
    b = b.withColumn("part", F.pmod(F.xxhash64("occurrence_id"), F.col("parts")).cast("int"))
    pair = a.alias("a").join(b.alias("b"), [*key, "part"])
    both_taxa = F.col("a.taxon_id").isNotNull() & F.col("b.taxon_id").isNotNull()
    same_person = (F.col("a.observer") != "") & (F.col("a.observer") == F.col("b.observer"))
    return (
        pair.filter(
            (F.col("a.occurrence_id") != F.col("b.occurrence_id"))
            & (F.abs(F.col("a.minute") - F.col("b.minute")) <= window_min)
            & ~same_person
            & (F.col("subject").startswith("t:") == both_taxa)
        )
        .select(
            F.coalesce(F.col("a.taxon_id").cast("string"), F.expr("substring(subject, 3)")).alias("taxon"), "station_id", "event_date",
            F.col("b.occurrence_id").alias("local_id"), F.col("a.occurrence_id").alias("incoming_id"),
            F.col("b.occurrence_time").alias("local_time"), F.col("a.occurrence_time").alias("incoming_time"),
            F.when(F.col("b.observer") != "", F.col("b.observer")).otherwise("sin observador").alias("local_observer"),
            F.when(F.col("a.observer") != "", F.col("a.observer")).otherwise("sin observador").alias("incoming_observer"),
        )
    )


# --- upserts ------------------------------------------------------------------------------

def upsert_stations(existing: DataFrame, candidates: DataFrame, *, zone: int = 19, hemisphere: str = "S",
                    prefix: str = "") -> DataFrame:
    """Import candidates by lower-cased code: the id and earlier attributes stay, positions are new.

    ``candidates``: station_code, project_id, lat, lon, end_lat, end_lon. A repeated code keeps
    its last row by ``candidate_no``.
    """
    from fieldtally.functions.geo import to_utm

    named = candidates.withColumn("station_code", F.concat(F.lit(prefix), F.col("station_code")))
    last = named.groupBy(F.lower("station_code").alias("_code")).agg(
        F.max_by(F.struct("station_code", "project_id", "lat", "lon", "end_lat", "end_lon"), "candidate_no").alias("c")
    )
    point, end = to_utm("c.lat", "c.lon", F.lit(zone)), to_utm("c.end_lat", "c.end_lon", F.lit(zone))
    has_end = F.col("c.end_lat").isNotNull()
    joined = existing.withColumn("_code", F.lower("station_code")).join(last, "_code", "full_outer")
    new_id = F.sha1(F.concat_ws("|", F.col("c.project_id").cast("string"), F.col("_code")))
    arrived = F.col("c").isNotNull()
    return joined.select(
        F.coalesce(F.col("station_id").cast("string"), new_id).alias("station_id"),
        F.coalesce("station_code", "c.station_code").alias("station_code"),
        F.coalesce(existing["project_id"], F.col("c.project_id")).alias("project_id"),
        F.when(arrived, F.col("c.lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(arrived, F.col("c.lon")).otherwise(F.col("lon")).alias("lon"),
        F.when(arrived, point["east"]).otherwise(F.col("utm_east")).alias("utm_east"),
        F.when(arrived, point["north"]).otherwise(F.col("utm_north")).alias("utm_north"),
        F.when(arrived & has_end, point["east"]).otherwise(F.col("utm_start_east")).alias("utm_start_east"),
        F.when(arrived & has_end, point["north"]).otherwise(F.col("utm_start_north")).alias("utm_start_north"),
        F.when(arrived & has_end, end["east"]).otherwise(F.col("utm_end_east")).alias("utm_end_east"),
        F.when(arrived & has_end, end["north"]).otherwise(F.col("utm_end_north")).alias("utm_end_north"),
        "region", "habitat",
        F.when(F.col("methods").isNull(), F.array(F.lit("transecto"))).otherwise(F.col("methods")).alias("methods"),
        F.when(F.col("station_id").isNull(), "inserted").when(arrived, "updated").otherwise("kept").alias("action"),
    )


def upsert_sites(sites: DataFrame, requests: DataFrame) -> DataFrame:
    """Named sites of stations in long form (station_id, kind, name): add those whose lower-cased
    name the station does not have yet; a name asked for twice is added once."""
    fresh = (
        requests.filter(~blank(F.trim("name")))
        .groupBy("station_id", F.lower(F.trim("name")).alias("_name"))
        .agg(F.min_by(F.struct(F.trim("name").alias("name"), "kind"), F.struct("name", "kind")).alias("s"))
    )
    known = sites.select("station_id", F.lower(F.trim("name")).alias("_name")).distinct()
    added = fresh.join(known, ["station_id", "_name"], "left_anti").select(
        "station_id", "s.kind", "s.name", F.lit(True).alias("added")
    )
    return sites.select("station_id", "kind", "name", F.lit(False).alias("added")).unionByName(added)


def upsert_catalog(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge a species list by folded scientific (else common) name.

    Ids, alternative names and conservation of known species stay. ``incoming``: row_no,
    common_name, scientific_name, tax_group; the first row of a name wins. Common names shared by
    two species are flagged.
    """
    key = lambda: fold(F.coalesce(F.nullif(F.trim("scientific_name"), F.lit("")), F.col("common_name")))
    group = F.when(F.col("tax_group") == "otro", "otros").otherwise(F.col("tax_group"))
    fresh = (
        incoming.filter(~blank(F.trim(F.coalesce("scientific_name", "common_name", F.lit("")))))
        .withColumns({"_key": key(), "tax_group": group})
        .groupBy("_key")
        .agg(F.min_by(F.struct("common_name", "scientific_name", "tax_group"), "row_no").alias("n"))
    )
    known = (
        existing.withColumn("_key", key())
        .groupBy("_key")
        .agg(F.min_by(F.struct("taxon_id", "rce", "other_names"), "taxon_id").alias("k"))
    )
    merged = fresh.join(known, "_key", "left").select(
        F.coalesce(F.col("k.taxon_id").cast("string"), F.sha1("_key")).alias("taxon_id"),
        "n.common_name", "n.scientific_name", "n.tax_group", F.col("k.rce").alias("rce"),
        F.coalesce("k.other_names", F.array().cast("array<string>")).alias("other_names"),
        F.col("k").isNull().alias("is_new"),
    )
    shared = merged.groupBy(fold("common_name").alias("_name")).agg(F.count_distinct("taxon_id").alias("_n"))
    return (
        merged.withColumn("_name", fold("common_name")).join(shared, "_name", "left")
        .withColumn("ambiguous", F.col("_n") > 1).drop("_name", "_n")
    )
