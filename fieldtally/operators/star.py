"""The star join behind every report, and the small lookups that feed it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.survey import live
from fieldtally.session import shared_folder, written

# Reading order of the flat table; the id makes it total.
FLAT_ORDER = ["event_date", "occurrence_time", "created_at", "occurrence_id"]
FACT = ["measurement_type", "measurement_value", "measurement_unit", "measurement_method"]


def flatten(
    occurrences: DataFrame, events: DataFrame, stations: DataFrame,
    taxa: DataFrame, projects: DataFrame, campaigns: DataFrame, facts: DataFrame | None = None,
) -> DataFrame:
    """Live records with their event, station, site, project, campaign and taxon, and their stored facts.

    One shuffle (records with events), after one pass over the records' species. The dimensions carry no hint: Catalyst broadcasts those
    whose size is under the session's limit and shuffles the others, and AQE splits hot keys.
    ``facts`` (occurrence_id and the measurement columns) become an array of each record, in order of
    their type and value; a record has as many as its form has fields.
    """
    dims = _with_dims(
        events.withColumnRenamed("deleted_at", "event_deleted_at"), stations, projects, campaigns
    )
    records = live(occurrences).drop("deleted_at")
    if facts is not None:
        told = [c for c in FACT if c in facts.columns]
        listed = facts.groupBy("occurrence_id").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("facts"))
        records = records.join(listed, "occurrence_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast(listed.schema["facts"].dataType)))
    return records.join(dims, "event_id").join(seen_taxa(taxa, records), "taxon_id", "left")


def seen_taxa(taxa: DataFrame, records: DataFrame) -> DataFrame:
    """The species that ``records`` have, written, so that Catalyst knows their size.

    Records are joined with them whole and wide. A catalogue too large to broadcast would have every record shuffled
    by its species, of which few hold most records; those that were seen are few as a rule.
    """
    return written(taxa.join(records.select("taxon_id").distinct(), "taxon_id", "left_semi"), "seen-taxa")


def write_star(flat: DataFrame, *, buckets: int | None = None) -> DataFrame:
    """The flat records written once, in buckets by event, for reports that read them several times.

    The table lies in the shared folder. Grouping it by event, or joining it with another table by event,
    needs no exchange of the records.
    """
    spark = flat.sparkSession
    folder = shared_folder(spark, "star")
    name = "star_" + folder.rsplit("-", 1)[1]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat.repartition(n, "event_id").write.bucketBy(n, "event_id").sortBy("event_id").option("path", folder).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def on_star(flat: DataFrame, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``report`` of the flat records as ``write_star`` lays them down, with the columns that it reads.

    Catalyst can't prune what is read behind a written table, so all columns would be shuffled and written. Here it
    tells beforehand which of them bear on the report; the others stand empty in the table the report gets.
    """
    used = columns_read(flat, report) | {"event_id"}
    star = write_star(flat.select(*[c for c in flat.columns if c in used]))
    return report(star.select(*[F.col(f.name) if f.name in used else F.lit(None).cast(f.dataType).alias(f.name) for f in flat.schema]))


def columns_read(flat: DataFrame, report: Callable[[DataFrame], DataFrame]) -> set[str]:
    """The columns of ``flat`` that an output, a condition or a key of ``report`` needs, by its optimized plan."""
    spark = flat.sparkSession
    plan = report(spark.createDataFrame(spark.sparkContext.emptyRDD(), flat.schema))._jdf.queryExecution().optimizedPlan()
    items = lambda seq: [seq.apply(i) for i in range(seq.size())]
    ids = lambda attributes: {a.exprId().id() for a in attributes}
    needed, stand_ins, nodes = ids(items(plan.output())), [], [plan]
    while nodes:
        node = nodes.pop()
        children = items(node.children())
        nodes += children
        needed |= ids(items(node.references().toSeq()))
        if node.nodeName() == "Union":  # takes its children's columns by position
            needed |= {i for c in children for i in ids(items(c.output()))}
        if node.nodeName() == "LogicalRDD":
            stand_ins += items(node.output())
    return {a.name() for a in stand_ins if a.exprId().id() in needed} & set(flat.columns)


def _with_dims(events: DataFrame, stations: DataFrame, projects: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Events with their dimensions: joined before the records, so on far fewer rows."""
    joined = (
        events.join(stations.drop("project_id").withColumn("has_station", F.lit(True)), "station_id", "left")
        .join(projects, "project_id", "left")
        .join(campaigns.drop("project_id"), "campaign_id", "left")
    )
    site = F.filter("sites", lambda s: s["site_id"] == F.col("site_id"))
    return joined.withColumns(
        {
            "site_name": F.get(site, F.lit(0))["name"],
            "site_installed_on": F.get(site, F.lit(0))["installed_on"],
            "has_station": F.coalesce("has_station", F.lit(False)),
        }
    ).drop("sites")


def event_rows(events: DataFrame, stations: DataFrame, projects: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Every event with its dimensions, whether or not anything was seen."""
    return _with_dims(
        events.withColumnRenamed("deleted_at", "event_deleted_at"), stations, projects, campaigns
    )


def one_per_key(flat: DataFrame, key: str) -> DataFrame:
    """First flat record of each key in reading order.

    A window of constant bound, so each task keeps its best row of a key, and only those meet; on ``write_star``'s
    table and by event, they already have. Unlike an aggregate of whole rows, it carries only the columns that are read.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*FLAT_ORDER))
    return flat.filter(F.col(key).isNotNull()).withColumn("_place", place).filter("_place = 1").drop("_place")


def recent_records(occurrences: DataFrame, limit: int = 200) -> DataFrame:
    """Newest live records; the limit is the feature (a take-ordered, no full sort)."""
    return live(occurrences).orderBy(F.desc("created_at"), F.desc("occurrence_id")).limit(limit)


def records_by_date(occurrences: DataFrame, events: DataFrame, only_pending: bool = False) -> DataFrame:
    rows = live(occurrences)
    if only_pending:
        rows = rows.filter(F.size("pending_fields") > 0)
    return (
        rows.join(events.select("event_id", "event_date"), "event_id")
        .groupBy("event_date")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def active_event(events: DataFrame) -> DataFrame:
    """Last live event of each station, method and day."""
    return (
        live(events)
        .groupBy("station_id", "method", "event_date")
        .agg(F.max_by("event_id", F.struct("event_time", "event_id")).alias("event_id"))
    )


def derive_catalogs(rows: DataFrame, zone: int = 19, hemisphere: str = "S") -> dict[str, DataFrame]:
    """Projects, campaigns and stations out of a raw station list.

    ``rows``: row_no, project, region, season, station_code, final_code, habitat, slope_aspect,
    utm_east, utm_north and ``methods``; optional site arrays named after their kind.
    """
    from fieldtally.functions.geo import ensure_latlon
    from fieldtally.functions.survey import dwc_id
    from fieldtally.functions.text import blank

    named = rows.filter(~blank("project"))
    project_id = F.concat(F.lit("proj_"), F.regexp_replace(F.lower("project"), r"\s+", "-"))
    projects = named.groupBy("project").agg(
        F.min_by("region", "row_no").alias("region"), F.min("row_no").alias("first_row")
    ).select(
        project_id.alias("project_id"), F.col("project").alias("project_code"), "region", "first_row",
        F.lit(zone).alias("utm_zone"), F.lit("WGS84").alias("datum"),
    )
    campaigns = (
        named.filter(~blank("season")).select("project", "season").distinct()
        .select(
            F.concat(F.lit("camp_"), project_id, F.lit("_"), F.lower("season")).alias("campaign_id"),
            project_id.alias("project_id"),
            F.concat_ws(" ", "season", "project").alias("campaign_name"),
            F.col("season").alias("campaign_season"),
        )
    )
    default = F.array(F.lit("transecto"))
    stations = rows.select(
        F.when(~blank("project"), project_id).otherwise("proj_desconocido").alias("project_id"),
        "station_code",
        F.coalesce("final_code", "station_code").alias("final_code"),
        dwc_id("survey", F.coalesce("project", F.lit("survey")), "loc", "station_code").alias("dwc_location_id"),
        "region", "season", "habitat", "slope_aspect", "utm_east", "utm_north",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.when(F.size("methods") > 0, F.col("methods")).otherwise(default).alias("methods"),
        unified_sites(rows).alias("sites"),
    )
    return {"projects": projects, "campaigns": campaigns, "stations": ensure_latlon(stations, zone, hemisphere)}


def unified_sites(rows: DataFrame):
    """The per-kind site lists of a raw station, joined into one array with the kind as a field."""
    kinds = ["playback_aves", "playback_anfibios", "camara_trampa", "trampa_sherman"]
    parts = [
        F.transform(
            F.coalesce(F.col(kind), F.array().cast("array<string>")),
            lambda name, kind=kind: F.struct(F.lit(kind).alias("kind"), name.alias("name")),
        )
        for kind in kinds
        if kind in rows.columns
    ]
    empty = F.array().cast("array<struct<kind:string,name:string>>")
    return F.concat(*parts) if parts else empty


def guarded_delete(targets: DataFrame, events: DataFrame, key: str) -> dict[str, DataFrame]:
    """Rows that may be deleted (no event refers to them) and those that may not."""
    used = events.select(key).distinct()
    return {
        "deletable": targets.join(used, key, "left_anti"),
        "blocked": targets.join(used, key, "left_semi"),
    }
