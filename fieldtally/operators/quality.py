"""Data quality: double saves, missing effort, weak records, tallies and daily figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import survey as S
from fieldtally.functions.text import blank, fold
from fieldtally.operators.effort import effort_summary
from fieldtally.operators.ordered import running_sum_by_bucket
from fieldtally.operators.star import seen_taxa
from fieldtally.session import written

ISSUE_COLUMNS = ["kind", "severity", "message", "event_id", "occurrence_id", "n_records"]
TAXON_COLUMNS = ["taxon_id", "common_name", "rce", "iucn", "origin", "tax_group", "tax_order"]


def severity_rank(c="severity"):
    return F.when(F.col(c) == "alta", 3).when(F.col(c) == "media", 2).otherwise(1)


# --- double saves -------------------------------------------------------------------------

def duplicate_clusters(occurrences: DataFrame, *, window_s: int = 60, bucket_s: int = 3600) -> DataFrame:
    """One row per record that belongs to a suspected double save, with its cluster.

    Records of one event, taxon (or name as said) and type are chained while each is at most
    ``window_s`` after the previous one and not from the same dictation batch.
    """
    keys = ["event_id", "_subject", "record_type"]
    order = ["created_at", "occurrence_id"]
    subject = F.coalesce(F.col("taxon_id").cast("string"), F.col("verbatim_taxon"), F.lit("?"))
    rows = S.live(occurrences).select(
        "occurrence_id", "event_id", "record_type", "batch_id", "created_at", subject.alias("_subject")
    )
    links = _neighbour_links(rows, keys, order, window_s, bucket_s)
    # Only rows linked to a neighbour go on: a small share, numbered in two levels.
    linked = links.filter(F.col("_to_previous") | F.col("_to_next")).withColumn(
        "_new", F.when(F.col("_to_previous"), 0).otherwise(1)
    )
    bucket = F.floor(F.unix_timestamp("created_at") / bucket_s)
    numbered = running_sum_by_bucket(linked, keys, order, bucket, "_new", "_cluster")

    sizes = (
        numbered.groupBy(*keys, "_cluster")
        .agg(
            F.count(F.lit(1)).alias("cluster_size"),
            F.min_by("occurrence_id", F.struct(*order)).alias("cluster_id"),
        )
        .filter(F.col("cluster_size") >= 2)
    )
    return numbered.join(sizes, keys + ["_cluster"]).select(
        "cluster_id", "cluster_size", "occurrence_id", "event_id", "record_type", "created_at"
    )


def _neighbour_links(rows: DataFrame, keys: list[str], order: list[str], window_s: int, bucket_s: int) -> DataFrame:
    """Whether each row chains to the previous and to the next one of its key.

    Time is cut into buckets so that a key with a large share of the rows spreads over tasks.
    Rows near a bucket's edge are shown to the neighbouring bucket as well, which is all a rule
    with a limited gap needs: one shuffle, no join.
    """
    from pyspark.sql import Window

    seconds = F.unix_timestamp("created_at")
    home = F.floor(seconds / bucket_s)
    seen_in = F.array_distinct(
        F.array(home, F.floor((seconds - window_s - 1) / bucket_s), F.floor((seconds + window_s + 1) / bucket_s))
    )
    shown = rows.withColumn("_home", home).withColumn("_bucket", F.explode(seen_in))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)

    def chained(earlier_at, later_at, earlier_batch, later_batch):
        gap_us = F.unix_micros(later_at) - F.unix_micros(earlier_at)
        same_batch = F.coalesce(~blank(later_batch) & (earlier_batch == later_batch), F.lit(False))
        return F.coalesce((gap_us <= window_s * 1000000) & ~same_batch, F.lit(False))

    at, batch = F.col("created_at"), F.col("batch_id")
    return (
        shown.withColumns(
            {
                "_to_previous": chained(F.lag(at).over(w), at, F.lag(batch).over(w), batch),
                "_to_next": chained(at, F.lead(at).over(w), batch, F.lead(batch).over(w)),
            }
        )
        .filter(F.col("_bucket") == F.col("_home"))
        .select(*rows.columns, "_to_previous", "_to_next")
    )


def q_duplicate(occurrences: DataFrame, events: DataFrame, taxa: DataFrame, *, window_s: int = 60) -> DataFrame:
    """One issue per cluster; the members are the rows of ``duplicate_clusters``."""
    clusters = duplicate_clusters(occurrences, window_s=window_s).filter(
        F.col("cluster_id") == F.col("occurrence_id")
    )
    named = (
        clusters.join(occurrences.select("occurrence_id", "taxon_id", "verbatim_taxon"), "occurrence_id")
        .join(taxa.select("taxon_id", "common_name"), "taxon_id", "left")
        .join(events.select("event_id", "event_time"), "event_id", "left")
    )
    name = F.when(F.col("taxon_id").isNotNull(), F.coalesce("common_name", F.lit("—"))).otherwise(
        F.coalesce("verbatim_taxon", F.lit("—"))
    )
    message = F.concat(
        F.col("cluster_size").cast("string"), F.lit(" registros de "), name,
        F.lit(" ("), F.col("record_type"), F.lit(") en "), F.coalesce("event_time", F.lit("la misma hora")),
        F.lit(" con menos de un minuto entre sí. ¿Es un doble guardado?"),
    )
    return named.select(
        F.lit("duplicado").alias("kind"), F.lit("alta").alias("severity"), message.alias("message"),
        "event_id", F.col("cluster_id").alias("occurrence_id"), F.col("cluster_size").alias("n_records"),
    )


# --- effort and weak records --------------------------------------------------------------

def records_per_event(occurrences: DataFrame) -> DataFrame:
    return S.live(occurrences).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_records"))


def q_effort_gap(events: DataFrame, occurrences: DataFrame, *, now: str = "2030-01-01 00:00:00") -> DataFrame:
    """Effort that was started and left half measured."""
    gaps = effort_summary(S.live(events), now=now).filter(F.col("measured") & F.col("incomplete"))
    counted = gaps.join(records_per_event(occurrences), "event_id", "left")
    message = F.concat(
        F.lit("Muestreo del "), F.col("event_date"), F.lit(" "), F.col("event_time"),
        F.lit(": se activó la medición de esfuerzo pero quedó a medias ("), F.col("unit"), F.lit(")."),
    )
    return counted.select(
        F.lit("sin-esfuerzo").alias("kind"),
        F.when(F.col("n_records").isNotNull(), "media").otherwise("baja").alias("severity"),
        message.alias("message"), "event_id", F.lit(None).cast("string").alias("occurrence_id"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
    )


def weak_rules() -> dict[str, tuple]:
    """kind -> (severity, condition, message) over a live record joined to its taxon."""
    name = F.coalesce("common_name", "verbatim_taxon", F.lit("registro"))
    reason = S.location_fix_reason("rce", "iucn", "tax_group", "tax_order", "record_type")
    no_media = F.size("media_ids") == 0
    return {
        "sin-evidencia": (
            "alta", S.is_threatened("rce", "iucn") & no_media,
            F.concat(name, F.lit(" está en categoría de amenaza y no tiene fotografía. Es el registro que más se"
                                 " va a cuestionar en la revisión.")),
        ),
        "identificacion-dudosa": (
            "media", ~blank("confidence") & (F.col("confidence") != "seguro") & no_media,
            F.concat(name, F.lit(' quedó como identificación "'), F.col("confidence"),
                     F.lit('" y sin evidencia que permita confirmarla.')),
        ),
        "sin-coordenada": (
            "media", reason.isNotNull() & F.col("fix_lat").isNull(),
            F.concat(name, F.lit(" sin coordenada propia ("), reason, F.lit(").")),
        ),
        "sin-abundancia": (
            "media", (F.col("evidence_kind") == "Directo") & F.col("individual_count").isNull(),
            F.concat(name, F.lit(": registro directo sin abundancia.")),
        ),
        "sin-revisar": (
            "alta", (F.col("review_state") == "validado") & (F.size("pending_fields") > 0),
            F.concat(name, F.lit(" está marcado como validado pero conserva campos pendientes: "),
                     F.array_join("pending_fields", ", "), F.lit(".")),
        ),
    }


def q_weak_records(occurrences: DataFrame, taxa: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """All row-level rules in one pass: each record explodes into the issues it raises."""
    rules = {k: v for k, v in weak_rules().items() if kinds is None or k in kinds}
    live = S.live(occurrences)
    rows = live.join(seen_taxa(taxa.select(*TAXON_COLUMNS), live), "taxon_id", "left")
    raised = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(condition, F.lit(False)),
                    F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message")),
                )
                for kind, (severity, condition, message) in rules.items()
            ]
        )
    )
    return rows.select("event_id", "occurrence_id", F.explode(raised).alias("i")).select(
        "i.kind", "i.severity", "i.message", "event_id", "occurrence_id", F.lit(1).cast("bigint").alias("n_records")
    )


def quality_issues(events: DataFrame, occurrences: DataFrame, taxa: DataFrame, **options) -> DataFrame:
    """Every issue of a survey in one schema."""
    parts = [
        q_duplicate(occurrences, events, taxa),
        q_effort_gap(events, occurrences, **options),
        q_weak_records(occurrences, taxa),
    ]
    return reduce(DataFrame.unionByName, [p.select(*ISSUE_COLUMNS) for p in parts])


def issues_by_severity(issues: DataFrame) -> DataFrame:
    """Issues with the gravest first. They are written before they are sorted: a global sort reads its input twice."""
    return written(issues, "issues").orderBy(severity_rank().desc(), "kind", "occurrence_id", "event_id")


def quality_summary(events: DataFrame, occurrences: DataFrame, taxa: DataFrame) -> DataFrame:
    """Headline figures. ``events`` and ``empty_events`` count soft-deleted events as well."""
    rows = S.live(occurrences)
    per_taxon = rows.groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n"))
    figures = per_taxon.join(taxa.select("taxon_id", "rce", "iucn", "origin"), "taxon_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"),
        F.count("taxon_id").alias("species"),
        F.coalesce(F.sum(F.when(S.is_threatened("rce", "iucn"), F.col("n"))), F.lit(0)).alias("threatened_records"),
        F.coalesce(F.sum(F.when(S.is_exotic("origin"), F.col("n"))), F.lit(0)).alias("exotic_records"),
    )
    seen = rows.select("event_id").distinct().withColumn("_seen", F.lit(True))
    visits = events.join(seen, "event_id", "left").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.coalesce("no_detections", F.lit(False)) | F.col("_seen").isNull()).alias("empty_events"),
    )
    # Each figure stands in one of the two rows.
    both = visits.unionByName(figures, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in [*visits.columns, *figures.columns]])


def species_tally(occurrences: DataFrame, taxa: DataFrame) -> DataFrame:
    """Records and individuals per taxon, or per name as said when there is no taxon."""
    totals = (
        S.live(occurrences)
        .groupBy("taxon_id", F.when(F.col("taxon_id").isNull(), F.coalesce("verbatim_taxon", F.lit("?"))).alias("_said"))
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum(F.coalesce("individual_count", F.lit(0))).alias("individuals"),
            F.max("verbatim_taxon").alias("_verbatim"),
        )
    )
    return totals.join(
        taxa.select("taxon_id", "common_name", "scientific_name", "rce", "iucn", "origin"), "taxon_id", "left"
    ).select(
        "taxon_id",
        F.coalesce("common_name", "_verbatim", F.lit("Sin identificar")).alias("name"),
        "scientific_name", "records", "individuals",
        S.is_threatened("rce", "iucn").alias("threatened"),
        S.is_exotic("origin").alias("exotic"),
    )


def tally_order(tally: DataFrame) -> DataFrame:
    return tally.orderBy(F.desc("individuals"), fold("name"), "taxon_id")


def daily_stats(occurrences: DataFrame, events: DataFrame) -> DataFrame:
    """Per event date: stations, records, species, pending, without photo, direct without count."""
    rows = S.live(occurrences).join(events.select("event_id", "event_date", "station_id"), "event_id")
    # Reduce by (day, station, taxon) first: the distinct counts then run over few rows.
    small = rows.groupBy("event_date", "station_id", "taxon_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("pending_fields") > 0).alias("pending"),
        F.count_if(F.size("media_ids") == 0).alias("no_photo"),
        F.count_if((F.col("evidence_kind") == "Directo") & F.col("individual_count").isNull()).alias("no_count"),
    )
    return small.groupBy("event_date").agg(
        F.count_distinct("station_id").alias("stations"),
        F.sum("n").alias("records"),
        F.count_distinct("taxon_id").alias("species"),
        F.sum("pending").alias("pending"),
        F.sum("no_photo").alias("without_photo"),
        F.sum("no_count").alias("direct_without_count"),
    )


def methods_done(events: DataFrame) -> DataFrame:
    """Methods carried out at each station and day (at most one entry per known method)."""
    return (
        S.live(events)
        .groupBy("event_date", "station_id")
        .agg(F.array_sort(F.collect_set("method")).alias("methods"))
    )


# --- conservation -------------------------------------------------------------------------

def conservation_coverage(taxa: DataFrame) -> DataFrame:
    classified = S.conservation_level("rce", "iucn") != "sin-clasificar"
    return taxa.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(classified).alias("classified"),
        F.count_if(S.is_threatened("rce", "iucn")).alias("threatened"),
        F.count_distinct(F.when(classified & ~blank("conservation_source"), F.col("conservation_source"))).alias("n_sources"),
    )


def conservation_sources(taxa: DataFrame) -> DataFrame:
    classified = S.conservation_level("rce", "iucn") != "sin-clasificar"
    return taxa.filter(classified & ~blank("conservation_source")).select("conservation_source").distinct()


def mark_ambiguous(taxa: DataFrame) -> DataFrame:
    """Flag common names used by more than one taxon (counted per name, then joined back)."""
    keyed = taxa.withColumn("name_key", fold("common_name"))
    counts = keyed.groupBy("name_key").agg(F.count_distinct("taxon_id").alias("_n"))
    return keyed.join(counts, "name_key", "left").withColumn("ambiguous", F.col("_n") > 1).drop("_n")


def conservation_lookup(names: DataFrame, red_list: DataFrame, answers: DataFrame) -> DataFrame:
    """Status of each name: the loaded red list rules, even when it says "no category"; then the
    newest stored answer; else "not consulted", which differs from "no category".

    ``names``: scientific_name. ``red_list``: scientific_name, category, loaded_at.
    ``answers``: scientific_name, category, consulted_at.
    """
    key = lambda c: F.regexp_replace(F.lower(F.trim(F.col(c))), r"\s+", " ")
    listed = red_list.groupBy(key("scientific_name").alias("_key")).agg(
        F.max_by(F.struct("category", "loaded_at"), F.struct("loaded_at", "category")).alias("listed")
    )
    newest = answers.groupBy(key("scientific_name").alias("_key")).agg(
        F.max_by(F.struct("category", "consulted_at"), F.struct("consulted_at", "category")).alias("answer")
    )
    return (
        names.filter(~blank(F.trim("scientific_name")))
        .withColumn("_key", key("scientific_name"))
        .join(listed, "_key", "left")
        .join(newest, "_key", "left")
        .select(
            *names.columns,
            F.when(F.col("listed").isNotNull(), F.col("listed.category"))
            .otherwise(F.col("answer.category")).alias("category"),
            F.when(F.col("listed").isNotNull(), F.col("listed.loaded_at"))
            .otherwise(F.col("answer.consulted_at")).alias("consulted_at"),
            F.when(F.col("listed").isNotNull(), "nomina").when(F.col("answer").isNotNull(), "cache").alias("origin_of_status"),
            (F.col("listed").isNotNull() | F.col("answer").isNotNull()).alias("consulted"),
        )
    )


def lookup_cache_status(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("consulted_at").isNotNull()).agg(
        F.count_distinct(F.regexp_replace(F.lower("scientific_name"), r"\s+", " ")).alias("species"),
        F.min("consulted_at").alias("oldest"),
    )
