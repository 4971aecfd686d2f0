"""Species, station and conservation lists kept as CSV files with ``#`` comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions import vocab as V
from fieldtally.functions.survey import lookup
from fieldtally.functions.text import fold

CLASS_LATIN = {"aves": "Aves", "mamiferos": "Mammalia", "mammalia": "Mammalia", "reptiles": "Reptilia",
               "reptilia": "Reptilia", "anfibios": "Amphibia", "amphibia": "Amphibia"}
CLASS_SPANISH = {"Aves": "Aves", "Mammalia": "Mamíferos", "Reptilia": "Reptiles", "Amphibia": "Anfibios"}
GROUP = {"Aves": "aves", "Mammalia": "mamiferos", "Reptilia": "reptiles", "Amphibia": "anfibios"}

# Placeholders that let a record be kept without reaching the species.
PLACEHOLDERS = [
    ("Ave no identificada", "Aves", None, ["ave", "aves", "pajaro", "pajaros", "ave sp", "passeriforme"]),
    ("Rapaz no identificada", "Aves", None, ["rapaz", "rapaces", "ave rapaz"]),
    ("Mamífero no identificado", "Mammalia", None, ["mamifero", "mamiferos"]),
    ("Roedor no identificado", "Mammalia", "Rodentia", ["roedor", "roedores", "raton", "ratones", "ratoncito"]),
    ("Quiróptero no identificado", "Mammalia", "Chiroptera", ["murcielago", "murcielagos", "quiroptero"]),
    ("Reptil no identificado", "Reptilia", None, ["reptil", "reptiles"]),
    ("Lagartija no identificada", "Reptilia", "Squamata", ["lagartija", "lagartijas", "lagarto", "lagartos"]),
    ("Anfibio no identificado", "Amphibia", "Anura", ["anfibio", "anfibios", "sapo", "rana"]),
]
METHOD_FLAGS = ["transecto", "playback aves", "playback anfibios", "camara trampa", "trampa sherman"]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with comment lines; columns renamed to their folded header, values trimmed."""
    from fieldtally.functions.headers import _fold_py

    raw = spark.read.csv(path, header=True, comment="#", encoding="UTF-8", multiLine=False)
    return raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(_fold_py(c)) for c in raw.columns])


def truthy(c: Column | str) -> Column:
    return fold(c).isin("si", "s", "1", "true", "yes", "x")


def _value(rows: DataFrame, name: str) -> Column:
    """A column's text, null when it is empty or the file lacks it."""
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit("")) if name in rows.columns else F.lit(None).cast("string")


def taxa_from_rows(rows: DataFrame, *, placeholders: bool = True) -> DataFrame:
    """Catalogue out of species rows (folded Spanish headers, as ``read_rows`` gives them).

    Ids hash the folded name, as rows have no order. A common name used twice is flagged.
    """
    v = lambda name: _value(rows, name)
    sci, common = v("nombre cientifico"), v("nombre comun")
    words = F.split(sci, r"\s+")
    genus = F.coalesce(v("genero"), F.get(words, F.lit(0)))
    epithet = F.coalesce(v("epiteto"), F.get(words, F.lit(1)))
    infra = F.coalesce(v("subespecie"), F.get(words, F.lit(2)))
    latin = lookup(fold(F.coalesce(v("clase"), F.lit(""))), CLASS_LATIN)
    others = F.filter(
        F.transform(F.split(F.coalesce(v("nombres alternativos"), F.lit("")), r"[;|]"), lambda n: F.trim(n)), lambda n: n != "")
    short = F.when(genus.isNotNull() & epithet.isNotNull() & sci.isNotNull(),
                   fold(F.concat(F.substring(genus, 1, 1), F.lit(". "), epithet)))
    keys = F.concat(F.array(fold(common), fold(sci), short), F.transform(others, fold))
    keys = F.array_sort(F.array_distinct(F.filter(F.array_compact(keys), lambda k: k != "")))
    species = rows.filter(common.isNotNull()).select(
        F.concat(F.lit("tx_"), F.substring(F.sha1(fold(F.coalesce(sci, common))), 1, 10)).alias("taxon_id"),
        common.alias("common_name"), others.alias("other_names"), sci.alias("scientific_name"),
        F.coalesce(v("reino"), F.lit("Animalia")).alias("kingdom"), F.coalesce(v("filo"), F.lit("Chordata")).alias("phylum"),
        latin.alias("tax_class"), F.coalesce(lookup(latin, CLASS_SPANISH), v("clase")).alias("class_es"),
        v("orden").alias("tax_order"), v("familia").alias("family"), genus.alias("genus"),
        epithet.alias("specific_epithet"), infra.alias("infra_epithet"),
        F.when(infra.isNotNull(), "subspecies").when(epithet.isNotNull(), "species").when(genus.isNotNull(), "genus")
        .otherwise("unranked").alias("taxon_rank"),
        F.coalesce(lookup(latin, GROUP), F.lit("otros")).alias("tax_group"),
        F.lit(False).alias("is_placeholder"), keys.alias("search_keys"),
    )
    counts = species.groupBy(fold("common_name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    species = species.withColumn("_name", fold("common_name")).join(counts, "_name", "left").withColumn(
        "ambiguous", F.col("_n") > 1).drop("_name", "_n")
    return species.unionByName(placeholder_taxa(rows.sparkSession), allowMissingColumns=True) if placeholders else species


def placeholder_taxa(spark: SparkSession) -> DataFrame:
    base = spark.createDataFrame(PLACEHOLDERS, "common_name string, tax_class string, tax_order string, names array<string>")
    return base.select(
        F.concat(F.lit("tx_"), F.substring(F.sha1(F.concat(F.lit("placeholder|"), "common_name")), 1, 10)).alias("taxon_id"),
        "common_name", F.array().cast("array<string>").alias("other_names"), F.lit("Animalia").alias("kingdom"),
        F.lit("Chordata").alias("phylum"), "tax_class", lookup("tax_class", CLASS_SPANISH).alias("class_es"), "tax_order",
        F.when(F.col("tax_order").isNotNull(), "order").otherwise("class").alias("taxon_rank"),
        lookup("tax_class", GROUP).alias("tax_group"), F.lit(True).alias("is_placeholder"),
        F.array_sort(F.array_distinct(F.array_append("names", fold("common_name")))).alias("search_keys"),
        F.lit(False).alias("ambiguous"),
    )


def read_taxon_csv(spark: SparkSession, path: str) -> DataFrame:
    return taxa_from_rows(read_rows(spark, path))


def taxon_keys(taxa: DataFrame) -> DataFrame:
    """Exploded search keys (key, taxon_id), the table every name match joins with."""
    return taxa.select(F.explode("search_keys").alias("key"), "taxon_id").distinct()


def stations_from_rows(rows: DataFrame) -> DataFrame:
    v = lambda name: _value(rows, name)

    def number(name: str) -> Column:
        text = F.regexp_replace(v(name), ",", ".")
        return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))

    code, project = v("id estacion"), F.coalesce(v("proyecto"), F.lit("Proyecto"))
    methods = F.array_compact(F.array(*[
        F.when(truthy(F.coalesce(v(m), F.lit(""))), m.replace(" ", "_")) for m in METHOD_FLAGS]))
    return rows.filter(code.isNotNull()).select(
        F.concat(F.lit("st_"), F.substring(F.sha1(F.concat_ws("|", project, code)), 1, 10)).alias("station_id"),
        code.alias("station_code"), F.coalesce(v("id final estacion"), code).alias("final_code"), project.alias("project"),
        v("region").alias("region"), v("temporada").alias("season"), v("ambiente").alias("habitat"),
        v("ladera").alias("slope_aspect"), number("utm este").alias("utm_east"), number("utm norte").alias("utm_north"),
        number("utm este inicio").alias("utm_start_east"), number("utm norte inicio").alias("utm_start_north"),
        number("utm este fin").alias("utm_end_east"), number("utm norte fin").alias("utm_end_north"),
        methods.alias("methods"), v("muestreado por").alias("station_recorded_by"), v("identificado por").alias("identified_by"),
    )


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    return stations_from_rows(read_rows(spark, path))


# --- conservation lists -------------------------------------------------------------------

# Headers under which a list may give each column.
CONSERVATION_HEADERS = {
    "scientific_name": ["nombre cientifico", "scientificname", "especie", "taxon"],
    "rce": ["rce", "categoria rce", "categoria", "clasificacion", "estado de conservacion"],
    "rce_decree": ["decreto", "ds", "norma"],
    "iucn": ["iucn", "uicn"],
    "origin": ["origen", "origin"],
    "endemic": ["endemica", "endemismo", "endemic"],
    "migratory": ["migratoria", "migratory", "migracion"],
    "legal_protection": ["proteccion legal", "proteccion", "ley"],
    "conservation_source": ["fuente", "source", "referencia"],
}


def _listed(rows: DataFrame, name: str) -> Column:
    """A list's column under whichever of its headers the file has."""
    for header in CONSERVATION_HEADERS[name]:
        if header in rows.columns:
            return _value(rows, header)
    return F.lit(None).cast("string")


def dropped_categories(rows: DataFrame) -> DataFrame:
    """(list, category, rows): what all rows of a list say that is none of the ten codes, and is dropped."""
    said = F.explode(F.array(*[F.struct(F.lit(name).alias("list"), F.upper(_listed(rows, name)).alias("category")) for name in ("rce", "iucn")]))
    return rows.filter(_listed(rows, "scientific_name").isNotNull()).select(said.alias("s")).select("s.*").filter(
        F.col("category").isNotNull() & ~F.col("category").isin(list(V.THREAT_LABELS))).groupBy("list", "category").agg(F.count(F.lit(1)).alias("rows"))


def conservation_rows(rows: DataFrame, *, default_source: str) -> DataFrame:
    """One status per species; the last row of a name wins (``row_no`` orders them).

    Categories outside the ten codes are dropped; ``dropped`` counts them on the winning row,
    ``dropped_categories`` on all rows.
    """
    def pick(name: str) -> Column:
        return _listed(rows, name)

    def flag(name: str) -> Column:
        c = pick(name)
        return F.when(c.isNotNull(), fold(c).isin("si", "s", "1", "true", "yes", "y", "x"))

    codes = list(V.THREAT_LABELS)
    rce, iucn = F.upper(pick("rce")), F.upper(pick("iucn"))
    bad = lambda c: F.when(c.isNotNull() & ~c.isin(codes), 1).otherwise(0)
    status = F.struct(
        F.when(rce.isin(codes), rce).alias("rce"), pick("rce_decree").alias("rce_decree"),
        F.when(iucn.isin(codes), iucn).alias("iucn"), pick("origin").alias("origin"), flag("endemic").alias("endemic"),
        flag("migratory").alias("migratory"), pick("legal_protection").alias("legal_protection"),
        F.coalesce(pick("conservation_source"), F.lit(default_source)).alias("conservation_source"),
        (bad(rce) + bad(iucn)).alias("dropped"),
    )
    name = pick("scientific_name")
    return rows.filter(name.isNotNull()).groupBy(fold(name).alias("name_key")).agg(
        F.max_by(status, "row_no").alias("status"), F.max_by(name, "row_no").alias("listed_name"))


STATUS_COLUMNS = ["rce", "rce_decree", "iucn", "origin", "endemic", "migratory", "legal_protection", "conservation_source"]


def load_conservation(taxa: DataFrame, listed: DataFrame) -> DataFrame:
    """Taxa with the status of the list; a taxon that is not in it loses its earlier one."""
    kept = [c for c in taxa.columns if c not in STATUS_COLUMNS]
    return taxa.select(*kept).withColumn("name_key", fold("scientific_name")).join(listed, "name_key", "left").select(
        *kept, *[F.col(f"status.{c}").alias(c) for c in STATUS_COLUMNS], F.col("status").isNotNull().alias("listed"))


def conservation_report(taxa: DataFrame, listed: DataFrame) -> DataFrame:
    """matched and threatened taxa, and listed names that no taxon has."""
    from fieldtally.functions.survey import is_threatened

    loaded = load_conservation(taxa, listed).select(
        F.col("listed").alias("matched"), (F.col("listed") & is_threatened("rce", "iucn")).alias("threatened"), F.lit(False).alias("unmatched"))
    missing = unmatched_names(taxa, listed).select(F.lit(False).alias("matched"), F.lit(False).alias("threatened"), F.lit(True).alias("unmatched"))
    return loaded.unionByName(missing).agg(*[F.count_if(c).alias(c) for c in ("matched", "threatened", "unmatched")])


def unmatched_names(taxa: DataFrame, listed: DataFrame) -> DataFrame:
    known = taxa.select(fold("scientific_name").alias("name_key")).filter(F.col("name_key").isNotNull()).distinct()
    return listed.join(known, "name_key", "left_anti").select("listed_name")


def preserve_conservation(taxa: DataFrame, previous: DataFrame) -> DataFrame:
    """A rebuilt catalogue keeps the earlier status of the same lower-cased scientific name."""
    earlier = previous.filter(F.coalesce("rce", "iucn", "origin").isNotNull() & F.col("scientific_name").isNotNull()).groupBy(
        F.lower("scientific_name").alias("_key")).agg(F.max_by(F.struct(*STATUS_COLUMNS), "taxon_id").alias("s"))
    return taxa.withColumn("_key", F.lower("scientific_name")).join(earlier, "_key", "left").select(
        *[c for c in taxa.columns if c not in STATUS_COLUMNS],
        *[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) for c in STATUS_COLUMNS],
        F.col("s").isNotNull().alias("preserved"))
