"""Device backups, maps and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from fieldtally.functions.text import number_text
from fieldtally.operators.export import fill_placeholders
from fieldtally.session import written
from fieldtally.sources.json_pieces import ORDER, bucket, documents, text_pieces

BACKUP_VERSION = 1
BACKUP_TABLES = ["events", "occurrences", "identifications", "measurements", "audit", "outbox", "syncLog", "settings"]

#: Moments are kept to the microsecond, which the default formats cut.
MOMENTS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


# --- device backups -----------------------------------------------------------------------

ENVELOPE = "format string, version int, createdAt string, deviceId string, counts map<string,long>"


def read_backups(spark: SparkSession, path: str, tables: dict[str, str], *, marker: str) -> dict[str, DataFrame]:
    """Backup files (one JSON document each, of any size) as one DataFrame per table, plus counts and rejects.

    ``tables`` maps a table name to its row schema. A file without the format ``marker``, or of a newer version
    than this reader, or cut short, is rejected as a whole and listed in ``rejected``. Documents are split by
    bytes over tasks; rows come with their file and the device that wrote it.
    """
    rows, envelopes = documents(spark, path)
    found = envelopes.select("file", F.from_json("json", ENVELOPE).alias("e"))
    known = F.coalesce((F.col("e.format") == marker) & F.col("e.version").isNotNull(), F.lit(False))
    judged = written(found.select("file", "e.*", known.alias("known"), (known & (F.col("e.version") <= BACKUP_VERSION)).alias("ok")), "backup-envelopes")
    accepted = judged.filter("ok").select("file", F.col("deviceId").alias("source_device"))
    # One table of row texts; a table's rows are parsed as they are asked for.
    rows = written(rows.join(accepted, "file"), "backup-rows")
    out = {name: rows.filter(F.col("table") == name).select("file", "source_device", F.from_json("json", f"struct<{schema}>").alias("r")).select("file", "source_device", "r.*")
           for name, schema in tables.items()}
    out["counts"] = judged.filter("ok").select("file", F.explode("counts").alias("table", "rows"))
    out["rejected"] = judged.filter("not ok").select("file", F.when(F.col("known"), "newer version").otherwise("not a backup").alias("reason"))
    return out


def write_backup(tables: dict[str, DataFrame], path: str, *, marker: str, device_id: str, created_at: str) -> None:
    """A folder with one JSON dataset per table, compressed, and, beside them, what a backup says about itself.

    A distributed backup is a folder: no task ever holds more than its own partition. ``_backup`` has
    format, version, creation time, device and the row count of each table; it is written last, so a
    folder without it is not a whole backup. Media rows go without bytes.
    """
    from functools import reduce

    counts = []
    for name, df in tables.items():
        rows = df.drop("blob").withColumn("blobOmitted", F.lit(True)) if name == "media" else df
        rows.write.mode("overwrite").options(**MOMENTS, compression="gzip").json(f"{path}/{name}")
        counts.append(rows.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")))
    counted = reduce(DataFrame.unionByName, counts).agg(F.map_from_entries(F.collect_list(F.struct("table", "rows"))).alias("counts"))
    counted.select(F.lit(marker).alias("format"), F.lit(BACKUP_VERSION).alias("version"), F.lit(created_at).alias("createdAt"),
                   F.lit(device_id).alias("deviceId"), "counts").write.mode("overwrite").json(f"{path}/_backup")


def read_backup_folder(spark: SparkSession, path: str, tables: dict[str, str], *, marker: str) -> dict[str, DataFrame]:
    """A folder of ``write_backup`` as ``read_backups`` gives files: a table each, ``counts`` and ``rejected``.

    Whether the folder is accepted is a row that every table is joined with, not a job of its own.
    """
    envelope = spark.read.schema(ENVELOPE).json(f"{path}/_backup").withColumn("file", F.lit(path))
    known = F.coalesce((F.col("format") == marker) & F.col("version").isNotNull(), F.lit(False))
    ok = known & (F.col("version") <= BACKUP_VERSION)
    accepted = envelope.filter(ok).select("file", F.col("deviceId").alias("source_device"))
    out = {}
    for name, schema in tables.items():
        rows = spark.read.schema(DataType.fromDDL(f"struct<{schema}>")).options(**MOMENTS).json(f"{path}/{name}")
        out[name] = rows.withColumn("file", F.lit(path)).join(accepted, "file").select("file", "source_device", *rows.columns)
    out["counts"] = envelope.filter(ok).select("file", F.explode("counts").alias("table", "rows"))
    out["rejected"] = envelope.filter(~ok).select("file", F.when(known, "newer version").otherwise("not a backup").alias("reason"))
    return out


# --- spreadsheet cells --------------------------------------------------------------------

CELLS = "file string, sheet string, row_no bigint, col_no int, value string, value_type string"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of workbooks as a codec leaves them, CSV with a header: file, sheet, row_no, col_no, value, value_type.

    Numbers lose a decimal part of nothing, truth values are written ``true`` and ``false``, errors and empty cells go,
    and a type that isn't known is text. Dates stay as the codec writes them, ISO with or without a time.
    """
    raw = spark.read.schema(CELLS).csv(path, header=True, escape='"', multiLine=False)
    kind = F.when(F.col("value_type").isin("n", "d", "b", "s", "e"), F.col("value_type")).otherwise("s")
    number = F.col("value").try_cast("double")
    value = F.when(kind == "n", F.coalesce(number_text(number), F.col("value"))).when(
        kind == "b", F.when(F.lower("value").isin("true", "1"), "true").otherwise("false")).otherwise(F.col("value"))
    # Only a truth value is never null; said of the raw cell, the filter spares the conversion.
    return raw.filter((kind != "e") & ((kind == "b") | F.col("value").isNotNull())).withColumns({"value": value, "value_type": kind})


# --- maps ---------------------------------------------------------------------------------

def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of KML files: file, placemark_no, name, description, folder, kind, points, timestamp.

    The line reader splits at placemark ends, so a large map is many rows, not one string.
    """
    return placemarks(text_pieces(spark, path, "</Placemark>"))


def placemarks(pieces: DataFrame) -> DataFrame:
    """``pieces``: file, block, piece, value (the text up to each closing Placemark tag), as ``text_pieces`` gives them.

    A placemark's folder is the last one opened at its own depth. Depth is a running sum of
    opening and closing tags, and both steps are cut into buckets of pieces, so that one large
    map spreads over tasks.
    """
    from fieldtally.operators.ordered import carry_forward_by_bucket, running_sum_by_bucket

    tags = F.regexp_extract_all("value", F.lit(r"(?s)(<Folder[^>]*>(?:\s*<name>(?:.*?)</name>)?|</Folder>)"), F.lit(1))
    body = F.regexp_extract("value", r"(?s).*(<Placemark[ >].*)$", 1)
    opens = ~F.col("tag").startswith("</")
    moves = pieces.select("file", "block", "piece", F.posexplode(tags).alias("tag_no", "tag")).select(
        "file", "block", "piece", "tag_no", F.when(opens, 1).otherwise(-1).alias("delta"),
        F.when(opens, _decode(F.regexp_extract("tag", r"(?s)<name>(.*?)</name>", 1))).alias("opened"),
        F.lit(None).cast("string").alias("body"))
    # Tags come before the placemark that ends their piece.
    marks = pieces.select("file", "block", "piece", F.lit(1 << 30).alias("tag_no"), F.lit(0).alias("delta"),
                          F.lit(None).cast("string").alias("opened"), body.alias("body")).filter(F.col("body") != "")
    order = [*ORDER, "tag_no"]
    deep = running_sum_by_bucket(moves.unionByName(marks), ["file"], order, bucket(), "delta", "depth")
    named = carry_forward_by_bucket(deep, ["file", "depth"], order, bucket(), "opened", "folder")
    placed = named.filter(F.col("body").isNotNull()).withColumn("folder", F.when(F.col("depth") > 0, F.col("folder")))
    # A placemark's number is its place among the file's placemarks, from 0.
    placed = running_sum_by_bucket(placed.withColumn("one", F.lit(1)), ["file"], order, bucket(), "one", "nth")

    def geometry(tag: str) -> Column:
        return F.nullif(F.regexp_extract("body", rf"(?s)<{tag}[^>]*>.*?<coordinates>(.*?)</coordinates>", 1), F.lit(""))

    def inner(tag: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("body", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))

    point, line, area = geometry("Point"), geometry("LineString"), geometry("Polygon")
    points = parse_coordinates(F.coalesce(point, line, area, inner("coordinates")))
    return placed.select(
        "file", (F.col("nth") - 1).alias("placemark_no"),
        _decode(F.coalesce(inner("name"), F.lit("(sin nombre)"))).alias("name"),
        _decode(inner("description")).alias("description"), F.nullif(F.col("folder"), F.lit("")).alias("folder"),
        F.when(point.isNotNull(), "punto").when(line.isNotNull(), "linea").when(area.isNotNull(), "area").otherwise("linea").alias("kind"),
        points.alias("points"), inner("when").alias("timestamp"),
    ).filter(F.size("points") > 0)


def parse_coordinates(raw: Column) -> Column:
    """``lon,lat[,alt]`` chunks to array<struct<lat,lon,alt>>; unreadable or impossible ones vanish."""
    chunks = F.split(F.trim(F.regexp_replace(raw, r"\s+", " ")), " ")
    parts = F.transform(chunks, lambda c: F.split(c, ","))
    read = lambda p, i: F.get(p, F.lit(i)).try_cast("double")
    structs = F.transform(parts, lambda p: F.struct(read(p, 1).alias("lat"), read(p, 0).alias("lon"), read(p, 2).alias("alt")))
    return F.filter(structs, lambda s: (F.abs(s["lat"]) <= 90) & (F.abs(s["lon"]) <= 180))


def _decode(c: Column) -> Column:
    text = F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


# --- report files -------------------------------------------------------------------------

def one_line(df: DataFrame) -> DataFrame:
    """Every column as trimmed text without tabs or line breaks; null to empty."""
    return df.select(*[
        F.trim(F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[\t\r\n]+", " ")).alias(c) for c in df.columns])


def write_dwca(event: DataFrame, occurrence: DataFrame, measurement: DataFrame, path: str) -> None:
    """The three tab-separated tables of a Darwin Core archive, each a folder of compressed part files."""
    for name, df in (("event", event), ("occurrence", occurrence), ("measurementorfact", measurement)):
        one_line(df).write.mode("overwrite").csv(
            f"{path}/{name}", sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="", compression="gzip")


def write_occurrence_csv(present: DataFrame, path: str) -> None:
    """The occurrence table alone with comma quoting, compressed; absences are not part of it."""
    one_line(present).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="", compression="gzip")


def write_template(sheets: dict[str, DataFrame], headers: dict[str, list[str]], path: str, *,
                   preambles: dict[str, list[list[str]]] | None = None, values: dict[str, str] | None = None) -> None:
    """One CSV dataset per sheet under its name cut at 31 characters, headers in their own dataset.

    ``preambles`` are the decorative rows above a sheet's header; ``values`` fill their ``{{markers}}``. They are
    written beside the header, numbered, so that whoever puts the file together keeps their order.
    """
    for name, df in sheets.items():
        folder = f"{path}/{name[:31]}"
        df.write.mode("overwrite").csv(f"{folder}/rows", header=False, escape='"', emptyValue="")
        head = df.sparkSession.createDataFrame([tuple(headers[name])], [f"c{i}" for i in range(1, len(headers[name]) + 1)])
        head.write.mode("overwrite").csv(f"{folder}/header", header=False, escape='"')
        above = fill_placeholders((preambles or {}).get(name, []), values or {})
        if above:
            width = max(map(len, above))
            rows = [(i, *row, *[""] * (width - len(row))) for i, row in enumerate(above, start=1)]
            columns = "row_no int" + "".join(f", c{i} string" for i in range(1, width + 1))
            df.sparkSession.createDataFrame(rows, columns).write.mode("overwrite").csv(f"{folder}/preamble", header=False, escape='"', emptyValue="")
