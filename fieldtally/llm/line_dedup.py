"""Exact line de-duplication over all documents, as compressed keep bitmaps.

The hashes of long lines are range-partitioned by (hash, document) and sorted by document and
position, so a very common line is spread over many tasks. Each task streams its rows once and knows
a line's first document unless the line began in an earlier task; one edge row for each task settles
those. Texts are joined with their bitmap only to be cut.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import BLANKS, LOWER, UPPER, arrow_rows, ascii_lower, batches, id_text, table, written

DROP, OPEN, EDGE = 0, 1, 2


def line_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, pos) of the lines whose key is long enough; 128 bits stand for the key."""
    line = id_text(docs).filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    keyed = line.select("doc_id", "pos", key.alias("key")).filter(F.char_length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "pos")


def _stream(rows):
    """Rows in order of hash, document, position: lines to drop, lines still open, and the last edge."""
    schema = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])
    last, leading = None, True  # last: hash and first document of the run that is going on
    for batch in rows:
        h1, h2, doc, pos = (np.asarray(batch.column(c)) for c in ("h1", "h2", "doc_id", "pos"))
        if not len(h1):
            continue
        begins = np.ones(len(h1), bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = last is not None and (h1[0], h2[0]) == last[:2]
        first = doc[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        run_end = int(np.argmax(begins[1:])) + 1 if begins[1:].any() else len(h1)
        if goes_on:
            first[:run_end] = last[2]
        still = np.zeros(len(h1), bool)
        if leading and (last is None or goes_on):
            still[:run_end] = doc[:run_end] == first[:run_end]
            leading = run_end == len(h1)
        else:
            leading = False
        drop = doc != first
        kind = np.where(drop, DROP, OPEN)[drop | still]
        if len(kind):
            took = drop | still
            yield arrow_rows(schema, [kind, h1[took], h2[took], doc[took], pos[took]])
        last = (h1[-1], h2[-1], first[-1])
    if last is not None:
        yield arrow_rows(schema, [[EDGE], [last[0]], [last[1]], [last[2]], [0]])


def dropped_lines(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """(doc_id, pos) of each line that a document with a smaller id has too."""
    ordered = line_keys(docs, least_chars).repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    marks = written(ordered.mapInArrow(_stream, "kind byte, h1 long, h2 long, doc_id long, pos int"), "line-marks")
    # The open rows of a task are one document's; they go if an earlier task ended with the same line.
    edges = marks.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    late = marks.filter(F.col("kind") == OPEN).join(edges, ["h1", "h2"]).filter("first_doc < doc_id")
    return marks.filter(F.col("kind") == DROP).select("doc_id", "pos").union(late.select("doc_id", "pos"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep): ``keep`` is a zlib-compressed bitmap, first line first.

    One row for each id that isn't null. Null or empty text is one empty line. Rows that share an id
    are one document, taken to have the same text.
    """
    gone = dropped_lines(docs, least_chars).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    lines = id_text(docs).filter("doc_id is not null").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))
    lines = lines.groupBy("doc_id").agg(F.max("n").alias("n_lines"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])

    def bitmaps(rows):
        for batch in rows:
            ids, sizes, positions = (batch.column(c).to_pylist() for c in ("doc_id", "n_lines", "gone"))
            counts, maps = [], []
            for n, at in zip(sizes, positions):
                keep = np.ones(n, bool)
                keep[[p for p in at or () if p < n]] = False
                counts.append(n - int(keep.sum()))
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield arrow_rows(schema, [ids, sizes, counts, maps])

    return lines.join(gone, "doc_id", "left").mapInArrow(bitmaps, "doc_id long, n_lines long, n_dropped long, keep binary")


def _cut(text: str, n_dropped: int | None, keep: bytes | None) -> str:
    """A text without the lines that its bitmap drops."""
    if not n_dropped:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits) if bit)


def dedup_lines(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row of ``docs``; rows with a null id stay as they are."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def cut(rows):
        for piece in batches(rows, ["doc_id", "text", "n_dropped", "keep"]):
            kept = list(map(_cut, piece["text"], piece["n_dropped"], piece["keep"]))
            yield arrow_rows(schema, [piece["doc_id"], [t.count("\n") + 1 for t in piece["text"]], [n or 0 for n in piece["n_dropped"]], kept])

    maps = keep_bitmaps(docs, least_chars).filter("n_dropped > 0").select("doc_id", "n_dropped", "keep")
    return id_text(docs).join(maps, "doc_id", "left").mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def dedup_documents(docs: DataFrame, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text without its dropped lines. Untouched texts, null ones too, stay as they are."""
    maps = keep_bitmaps(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), least_chars).filter("n_dropped > 0")
    maps = maps.select(F.col("doc_id").alias("dedup id"), F.col("n_dropped").alias("dedup n"), F.col("keep").alias("dedup keep"))
    names = docs.columns

    def cut(rows):
        for batch in rows:
            texts, counts, maps_ = (batch.column(c).to_pylist() for c in (text_col, "dedup n", "dedup keep"))
            text = pa.array(map(_cut, texts, counts, maps_), batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays([text if c == text_col else batch.column(c) for c in names], names=names)

    return docs.join(maps, F.col(id_col) == F.col("dedup id"), "left").drop("dedup id").mapInArrow(cut, docs.schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = {"op1_line_dedup": rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
numbered AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM split),
lines AS (SELECT doc_id, i, a[i] AS line, translate(trim(a[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 '{UPPER}', '{LOWER}') AS key FROM numbered),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT l.*, coalesce(f.first_doc < l.doc_id, false) AS gone FROM lines l LEFT JOIN firsts f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""}
