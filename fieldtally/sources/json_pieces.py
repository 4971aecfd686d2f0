"""Rows of JSON documents that are too large for one task.

A device backup is one JSON document: an envelope, and under ``data`` an array of objects for each table. The
text reader splits a file by bytes and ends a piece at every closing brace, wherever it stands. What a piece
means depends on what came before: whether it begins inside a string (the parity of the quotes before it) and
how deep (the sum of the brackets before it). Both are running sums over the pieces, so all pieces of a document
are read, measured and cut side by side. Pieces of one row are put together again; what is no row is the envelope.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.operators.ordered import carry_forward_by_bucket, running_sum_by_bucket
from fieldtally.session import written

ORDER = ["block", "piece"]
#: Objects of a table's array lie at this depth: document, ``data``, array, row.
ROW_DEPTH = 4
PIECES_A_BUCKET = 20_000


def text_pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, block, piece, value): the text up to each ``end``, in reading order by (block, piece) within a file.

    ``block`` is the byte at which the reader's split begins, ``piece`` rises within a split.
    """
    return spark.read.text(path, lineSep=end).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"), "value")


def bucket():
    """Runs of neighbouring pieces, for the window helpers."""
    return F.struct("block", F.floor(F.col("piece") / PIECES_A_BUCKET))


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, table, block, piece, json) of each object in an array under ``data``, (file, json) of each envelope with those arrays empty).

    A document that doesn't end where its outermost brace closes has a null envelope and gives no rows.
    """
    # Quotes and brackets behind a backslash aren't structure; whatever stands between an odd and an even quote is text.
    pieces = text_pieces(spark, path, "}").withColumn("clean", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("parts", F.split("clean", '"'))

    def depth_change(parity: int):
        shown = F.array_join(F.filter("parts", lambda p, i: i % 2 == parity), " ")
        return F.length(F.regexp_replace(shown, r"[^\[{]", "")) - F.length(F.regexp_replace(shown, r"[^\]}]", ""))

    measured = pieces.withColumns({"out": depth_change(0), "in": depth_change(1)})
    measured = written(measured.select("file", *ORDER, "value", (F.size("parts") - 1).alias("quotes"), "out", "in"), "json-pieces")
    quoted = running_sum_by_bucket(measured, ["file"], ORDER, bucket(), "quotes", "upto")
    within, ends_within = (F.col("upto") - F.col("quotes")) % 2 == 1, F.col("upto") % 2 == 1
    moved = quoted.select("file", *ORDER, "value", within.alias("within"), ends_within.alias("open"), F.when(within, F.col("in")).otherwise(F.col("out")).alias("move"))
    moved = moved.withColumn("delta", F.col("move") - F.when(F.col("open"), 0).otherwise(1))
    deep = running_sum_by_bucket(moved, ["file"], ORDER, bucket(), "delta", "after").withColumn("before", F.col("after") - F.col("delta"))
    # What follows the document's last brace is a piece of its own, without a brace behind it.
    deep = written(deep.filter((F.col("before") > 0) | (F.trim(F.regexp_replace("value", r"\s", "")) != "")), "json-depths")

    plain = (F.col("before") == ROW_DEPTH - 1) & ~F.col("within") & F.col("value").rlike(r"^[\s,]*\{")
    inner = F.col("before") >= ROW_DEPTH
    heads = deep.filter(~plain & ~inner).select("file", *ORDER, "value", "within", "before").mapInArrow(
        _cut_heads, "file string, block long, piece long, head string, row string, section string, opened string")
    heads = written(heads, "json-heads")
    body = F.when(plain, F.regexp_replace("value", r"^[\s,]*", "")).otherwise(F.col("value"))
    rest = deep.filter(plain | inner).select("file", *ORDER, F.concat(body, F.lit("}")).alias("row"), (~inner).cast("int").alias("begins"), F.lit(None).cast("string").alias("section"),
                                             F.lit(None).cast("string").alias("opened"))
    every = rest.unionByName(heads.select("file", *ORDER, "row", F.col("row").isNotNull().cast("int").alias("begins"), "section", "opened"))
    for name in ("section", "opened"):
        every = carry_forward_by_bucket(every, ["file"], ORDER, bucket(), name, f"{name}_now")
    every = running_sum_by_bucket(every, ["file"], ORDER, bucket(), "begins", "row_no").filter(F.col("row").isNotNull() & (F.col("section_now") == "data"))
    rows = every.groupBy("file", "row_no").agg(
        F.min_by("opened_now", F.struct(*ORDER)).alias("table"), F.min(F.struct(*ORDER)).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "row"))), lambda r: r["row"]), "").alias("json"))

    closed = deep.groupBy("file").agg((F.max_by("after", F.struct(*ORDER)) == 0).alias("whole"))
    envelopes = heads.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "head"))), lambda h: h["head"]), "").alias("json"))
    envelopes = closed.join(envelopes, "file", "left").select("file", F.when(F.col("whole"), F.col("json")).alias("json"))
    return rows.select("file", "table", "at.block", "at.piece", "json"), envelopes


TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]:]', re.S)
IN_TEXT = re.compile(r'(?:[^"\\]|\\.)*"?', re.S)


def cut_head(value: str, within: bool, depth: int) -> tuple[str, str | None, str | None, str | None]:
    """A piece that begins outside of rows, as (envelope text, begin of a row, last key of the document, last key under it).

    The closing brace that ended the piece goes back to whichever of the two the piece ends in.
    """
    at = IN_TEXT.match(value).end() if within else 0
    section = opened = text = None
    for token in TOKENS.finditer(value, at):
        mark = token.group()
        if mark[0] == '"':
            text = mark[1:-1]
        elif mark == ":":
            if depth == 1:
                section = text
            elif depth == 2:
                opened = text
        elif mark in "{[":
            depth += 1
            if depth == ROW_DEPTH:
                return value[:token.start()], value[token.start():] + "}", section, opened
        else:
            depth -= 1
    return value + "}", None, section, opened


def _cut_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "piece", "head", "row", "section", "opened"]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
    for batch in batches:
        cut = [cut_head(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("value", "within", "before")))]
        columns = [*(batch.column(c) for c in names[:3]), *(zip(*cut) if cut else [[]] * 4)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
