"""Helpers shared by the training-data operators: inputs, lineage cuts and additive sketches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.session import shared_folder

#: White space of the word and line rules, as characters and as a character class.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns never reach it."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage with a table in the folder that driver and executors share."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def crc_bucket(id_col: str, buckets: int) -> Column:
    """crc32 of the id's decimal text modulo ``buckets``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: str) -> list[str]:
    """Words between the six ASCII blanks, at which ``bytes.split()`` cuts (``str.split()`` knows more)."""
    packed = b" ".join(text.encode().split())
    return packed.decode().split(" ") if packed else []


def lower_ascii(text: str) -> str:
    """A-Z in lower case and nothing else, as ``bytes.lower()`` does."""
    return text.encode().lower().decode()


def batches(rows: Iterator[pa.RecordBatch], columns: list[str], most_chars: int = 4_000_000,
            text: str = "text") -> Iterator[dict[str, list]]:
    """Arrow batches as Python lists, cut so that one piece holds about ``most_chars`` of text."""
    for batch in rows:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(most_chars, sizes.sum() + most_chars, most_chars)) + 1
        begin = 0
        for end in np.minimum(np.append(cuts, len(sizes)), len(sizes)):
            if end > begin:
                piece = batch.slice(begin, int(end) - begin)
                yield {c: piece.column(c).to_pylist() for c in columns}
                begin = int(end)


def arrow_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SLICE = 1 << 16


def _packed(part: np.ndarray) -> bytes:
    """The slice in the narrowest unsigned type that holds it (or its own), the type's width first; 0: its own."""
    width = 0
    if part.dtype.kind in "iu" and part.min() >= 0:
        width = next(w for w in (1, 2, 4, 8) if int(part.max()) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(part.astype(f"<u{width}").tobytes() if width else part.tobytes(), 1)


def _unpacked(packed: bytes, dtype: str) -> np.ndarray:
    part = np.frombuffer(zlib.decompress(memoryview(packed)[1:]), f"<u{packed[0]}" if packed[0] else dtype)
    return part.astype(dtype, copy=False)


def additive_table(parts: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], cells: int,
                   dtype: str = "int64", join: np.ufunc = np.add) -> np.ndarray:
    """Sum (or join by ``join``), over all partitions, a table of a fixed number of cells that ``fill`` raises in place.

    Each task sends its table as compressed slices; slices meet by number, so no task and not the
    driver ever holds more than the fixed table. ``cells`` is a parameter of the caller, not of the data.
    """
    n_slices = -(-cells // SLICE)

    def partial(rows):
        counts = np.zeros(n_slices * SLICE, dtype)
        fill(rows, counts)
        for k in range(n_slices):
            part = counts[k * SLICE:(k + 1) * SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())],
                                                 names=["k", "part"])

    def merge(rows):
        sums: dict[int, np.ndarray] = {}
        for batch in rows:
            for k, part in zip(batch.column("k").to_pylist(), batch.column("part").to_pylist()):
                got = _unpacked(part, dtype)
                sums[k] = join(sums[k], got) if k in sums else got
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())],
                                             names=["k", "part"])

    slices = parts.mapInArrow(partial, "k int, part binary").repartition("k").mapInArrow(merge, "k int, part binary")
    out = np.zeros(n_slices * SLICE, dtype)
    for row in slices.toLocalIterator():
        own = out[row.k * SLICE:(row.k + 1) * SLICE]
        join(own, _unpacked(row.part, dtype), out=own)
    return out[:cells]
