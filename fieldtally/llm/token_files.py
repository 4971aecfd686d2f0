"""Token-id files: blocks of ids as compressed bit planes, with an index of the chunks.

A chunk holds the ids of consecutive documents, ``chunk_ids`` or a little more. Its bytes are

    b"FTBP" | plane bits (u8) | planes a block (u8) | block size (u32) | ids (u64) | planes (u32)
    | compressed size of each plane (u32 each) | the planes, each a zstandard frame

where every block of ``block_ids`` ids is turned by 90 degrees: plane k has bit k (or byte k) of all
its ids. Little-endian throughout. The chunk index stands beside it: its partition and place, where
its first id lies, and each document's id and length. Chunks are rows of a Parquet table, so Spark's
committer keeps lost or repeated tasks from leaving half a file, on whatever store is mounted.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import arrow_rows, batches, id_text, table
from fieldtally.llm.tokens import default_tokenizer, encode_with_end
from fieldtally.session import shared_folder

HEAD = struct.Struct("<4sBBIQI")
CHUNK = "part int, chunk long, first_in_part long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
DOCUMENT = "doc_id long, start long, ids binary"


def pack(ids: np.ndarray, block_ids: int, plane_bits: int, level: int = 1) -> bytes:
    """One chunk's bytes. ``plane_bits``: 1 for bit planes, 8 for byte planes."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    n_planes = -(-width // plane_bits)
    planes = []
    for a in range(0, len(ids), block_ids):
        octets = ids[a:a + block_ids].astype("<u4").view(np.uint8).reshape(-1, 4)
        for k in range(n_planes):
            if plane_bits == 8:
                planes.append(compress(np.ascontiguousarray(octets[:, k]).tobytes()))
            else:
                planes.append(compress(np.packbits((octets[:, k // 8] >> (k % 8)) & 1).tobytes()))
    head = HEAD.pack(b"FTBP", plane_bits, n_planes, block_ids, len(ids), len(planes))
    return b"".join([head, np.fromiter(map(len, planes), "<u4", len(planes)).tobytes(), *planes])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a chunk; a payload of another kind or cut short is an error."""
    import zstandard

    mark, plane_bits, n_planes, block_ids, n_ids, frames = HEAD.unpack_from(payload)
    if mark != b"FTBP":
        raise ValueError("not a chunk of token ids")
    decompress = zstandard.ZstdDecompressor().decompress
    sizes = np.frombuffer(payload, "<u4", frames, HEAD.size)
    ends = HEAD.size + 4 * frames + np.cumsum(sizes.astype(np.int64))
    if frames and ends[-1] != len(payload):
        raise ValueError("chunk of token ids cut short")
    ids = np.zeros(n_ids, np.uint32)
    for i, (a, b) in enumerate(zip(ends - sizes, ends)):
        block, k = divmod(i, n_planes)
        own = ids[block * block_ids:(block + 1) * block_ids]
        plane = np.frombuffer(decompress(payload[a:b]), np.uint8)
        if plane_bits == 8:
            own |= plane.astype(np.uint32) << np.uint32(8 * k)
        else:
            own |= np.unpackbits(plane, count=len(own)).astype(np.uint32) << np.uint32(k)
    return ids


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, block_ids: int = 65_536,
                      plane_bits: int = 1, chunk_ids: int = 1 << 20) -> None:
    """Encode every whole text and write the chunks in ascending ``doc_id`` order.

    Null text is empty (only the end id); null ids come first; rows with the same id stand one after
    another. One range shuffle of (doc_id, text); a task holds one chunk at a time, and a text longer
    than a chunk makes a longer chunk.
    """
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("first_in_part", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def encode(rows):
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def close():
            flat = np.concatenate(ids)
            return arrow_rows(schema, [[part], [chunk], [first], [len(flat)], [doc_ids], [lengths], [pack(flat, block_ids, plane_bits)]])

        for piece in batches(rows, ["doc_id", "text"], 2_000_000):
            flat, sizes = encode_with_end(path, piece["text"], end_id)
            doc_ids += piece["doc_id"]
            lengths += sizes.tolist()
            ids.append(flat)
            held += len(flat)
            if held >= chunk_ids:
                yield close()
                chunk, first = chunk + 1, first + held
                doc_ids, lengths, ids, held = [], [], [], 0
        if doc_ids:
            yield close()

    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, CHUNK).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids as little-endian u32, and how many ids lie before it.

    The starts of the parts are a running sum over one row for each writing task; that table, not the
    documents, is what the join sends to every executor.
    """
    chunks = spark.read.schema(CHUNK).parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def decode(rows):
        for batch in rows:
            for row in batch.to_pylist():
                octets = unpack(row["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - np.array(row["lengths"], np.int64)
                if len(octets) != 4 * int(ends[-1]):
                    raise ValueError("chunk and index disagree")
                yield arrow_rows(schema, [row["doc_ids"], starts + row["base"] + row["first_in_part"],
                                          [octets[4 * a:4 * b] for a, b in zip(starts, ends)]])

    placed = chunks.join(F.broadcast(bases), "part").select("doc_ids", "lengths", "payload", "first_in_part", "base")
    return placed.mapInArrow(decode, DOCUMENT)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, from the files read back."""
    folder = shared_folder(spark, "token-ids")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
