"""Packing of token streams into training windows, in document order, by dynamic programming.

Windows are cut where documents or sentences end, or inside a sentence at a price. With b(k) the
places where a cut is allowed and p(k) the price of cutting there, the cheapest cutting is

    f(k) = p(k) - b(k) + size + min { f(i) + b(i) : b(k) - size <= b(i) < b(k) }

which a monotone queue of f(i) + b(i) gives in constant time a place.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import arrow_rows, batches, id_text, table
from fieldtally.llm.tokens import default_tokenizer, encode_with_end, encoder

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, opens: np.ndarray, grid: int,
           sentence_price: int, inner_price: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts are allowed (first id after the cut), ascending, and their prices."""
    n = len(ids)
    ends = np.zeros(n + 1, bool)
    ends[1:-1] = sentence_end[ids[:-1]] & opens[ids[1:]]
    ends[doc_ends] = True
    ends[0] = True
    firm = np.flatnonzero(ends)
    inner = np.arange(n) - np.repeat(firm[:-1], np.diff(firm))
    price = np.full(n + 1, -1, np.int64)
    price[:-1][(inner > 0) & (inner % grid == 0)] = inner_price
    price[firm] = sentence_price
    price[doc_ends] = 0
    price[0] = 0
    at = np.flatnonzero(price >= 0)
    return at, price[at]


def cheapest_cuts(at: list[int], price: list[int], size: int) -> list[int]:
    """Indexes into ``at`` of the cheapest cutting from the first place to the last one."""
    came, keys = [0] * len(at), [0] * len(at)  # keys: f(i) + b(i)
    waiting: deque[int] = deque([0])
    push, drop, first = waiting.append, waiting.pop, waiting.popleft
    head = 0  # the first of those that wait
    for k in range(1, len(at)):
        least = at[k] - size
        while at[head] < least:
            first()
            head = waiting[0]
        came[k] = head
        keys[k] = key = keys[head] + price[k] + size
        while keys[waiting[-1]] >= key:
            drop()
            if not waiting:
                head = k
                break
        push(k)
    k, cuts = len(at) - 1, []
    while k:
        cuts.append(k)
        k = came[k]
    return cuts[::-1]


def pack_documents(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 0, grid: int = 16,
                   sentence_price: int = 2, inner_price: int = 16, run_ids: int = 1 << 18) -> DataFrame:
    """One row for each piece of a document: where it starts there, its ids, its sequence and offset.

    ``grid``: inside a sentence a cut may stand at every so many ids. Documents go in ``doc_id`` order
    (one range shuffle); the programme runs over ``run_ids`` ids or a little more, and what lies behind
    its last full window opens the next run, so only the last window of a partition is short. Null
    text is empty: its end id alone. Equal rows are packed as often as they come.
    """
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pack(rows):
        vocabulary = encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        ids, held = np.zeros(0, np.uint32), []  # of each held document: id, its ids before these, ids here, all its ids

        def emit(last: bool):
            nonlocal ids, held, sequence
            doc_ends = np.cumsum([h[2] for h in held])
            at, price = places(ids, doc_ends, vocabulary.sentence_end, vocabulary.starts_with_blank, grid, sentence_price, inner_price)
            cuts = at[cheapest_cuts(at.tolist(), price.tolist(), size)]
            if not last:
                cuts = cuts[:-1]
            done = int(cuts[-1]) if len(cuts) else 0
            doc_starts = doc_ends - [h[2] for h in held]
            begin = np.unique(np.concatenate([doc_starts, [0], cuts]))
            begin = begin[begin < done]
            end = np.append(begin[1:], done)
            own = np.searchsorted(doc_ends, begin, "right")
            window = np.searchsorted(cuts, begin, "right")
            window_start = np.append(0, cuts)[window]
            octets = ids[:done].astype("<u4").tobytes()
            out = arrow_rows(schema, [
                [held[d][0] for d in own], [held[d][1] + int(b - doc_starts[d]) for d, b in zip(own, begin)], end - begin,
                [octets[4 * a:4 * b] for a, b in zip(begin.tolist(), end.tolist())], [held[d][3] for d in own],
                sequence + window, begin - window_start])
            sequence += len(cuts)
            rest = []
            for d in range(int(np.searchsorted(doc_ends, done, "right")), len(held)):
                taken = max(0, done - int(doc_starts[d]))
                rest.append((held[d][0], held[d][1] + taken, held[d][2] - taken, held[d][3]))
            ids, held = ids[done:], rest
            return out

        for piece in batches(rows, ["doc_id", "text"], 1_000_000):
            flat, sizes = encode_with_end(path, piece["text"], end_id)
            ids = np.concatenate([ids, flat])
            held += [(d, 0, n, n) for d, n in zip(piece["doc_id"], sizes.tolist())]
            if len(ids) >= run_ids:
                yield emit(False)
        if held:
            yield emit(True)

    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(pack, PIECE)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
