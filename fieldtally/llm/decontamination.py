"""Benchmark passages in documents, by SimHash fingerprints of windows as long as the items.

For an item of L words, the windows are all runs of L words of a document; a document of fewer words
is one window of its own size. A window and an item are
compared by their 128-bit SimHash over word shingles. Each occurrence of a shingle has a code of its
own, so that the distance of two fingerprints follows the weighted Jaccard similarity. The fingerprint
is cut into radius + 1 blocks; two fingerprints within the radius agree in at least one block, so
looking up the items by each block misses none. Candidates within the radius are verified by the exact
weighted Jaccard similarity.

Only windows that hold enough shingles of an item of their size are fingerprinted; the others fail the
verification whatever their fingerprint.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import arrow_rows, batches, id_text, table
from fieldtally.llm.shingles import MULTIPLIER, WordHashes, avalanche, rolling

BITS = 128


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """-1 or 1 for each bit of a shingle's 128-bit code, one row a shingle."""
    codes = np.stack([hashes, avalanche(hashes + np.uint64(0x632BE59BD9B4E019))], axis=1)
    return np.unpackbits(codes.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def window_sums(hashes: np.ndarray, m: int) -> np.ndarray:
    """Summed bits of each run of m shingles, in which equal shingles are numbered and coded one by one.

    Added up under one code, a shingle that a run holds r times would weigh r times in each bit.
    """
    count = len(hashes)
    kind = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(kind, kind="stable")
    base = kind[order] * count
    place, rank = base + order, np.arange(count)
    before, after = np.zeros(count, np.uint64), np.zeros(count, np.uint64)  # equal ones less than m places before and after
    before[order] = rank - np.searchsorted(place, np.maximum(place - m + 1, base))
    after[order] = np.searchsorted(place, np.minimum(place + m, base + count)) - 1 - rank
    comes, goes = (bits_of(avalanche(hashes + n * MULTIPLIER)) for n in (before, after))
    sums = np.empty((count - m + 1, BITS), np.int32)
    sums[0] = comes[:m].sum(0, dtype=np.int32)
    np.subtract(comes[m:], goes[:count - m], out=sums[1:], dtype=np.int32)
    return np.cumsum(sums, axis=0, out=sums)


class Benchmark:
    """A block of items with its fingerprints, indexed by size of item and block of bits."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int, least: float, radius: int):
        self.least, self.radius = least, radius
        self.cuts = np.linspace(0, BITS, radius + 2).astype(int)
        self.words: dict[bytes, int] = {}  # any other word is 0, and has its own hash in fingerprints
        self.others = WordHashes()
        self.ids, self.exact = [], []
        sized: dict[int, list[int]] = defaultdict(list)
        hashed = []
        for item, text in items:
            own = text.split()
            if not own:
                continue
            size = min(shingle, len(own))
            codes = np.fromiter((self.words.setdefault(w, len(self.words) + 1) for w in own), np.uint64, len(own))
            sized[len(own)].append(len(self.ids))
            self.ids.append(item)
            self.exact.append(Counter(zip(*(own[k:] for k in range(size)))))
            hashed.append(rolling(codes, size))
        self.shingle = shingle
        self.sizes = dict(sorted(sized.items()))
        self.known = {k: np.unique(np.concatenate([hashed[i] for n, own in sized.items() if min(n, shingle) == k for i in own]))
                      for k in {min(n, shingle) for n in sized}}
        self.lengths = [0] * len(self.ids)
        self.holders: dict[int, list[int]] = defaultdict(list)
        for n, own in sized.items():
            for i in own:
                self.lengths[i] = n
                for h in set(hashed[i].tolist()):
                    self.holders[h].append(i)
        self.prints = np.zeros((len(self.ids), BITS), bool)
        for i, h in enumerate(hashed):
            self.prints[i] = window_sums(h, len(h))[0] > 0
        self.index: dict[tuple[int, int, bytes], list[int]] = defaultdict(list)
        for n, own in self.sizes.items():
            for i in own:
                for b, key in enumerate(self.blocks(self.prints[i])):
                    self.index[n, b, key].append(i)

    def blocks(self, one: np.ndarray) -> list[bytes]:
        return [np.packbits(one[a:b]).tobytes() for a, b in zip(self.cuts, self.cuts[1:])]

    def need(self, n: int, size: int) -> int:
        """Shingles that a window of ``size`` words must share with an item of n words to be similar enough."""
        k = min(n, self.shingle)
        return int(np.ceil((n - k + 1 + size - k + 1) * self.least / (1 + self.least) - 1e-9))

    def search(self, texts: list[str]) -> Iterator[list[tuple[int, float, int, int]]]:
        """For each text, what ``find`` has; texts without a shingle of the benchmark are passed over in bulk."""
        words = [t.encode().lower().split() for t in texts]
        flat = [w for own in words for w in own]
        codes = np.fromiter(map(self.words.get, flat, repeat(0)), np.uint64, len(flat))
        hits = np.zeros(len(flat) + 1, np.int64)
        for k, known in self.known.items():
            if len(flat) >= k:
                at = np.flatnonzero(np.minimum.reduce([codes[j:len(codes) - k + 1 + j] for j in range(k)]) > 0)
                hits[at[np.isin(_gathered(codes, at, k), known)] + 1] += 1
        total = np.cumsum(hits)
        end = 0
        for own in words:
            begin, end = end, end + len(own)
            yield list(self.find(own, codes[begin:end])) if total[end] > total[begin] else []

    def find(self, words: list[bytes], codes: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item in the document."""
        best: dict[int, tuple[float, int, int]] = {}
        for k, known in self.known.items():
            h = rolling(codes, k)
            if len(codes) < k:
                continue
            met: dict[int, list[int]] = defaultdict(list)
            for p in np.flatnonzero(np.isin(h, known)).tolist():
                for i in self.holders[int(h[p])]:
                    met[i].append(p)
            starts: dict[tuple[int, int], set[int]] = defaultdict(set)  # by size of item and window: windows with enough shingles of an item
            for i, at in met.items():
                n = self.lengths[i]
                size = min(n, len(words))
                m = size - k + 1
                if min(n, self.shingle) != k or len(at) < self.need(n, size):
                    continue
                held = np.zeros(len(h) + 1, np.int64)
                held[np.array(at) + 1] = 1
                held = np.cumsum(held)
                starts[n, size].update(np.flatnonzero(held[m:] - held[:-m] >= self.need(n, size)).tolist())
            for (n, size), own in starts.items():
                self._verify(words, codes, n, size, np.array(sorted(own), np.int64), best)
        for i, (similarity, start, size) in best.items():
            yield self.ids[i], similarity, start, size


    def _verify(self, words: list[bytes], codes: np.ndarray, n: int, size: int, starts: np.ndarray, best: dict[int, tuple[float, int, int]]) -> None:
        """Look up the windows' fingerprints and keep the best verified window of each item."""
        if not len(starts):
            return
        k = min(n, self.shingle)
        m, item_m = size - k + 1, n - k + 1
        low = int(starts[0])
        codes = codes[low:int(starts[-1]) + size].copy()
        other = np.flatnonzero(codes == 0)
        codes[other] = self.others.of([words[low + p] for p in other.tolist()])
        for start, own in zip(starts.tolist(), window_sums(rolling(codes, k), m)[starts - low] > 0):
            found = {i for b, key in enumerate(self.blocks(own)) for i in self.index.get((n, b, key), ())}
            near = [i for i in sorted(found) if np.count_nonzero(self.prints[i] != own) <= self.radius]
            if not near:
                continue
            here = Counter(zip(*(words[start + j:start + m + j] for j in range(k))))
            for i in near:
                both = sum((here & self.exact[i]).values())
                similarity = both / (m + item_m - both)
                if similarity >= self.least and similarity > best.get(i, (0.0,))[0]:
                    best[i] = similarity, start, size


FOUND = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 40, block_items: int = 5000) -> DataFrame:
    """The best window for each (document, item) pair that reaches ``least``.

    ``items`` (item_id, text) is the stated query set. It is read in blocks of ``block_items`` items, each
    sent to the tasks of one pass over all documents, so what is sent is bounded whatever the benchmark's
    size. Words are compared in ASCII lower case. Items and documents without words, and rows with a null
    item id, match nothing; an item shorter than a shingle must occur as it is. Repeated documents are
    reported as often as they come.
    """
    found = None
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])

    def one_pass(block):
        def run(rows):
            bench = Benchmark(block, shingle, least, radius)
            for piece in batches(rows, ["doc_id", "text"]):
                out = [(doc, *row) for doc, own in zip(piece["doc_id"], bench.search(piece["text"])) for row in own]
                if out:
                    yield arrow_rows(schema, list(zip(*out)))
        return id_text(docs).mapInArrow(run, FOUND)

    for block in _item_blocks(items, block_items):
        found = one_pass(block) if found is None else found.union(one_pass(block))
    return found if found is not None else docs.sparkSession.createDataFrame([], FOUND)


def drop_contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 40, block_items: int = 5000,
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window reaches ``least`` for any item."""
    def one_pass(docs, block):
        def run(rows):
            bench = Benchmark(block, shingle, least, radius)
            for batch in rows:
                texts, keep = batch.column(text_col).to_pylist(), []
                for a in range(0, len(texts), 500):
                    keep += [next(iter(own), None) is None for own in bench.search([t or "" for t in texts[a:a + 500]])]
                yield batch.filter(pa.array(keep, pa.bool_()))
        return docs.mapInArrow(run, docs.schema)

    for block in _item_blocks(items, block_items):
        docs = one_pass(docs, block)
    return docs


def _item_blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, bytes]]]:
    named = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    block: list[tuple[int, bytes]] = []
    for row in named.orderBy("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"].encode().lower()))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _gathered(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes at some places only, as ``rolling`` makes them."""
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = out * MULTIPLIER + codes[at + j]
    return avalanche(out)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: For items of five words or more, as all of the benchmark are, and documents that are no shorter than the item.
SQL = {"op6_decontamination": r"""
WITH inputs AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
texts AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS a FROM inputs),
words AS (SELECT side, id, unnest(a) AS word, generate_subscripts(a, 1) AS pos, len(a) AS n FROM texts),
runs AS (SELECT side, id, pos, n, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS k FROM words
         WINDOW w AS (PARTITION BY side, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
items AS (SELECT id AS item_id, s, n - 4 AS m, count(*) AS c FROM runs WHERE side = 'i' AND k = 5 GROUP BY id, s, n),
hits AS (SELECT d.id AS doc_id, item_id, d.pos, s, c, m, d.n FROM runs d JOIN items USING (s) WHERE d.side = 'd' AND d.k = 5),
placed AS (SELECT doc_id, item_id, s, c, m, n, unnest(range(pos - m + 1, pos + 1)) AS start FROM hits),
kinds AS (SELECT doc_id, item_id, m, start, s, least(count(*), any_value(c)) AS x FROM placed WHERE start >= 1 AND start + m + 3 <= n
          GROUP BY doc_id, item_id, m, start, s),
windows AS (SELECT doc_id, item_id, m, start, sum(x) / (2 * m - sum(x)) AS similarity FROM kinds GROUP BY doc_id, item_id, m, start)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start - 1, (-similarity, start)) AS start_word, any_value(m) + 4 AS n_words
FROM windows WHERE similarity >= 8e-1 GROUP BY doc_id, item_id"""}
