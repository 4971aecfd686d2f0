"""Repeated passages: words covered by a window that starts in a document with a smaller id too.

Windows are dealt to shards by their minimizer, the least hash of the word runs inside, so equal windows
meet in one shard and consecutive windows travel as one stretch of text. Stretches whose minimizer only
one document has can't repeat and stay where they are. Of the others, digests go ahead of the texts: where
all stretches of a minimizer are one text there is nothing to search, its least document is the answer. Only
minimizers with several texts send them to a shard. There the distinct stretches, each with its least
document, get an FM-index (a wavelet matrix over the transform), and all of them are streamed against it:
backward search gives each window's matches, and the least document among them. The places of a stretch
never enter the shard: they meet its result in a join, a batch of documents a row, and become intervals of
words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import additive_table, arrow_rows, batches, id_text, table, written
from fieldtally.llm.fm_index import FMIndex
from fieldtally.llm.shingles import MULTIPLIER, avalanche, rolling

#: Bits of the table of minimizers with very many contexts, and of the table of documents with repeats.
HOT_BITS, DOC_BITS = 20, 22
#: Bits of the table of texts that are searched.
TEXT_BITS = 25
#: A number for each byte of a word; the blank behind it has none.
LETTERS = avalanche(np.arange(1, 257, dtype=np.uint64))
LETTERS[32] = 0


def _word_hashes(flat: bytes, at: np.ndarray) -> np.ndarray:
    """Hash of each word out of its bytes and their places; word k is ``flat[at[k]:at[k + 1] - 1]``.

    It only decides where texts meet: what is equal is told by digests of the texts.
    """
    letters, out = np.frombuffer(flat, np.uint8), np.empty(len(at) - 1, np.uint64)
    for a in range(0, len(out), 1 << 15):
        own = at[a:a + (1 << 15) + 1]
        sizes, begins = np.diff(own), own[:-1] - own[0]
        powers = np.multiply.accumulate(np.full(int(sizes.max()), MULTIPLIER))
        place = np.arange(int(own[-1] - own[0])) - np.repeat(begins, sizes)
        out[a:a + (1 << 15)] = np.add.reduceat(LETTERS[letters[own[0]:own[-1]]] * powers[place], begins)
    return avalanche(out)


class Stretches:
    """The windows of a batch of texts, cut into stretches of one minimizer within one document."""

    def __init__(self, texts: list[str], window: int, run: int):
        packed = [b" ".join(t.encode().split()) for t in texts]
        n_words = np.array([p.count(b" ") + 1 if p else 0 for p in packed], np.int64)
        ends = np.cumsum(n_words)
        self.begins = ends - n_words                            # first word of each document
        self.first = self.count = self.owner = np.zeros(0, np.int64)   # first window, number of windows, document
        self.least = np.zeros(0, np.uint64)                     # minimizer
        if n_words.sum() < window:
            return
        self.flat = b" ".join(filter(None, packed)) + b" "      # word k is flat[at[k]:at[k + 1] - 1]
        self.at = np.append(0, np.flatnonzero(np.frombuffer(self.flat, np.uint8) == 32) + 1)
        self.hashes = _word_hashes(self.flat, self.at)
        runs = rolling(self.hashes, run)
        n = len(self.hashes) - window + 1
        least = runs[:n].copy()
        for k in range(1, window - run + 1):
            np.minimum(least, runs[k:n + k], out=least)
        owner = np.repeat(np.arange(len(packed)), n_words)[:n]
        inside = np.arange(n) + window <= ends[owner]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        closes[:-1] &= ~inside[1:] | (least[1:] != least[:-1])
        self.first = np.flatnonzero(opens)
        self.count = np.flatnonzero(closes) - self.first + 1
        self.least, self.owner = least[self.first], owner[self.first]


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    at = at.astype(np.int64)
    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def _packed(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The bytes of ``values``, one binary for what begins at each of ``begins``."""
    ends = np.append(begins, len(values)).astype(np.int32) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values in a column of binaries, and how many each of them has."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    values = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]].view(dtype)
    return values, (np.diff(ends) // values.itemsize).astype(np.int64)


def _masks(docs: DataFrame, window: int, run: int, mask_bits: int, hot: int) -> np.ndarray:
    """Bits of the minimizers that two documents have, and behind them of those that meet ``hot`` times or more.

    A minimizer is known here by the first 32 bits of its hash: a few that only one document has may get
    a bit, none that two have goes without. Each batch of documents sends a number once, with whether
    several of its documents have it; what comes from two batches comes from two documents.
    """
    several, most = np.int64(1 << 15), (1 << 15) - 1

    def anchors(rows):
        for piece in batches(rows, ["doc_id", "text"], 2_000_000):
            own = Stretches(piece["text"], window, run)
            if len(own.least):
                met = np.sort(own.least >> np.uint64(32) << np.uint64(32) | own.owner.astype(np.uint64))
                cell, owner = (met >> np.uint64(32)).astype(np.int64), met.astype(np.uint32)
                begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                end = np.append(begin[1:], len(cell))
                packed = cell[begin] << 16 | np.minimum(end - begin, most)
                packed |= np.where(owner[begin] != owner[end - 1], several, 0)
                yield pa.RecordBatch.from_arrays([pa.array(packed)], names=["packed"])

    def meet(rows):
        held = np.zeros(0, np.int64)
        schema = pa.schema([("cell", pa.int64()), ("hot", pa.bool_())])

        def judged(packed):
            cell = packed >> 16
            begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            rows_of = np.diff(np.append(begin, len(cell)))
            shared = (rows_of > 1) | (np.bitwise_or.reduceat(packed, begin) & several > 0)
            met = np.add.reduceat(packed & most, begin)
            return arrow_rows(schema, [cell[begin][shared], met[shared] >= hot])

        for batch in rows:
            held = np.concatenate([held, np.asarray(batch.column("packed"))])
            last = int(np.searchsorted(held, held[-1] >> 16 << 16)) if len(held) else 0
            if last:
                yield judged(held[:last])
                held = held[last:]
        if len(held):
            yield judged(held)

    def fill(rows, table_):
        for batch in rows:
            cell, is_hot = np.asarray(batch.column("cell")), batch.column("hot").to_numpy(zero_copy_only=False)
            _set(table_, cell >> 32 - mask_bits)
            _set(table_[1 << mask_bits - 3:], cell[is_hot] >> 32 - HOT_BITS)

    sent = docs.mapInArrow(anchors, "packed long").repartition(F.shiftright("packed", 16)).sortWithinPartitions("packed")
    return additive_table(sent.mapInArrow(meet, "cell long, hot boolean"), fill, (1 << mask_bits - 3) + (1 << HOT_BITS - 3), "uint8", np.bitwise_or)


def _dealt(docs: DataFrame, window: int, run: int, mask_bits: int, hot: int) -> DataFrame:
    """(key, d1, d2, least, most, n_words, content, doc_ids, starts): stretches that may repeat, equal ones of a batch as one row."""
    import xxhash  # noqa: F401  workers need it

    masks = docs.sparkSession.sparkContext.broadcast(_masks(docs, window, run, mask_bits, hot))
    schema = pa.schema([("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("least", pa.int64()), ("most", pa.int64()),
                        ("n_words", pa.int32()), ("content", pa.binary()), ("doc_ids", pa.binary()), ("starts", pa.binary())])

    def deal(rows):
        from xxhash import xxh3_128_digest

        shared, many = masks.value[:1 << mask_bits - 3], masks.value[1 << mask_bits - 3:]
        for piece in batches(rows, ["doc_id", "text"], 2_500_000):
            own = Stretches(piece["text"], window, run)
            took = np.flatnonzero(_has(shared, own.least >> np.uint64(64 - mask_bits)))
            if not len(took):
                continue
            crowded = _has(many, own.least[took] >> np.uint64(64 - HOT_BITS))
            calm, hot_ones = took[~crowded], took[crowded]
            of, first, n_words, key = calm, own.first[calm], own.count[calm] + window - 1, own.least[calm]
            if len(hot_ones):
                # A minimizer with very many contexts would fill a shard: its windows go by their own hash, one by one.
                n = own.count[hot_ones]
                each = np.repeat(hot_ones, n)
                at = own.first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                of, first = np.concatenate([of, each]), np.concatenate([first, at])
                n_words = np.concatenate([n_words, np.full(len(each), window)])
                key = np.concatenate([key, avalanche(rolling(own.hashes, window)[at])])
            contents = [own.flat[a:b] for a, b in zip(own.at[first].tolist(), (own.at[first + n_words] - 1).tolist())]
            digests = np.frombuffer(b"".join(map(xxh3_128_digest, contents)), np.int64).reshape(-1, 2)
            order = np.lexsort((digests[:, 1], digests[:, 0]))
            d1, d2 = digests[order, 0], digests[order, 1]
            opens = np.flatnonzero(np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
            doc = np.array(piece["doc_id"], np.int64)[own.owner[of[order]]]
            place = (first - own.begins[own.owner[of]])[order].astype(np.int32)
            one = order[opens]
            yield pa.RecordBatch.from_arrays([
                pa.array(key[one].view(np.int64)), pa.array(d1[opens]), pa.array(d2[opens]), pa.array(np.minimum.reduceat(doc, opens)),
                pa.array(np.maximum.reduceat(doc, opens)), pa.array(n_words[one].astype(np.int32)),
                pa.array([contents[k] for k in one.tolist()], pa.binary()), _packed(doc, opens), _packed(place, opens)], schema=schema)

    return docs.mapInArrow(deal, "key long, d1 long, d2 long, least long, most long, n_words int, content binary, doc_ids binary, starts binary")


ALONE, SEARCH = 0, 1


def _meet(rows):
    """Sorted (key, d1, d2, least, most) as (kind, d1, d2, first): the one text of a minimizer that several documents
    have, settled, and each text of a minimizer with several texts and documents, to be searched."""
    names = ["key", "d1", "d2", "least", "most"]
    schema = pa.schema([("kind", pa.int8()), ("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int64())])
    held = [np.zeros(0, np.int64)] * len(names)

    def judged(key, d1, d2, least, most):
        text = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
        key, d1, d2 = key[text], d1[text], d2[text]
        least, most = np.minimum.reduceat(least, text), np.maximum.reduceat(most, text)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        texts = np.diff(np.append(first, len(key)))
        several = np.repeat((texts > 1) & (np.minimum.reduceat(least, first) < np.maximum.reduceat(most, first)), texts)
        alone = np.repeat(texts == 1, texts) & (least < most)
        at = np.flatnonzero(alone | several)
        return arrow_rows(schema, [np.where(several[at], SEARCH, ALONE).astype(np.int8), d1[at], d2[at], least[at]])

    for batch in rows:
        held = [np.concatenate([h, np.asarray(batch.column(c))]) for h, c in zip(held, names)]
        if len(held[0]):
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield judged(*(h[:last] for h in held))
                held = [h[last:] for h in held]
    if len(held[0]):
        yield judged(*held)


class Shard:
    """Distinct stretches with the least and greatest document of each, until the index is built."""

    def __init__(self):
        self.contents: dict[bytes, int] = {}
        self.digests: list = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.size = 0

    def add(self, content: bytes, digest, least: int, most: int) -> None:
        k = self.contents.setdefault(content, len(self.contents))
        if k == len(self.digests):
            self.digests.append(digest)
            self.least.append(least)
            self.most.append(most)
            self.size += content.count(b" ") + 2
        else:
            self.least[k] = min(self.least[k], least)
            self.most[k] = max(self.most[k], most)

    def repeats(self, window: int) -> tuple[list, list, list]:
        """(digest, least document, runs) of the stretches that repeat: in the least document, the runs of windows
        from a to b that begin in a lesser one; in all others the stretch goes whole."""
        number: dict[bytes, int] = {}
        texts = [c.split(b" ") for c in self.contents]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]), np.int32)  # 0 parts the stretches
        inner = np.ones(len(text), bool)
        inner[ends - 1] = False
        text[inner] = [number.setdefault(w, len(number) + 1) for own in texts for w in own]
        content = np.repeat(np.arange(len(texts)), lengths + 1)
        low_doc = np.array(self.least, np.int64)

        n_windows = lengths - window + 1
        begins = ends - lengths - 1
        base = np.cumsum(n_windows) - n_windows
        own = np.repeat(np.arange(len(texts)), n_windows)
        starts = np.arange(int(n_windows.sum())) - base[own] + begins[own]
        first_doc = low_doc[own]
        if len(starts) > 1:
            index = FMIndex(text, len(number) + 1, window)
            which, low, high = index.matching(text, starts, window)
            if len(which):
                rows, back = np.unique(low, return_inverse=True)
                tops = np.zeros(len(rows), np.int64)
                tops[back] = high
                edges = np.column_stack([rows, tops]).ravel()
                by_row = np.append(low_doc[content[index.suffixes]], np.iinfo(np.int64).max)
                first_doc[which] = np.minimum.reduceat(by_row, edges)[::2][back]

        gone = first_doc < low_doc[own]
        opens, closes = gone.copy(), gone.copy()
        opens[1:] &= ~gone[:-1] | (own[1:] != own[:-1])
        closes[:-1] &= ~gone[1:] | (own[1:] != own[:-1])
        run_first, run_last = np.flatnonzero(opens), np.flatnonzero(closes)
        of = own[run_first]
        runs = np.column_stack([run_first - base[of], run_last - base[of]]).astype(np.int32)
        upto = np.cumsum(np.bincount(of, minlength=len(texts)))
        chosen = np.flatnonzero((low_doc < np.array(self.most, np.int64)) | (np.diff(upto, prepend=0) > 0)).tolist()
        return [self.digests[k] for k in chosen], low_doc[chosen], [runs[upto[k - 1] if k else 0:upto[k]].tobytes() for k in chosen]


def _intervals(batch: pa.RecordBatch, window: int) -> list[np.ndarray]:
    """(doc_id, first word, end word) of the repeated stretches of words, from places with their stretches' results."""
    holders, held = _unpacked(batch.column("doc_ids"), np.int64)
    places = _unpacked(batch.column("starts"), np.int32)[0].astype(np.int64)
    spans, numbers = _unpacked(batch.column("runs"), np.int32)
    spans, runs_of = spans.astype(np.int64).reshape(-1, 2), numbers // 2
    of = np.repeat(np.arange(len(held)), held)
    low_doc, lengths = np.asarray(batch.column("first")), np.asarray(batch.column("n_words")).astype(np.int64)
    later = holders > low_doc[of]
    least = np.flatnonzero(~later & (runs_of[of] > 0))
    n_runs = runs_of[of[least]]
    place = np.repeat(least, n_runs)
    run = (np.cumsum(runs_of) - runs_of)[of[place]] + np.arange(len(place)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    return [np.concatenate([holders[later], holders[place]]),
            np.concatenate([places[later], places[place] + spans[run, 0]]),
            np.concatenate([places[later] + lengths[of[later]], places[place] + spans[run, 1] + window])]


def repeated_passages(docs: DataFrame, window: int = 13, run: int = 5, mask_bits: int = 28, hot: int = 20_000,
                      shard_words: int = 1 << 17) -> DataFrame:
    """(doc_id, first_word, end_word): intervals of words covered by windows that a smaller id has too.

    Null texts have no words, null ids are left out, rows that share an id are one document. Shards close
    after ``shard_words`` words, between minimizers. ``mask_bits`` sizes the table of shared minimizers;
    a full table costs time, never results.
    """
    own = id_text(docs).filter("doc_id is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    results = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int64()), ("runs", pa.binary())])

    def told(shard):
        digests, first, runs = shard.repeats(window)
        return arrow_rows(results, [[d for d, _ in digests], [d for _, d in digests], first, runs])

    def search(rows):
        shard, last = Shard(), None
        for batch in rows:
            for key, d1, d2, least, most, content in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "least", "most", "content"))):
                if shard.size >= shard_words and key != last:
                    yield told(shard)
                    shard = Shard()
                shard.add(content, (d1, d2), least, most)
                last = key
        if shard.contents:
            yield told(shard)

    def place(rows):
        for batch in rows:
            yield arrow_rows(schema, _intervals(batch, window))

    dealt = written(_dealt(own, window, run, mask_bits, hot), "stretches")
    digests = dealt.select("key", "d1", "d2", "least", "most").repartition("key").sortWithinPartitions("key", "d1", "d2")
    met = written(digests.mapInArrow(_meet, "kind byte, d1 long, d2 long, first long"), "digests")
    alone = met.filter(F.col("kind") == ALONE).select("d1", "d2", "first", F.lit(b"").alias("runs"))

    def fill(rows, bits):
        for batch in rows:
            _set(bits, np.asarray(batch.column("d1")).view(np.uint64) >> np.uint64(64 - TEXT_BITS))

    # Texts to be searched, by a table of fixed size: it lets all of them through, and a few that are settled.
    asked = docs.sparkSession.sparkContext.broadcast(
        additive_table(met.filter(F.col("kind") == SEARCH).select("d1"), fill, 1 << TEXT_BITS - 3, "uint8", np.bitwise_or))

    def wanted(rows):
        for batch in rows:
            yield batch.filter(pa.array(_has(asked.value, np.asarray(batch.column("d1")).view(np.uint64) >> np.uint64(64 - TEXT_BITS))))

    columns = "key long, d1 long, d2 long, least long, most long, content binary"
    texts = dealt.select("key", "d1", "d2", "least", "most", "content").mapInArrow(wanted, columns).repartition("key").sortWithinPartitions("key")
    settled = alone.union(texts.mapInArrow(search, "d1 long, d2 long, first long, runs binary"))
    return dealt.select("d1", "d2", "n_words", "doc_ids", "starts").join(settled, ["d1", "d2"]).mapInArrow(place, "doc_id long, first_word long, end_word long")


def remove_repeats(docs: DataFrame, window: int = 13, **more) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs``: its words without the repeated ones, joined by spaces.

    Only texts that may have repeats, by a table of fixed size, are joined with their intervals; the
    others are finished where they are read.
    """
    gone = repeated_passages(docs, window, **more).groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("gone"))
    gone = written(gone, "repeats")
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << DOC_BITS)).alias("cell")

    def fill(rows, bits):
        for batch in rows:
            _set(bits, np.asarray(batch.column("cell")))

    some = docs.sparkSession.sparkContext.broadcast(additive_table(gone.select(cell), fill, 1 << DOC_BITS - 3, "uint8", np.bitwise_or))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def cut(piece, gone):
        sizes, counts, kept = [], [], []
        for text, own in zip(piece["text"], gone):
            words = text.encode().split()
            sizes.append(len(words))
            if own:
                depth = np.zeros(len(words) + 1, np.int64)
                for g in own:
                    depth[min(g["first_word"], len(words))] += 1
                    depth[min(g["end_word"], len(words))] -= 1
                covered = np.cumsum(depth[:-1]) > 0
                words = [w for w, c in zip(words, covered.tolist()) if not c]
            counts.append(sizes[-1] - len(words))
            kept.append(b" ".join(words))
        return arrow_rows(schema, [piece["doc_id"], sizes, counts, kept])

    def chosen(rows, with_repeats: bool):
        for batch in rows:
            took = _has(some.value, np.asarray(batch.column("cell"))) == with_repeats
            yield batch.filter(pa.array(took))

    def finish(rows):
        for piece in batches(chosen(rows, False), ["doc_id", "text"]):
            yield cut(piece, [None] * len(piece["text"]))

    def pick(rows):
        for batch in chosen(rows, True):
            yield batch.select(["doc_id", "text"])

    def finish_joined(rows):
        for piece in batches(rows, ["doc_id", "text", "gone"]):
            yield cut(piece, piece["gone"])

    out = "doc_id long, n_words long, n_removed long, kept binary"
    texts = id_text(docs).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(1 << DOC_BITS)))
    joined = texts.mapInArrow(pick, "doc_id long, text string").join(gone, "doc_id", "left")
    return texts.mapInArrow(finish, out).unionByName(joined.mapInArrow(finish_joined, out))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {"op10_substring_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
words AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM texts),
windows AS (SELECT doc_id, pos, string_agg(word, ' ') OVER w AS k, count(*) OVER w AS n FROM words
            WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM windows WHERE n = 13 GROUP BY k),
starts AS (SELECT doc_id, pos FROM windows JOIN firsts USING (k) WHERE n = 13 AND first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM starts, range(0, 13) r(j))
SELECT t.doc_id, coalesce(count(w.word), 0) AS n_words, coalesce(count(g.pos), 0) AS n_removed,
       sha256(coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE w.word IS NOT NULL AND g.pos IS NULL), '')) AS kept_sha256
FROM texts t LEFT JOIN words w USING (doc_id) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY t.doc_id"""}
