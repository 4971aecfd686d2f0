"""Class-based bigram language model (Brown et al.) by exchange clustering, over the whole corpus.

P(w | v) = P(class of w | class of v) x P(w | class of w), mixed with the smoothed word frequencies.

Texts are cut into blocks; a block knows its distinct words and its documents as numbers of those. The
words of a block are dealt by hash to parts, where they meet those of the other blocks and are counted;
each block gets its words' codes back, so texts are read once and never shuffled. What a block and a part
send each other is one row of packed numbers, not a row for each word. A code is the word's rank if it is one of the
``exchange_words`` most frequent ones and seen ``least_count`` times, and ``exchange_words`` + its
training count if it is seen less often: those words share classes by count. All others are late words,
numbered in their block.
In an exchange round, all frequent words are counted against the classes before and after them, and a
part of them move to the class that raises the likelihood most. Words that move at once can spoil it
for each other, so a round that lowers the likelihood is taken back and the next one moves fewer.
These counts are tables of fixed size. The late words, however many, move by the same rule in a round
of their own, when the frequent ones have settled: their counts meet in their words' parts, and every
block gets the classes of its late words back. Until then they stand in the classes by count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import additive_table, arrow_rows, batches, crc_bucket, table, written

#: Classes of rarer words: training count 1, 2-3, 4-7, ... and the last for all above; then unknown words; then the end.
BANDS = 8


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each as byte planes of the least width, compressed together."""
    from zstandard import ZstdCompressor

    head, planes = [len(arrays)], []
    for x in arrays:
        width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
        head += [len(x), width]
        planes.append(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return ZstdCompressor(1).compress(np.array(head, "<u4").tobytes() + b"".join(planes))


def unpack(packed: bytes) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    data = ZstdDecompressor().decompress(packed)
    arrays = int.from_bytes(data[:4], "little")
    at, out = 4 + 8 * arrays, []
    for n, width in np.frombuffer(data, "<u4", 2 * arrays, 4).reshape(-1, 2).tolist():
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(whole.view("<i8").ravel())
        at += n * width
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first value ahead: np.cumsum undoes it."""
    return np.diff(rising, prepend=0)


def joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int64)


class Numbering(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _blocks(docs: DataFrame, chars: int) -> DataFrame:
    """One row for ``chars`` of text or a little more: documents as local word numbers, words, their training counts."""
    import zstandard  # noqa: F401  workers need it

    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
                        ("numbers", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])

    def cut(rows):
        block = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        size = 0

        def close():
            number = Numbering()
            ids, train, lengths, numbers = [], [], [], []
            for piece in held:
                texts = [t.encode().lower().split() for t in piece["text"]]
                ids += piece["doc_id"]
                train += piece["train"]
                lengths += map(len, texts)
                numbers += [np.fromiter(map(number.__getitem__, own), np.int32, len(own)) for own in texts]
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            counts = np.bincount(flat[np.repeat(train, lengths)], minlength=len(number))
            words = b" ".join(number).decode().split(" ") if number else []
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")  # small numbers for frequent words
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            return arrow_rows(schema, [[block], [ids], [train], [lengths], [pack(place[flat])], [[words[w] for w in order]], [counts[order].astype(np.int32)]])

        for piece in batches(rows, ["doc_id", "train", "text"], 1_000_000):
            held.append(piece)
            size += sum(map(len, piece["text"]))
            if size >= chars:
                yield close()
                held, size, block = [], 0, block + 1
        if held:
            yield close()

    return written(docs.mapInArrow(cut, "block long, doc_ids array<long>, train array<boolean>, lengths array<int>, numbers binary, "
                                        "words array<string>, counts array<int>"), "lm-blocks")


def _counted(blocks: DataFrame, parts: int) -> DataFrame:
    """For every block and part, places, ids and training counts of their words; for every part, a row without block: its trained words."""
    dealt_schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("own", pa.binary())])

    def deal(rows):
        from zstandard import ZstdCompressor

        for batch in rows:
            for r in range(batch.num_rows):
                keys = batch.column("keys")[r].values.to_numpy()
                part = keys % parts
                order = np.argsort(part, kind="stable")
                words = batch.column("words")[r].values.cast(pa.large_binary()).take(pa.array(order))
                lengths = pc.binary_length(words).to_numpy()
                data, ends = memoryview(b"".join(words.to_pylist())), np.append(0, np.cumsum(lengths))
                marked, n = lengths * 4 + (keys[order] & 3), batch.column("counts")[r].values.to_numpy()[order]
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                held = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                at = [slice(cuts[p], cuts[p + 1]) for p in held]
                yield arrow_rows(dealt_schema, [held, [batch.column("block")[r].as_py()] * len(held),
                                                [ZstdCompressor(3).compress(data[ends[x.start]:ends[x.stop]]) for x in at],
                                                [pack(marked[x], steps(order[x]), n[x]) for x in at]])

    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("own", pa.binary()), ("words", pa.list_(pa.string())),
                        ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def meet(rows: pa.Table) -> pa.Table:
        from zstandard import ZstdDecompressor

        own = [unpack(x) for x in rows.column("own").to_pylist()]
        marked, n = joined([x[0] for x in own]), joined([x[2] for x in own])
        data = b"".join(ZstdDecompressor().decompress(x) for x in rows.column("words").to_pylist())
        offsets = np.append(0, np.cumsum(marked >> 2))
        words = pa.Array.from_buffers(pa.large_string(), len(marked), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        number, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
        ids = np.zeros(len(distinct), np.int64)
        ids[number] = number * 4 + (marked & 3)  # the last bits of the key choose the words that stay
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, number, n)
        ends = np.cumsum([len(x[0]) for x in own])[:-1]
        packed = [pack(x[1], i, c) for x, i, c in zip(own, np.split(ids[number], ends), np.split(counts[number], ends))]
        known, blanks = np.flatnonzero(counts), [None] * len(own)
        return pa.Table.from_batches([arrow_rows(schema, [rows.column("part").to_pylist(), rows.column("block").to_pylist(), packed, blanks, blanks, blanks]),
                                      arrow_rows(schema, [rows.column("part").to_pylist()[:1], [None], [None], [distinct.take(pa.array(known)).to_pylist()], [ids[known]], [counts[known]]])])

    dealt = blocks.select("block", "words", "counts", F.transform("words", lambda w: F.xxhash64(w)).alias("keys")).mapInArrow(
        deal, "part int, block long, words binary, own binary")
    return written(dealt.groupBy("part").applyInArrow(meet, "part int, block long, own binary, words array<string>, ids array<long>, counts array<long>"), "lm-words")


def _encoded(blocks: DataFrame, counted: DataFrame, top: np.ndarray, exchange_words: int, least_count: int) -> DataFrame:
    """Blocks whose documents are written in codes, the same in every block but for those of late words; keys and counts of these.

    ``top`` has the keys of the frequent words by rank.
    """
    ranks = np.argsort(top)
    known = np.append(top[ranks], np.iinfo(np.int64).max)
    placed_schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("own", pa.binary())])

    def code(rows):
        for batch in rows:
            packed = []
            for part, own in zip(batch.column("part").to_pylist(), batch.column("own").to_pylist()):
                places, ids, counts = unpack(own)
                keys = (part << 32) + ids
                at = np.searchsorted(known, keys)
                frequent = known[at] == keys
                codes = counts + exchange_words
                codes[frequent] = ranks[at[frequent]]
                packed.append(pack(places, codes, ids[~frequent & (counts >= least_count)]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(packed, pa.binary())], schema=placed_schema)

    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
                        ("codes", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])

    def translate(own: pa.Table, placed: pa.Table) -> pa.Table:
        got = [unpack(x) for x in placed.column("own").to_pylist()]
        order = np.argsort(joined([np.cumsum(x[0]) for x in got]))
        codes, keys = joined([x[1] for x in got]), np.zeros(len(order), np.int64)
        keys[codes >= exchange_words + least_count] = joined([(p << 32) + x[2] for p, x in zip(placed.column("part").to_pylist(), got)])
        codes, keys = codes[order], keys[order]
        at = np.flatnonzero(codes >= exchange_words + least_count)
        counts = codes[at] - exchange_words
        codes[at] = exchange_words + least_count + np.arange(len(at))
        numbers = unpack(own.column("numbers")[0].as_py())[0]
        packed = [[pack(x)] for x in (codes[numbers], keys[at], counts)]
        return pa.Table.from_arrays([*(own.column(c).cast(schema.field(c).type) for c in ("block", "doc_ids", "train", "lengths")),
                                     *(pa.array(x, pa.binary()) for x in packed)], schema=schema)

    placed = counted.filter("block is not null").select("part", "block", "own").mapInArrow(code, "block long, part int, own binary")
    mine = blocks.select("block", "doc_ids", "train", "lengths", "numbers")
    return written(mine.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(
        translate, "block long, doc_ids array<long>, train array<boolean>, lengths array<int>, codes binary, keys binary, counts binary"), "lm-codes")


#: What ``_read`` needs.
READ = ("doc_ids", "train", "lengths", "codes", "counts", "classes")


def _read(rows: Iterator[pa.RecordBatch], model: ClassModel):
    """(doc_ids, train, lengths, codes, classes) of each block, with the counts of late words in their codes."""
    for batch in rows:
        for k in range(batch.num_rows):
            ids, train, lengths, codes, counts, own = (batch.column(c)[k].as_py() for c in READ)
            flat = unpack(codes)[0]
            first = len(model.class_of) + model.least_count
            at = np.flatnonzero(flat >= first)
            late = flat[at] - first
            flat[at] = len(model.class_of) + unpack(counts)[0][late]
            classes = model.classes_of(flat)
            if own is not None:
                classes[at] = unpack(own)[0][late]
            yield ids, np.array(train, bool), np.array(lengths, np.int64), flat, classes


@dataclass(frozen=True)
class ClassModel:
    classes: int                 # of exchange words
    class_of: np.ndarray         # by rank
    counts: np.ndarray           # by rank: training counts
    tokens: int                  # N
    types: int                   # V
    end_count: int
    least_count: int = 2         # words seen as often, or more often, are exchanged
    bigrams: np.ndarray | None = None   # class before x class, over training texts
    weight: float = 0.95         # of the class model
    prior: float = 10.0

    @property
    def all_classes(self) -> int:
        return self.classes + BANDS + 2

    def classes_of(self, codes: np.ndarray) -> np.ndarray:
        """Class of each code; -1 stands for the end."""
        k = len(self.class_of)
        own = np.full(len(codes), self.classes + BANDS + 1, np.int64)
        frequent = (codes >= 0) & (codes < k)
        own[frequent] = self.class_of[codes[frequent]]
        rare = codes >= k
        count = codes[rare] - k
        band = np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), BANDS - 1)
        own[rare] = np.where(count > 0, self.classes + band, self.classes + BANDS)
        return own

    def count_of(self, codes: np.ndarray) -> np.ndarray:
        k = len(self.class_of)
        own = np.full(len(codes), self.end_count, np.int64)
        frequent = (codes >= 0) & (codes < k)
        own[frequent] = self.counts[codes[frequent]]
        own[codes >= k] = codes[codes >= k] - k
        return own

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        """P(class | class before), rows summing to one, and the training tokens of each class.

        A word seen once would be unknown without that text: half of what words seen once get goes to
        unknown words, and after an unknown word comes what comes after words seen once.
        """
        seen = self.bigrams.astype(float)
        once, unknown = self.classes, self.classes + BANDS
        totals = seen.sum(0)
        seen[:, unknown] = seen[:, once] / 2
        seen[:, once] /= 2
        seen[unknown] = seen[once]
        overall = seen[:unknown].sum(0) + seen[unknown + 1:].sum(0)
        overall /= max(overall.sum(), 1.0)
        return (seen + self.prior * overall) / (seen.sum(1, keepdims=True) + self.prior), totals


def with_ends(lengths: np.ndarray, codes: np.ndarray, end: int = -1) -> np.ndarray:
    """The codes (or classes) of the documents one after another, ``end`` after each."""
    return np.insert(codes, np.cumsum(lengths), end)


def _statistics(corpus: DataFrame, model: ClassModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over training texts: (word, class before), (word, class after) and (class before, class) counts."""
    k, g = len(model.class_of), model.all_classes
    own = k * g

    def fill(rows, counts):
        for _, train, lengths, codes, classes in _read(rows, model):
            learned = np.repeat(train, lengths)
            chosen, classes = with_ends(lengths[train], codes[learned]), with_ends(lengths[train], classes[learned], g - 1)
            before = np.append(g - 1, classes[:-1])
            counts[2 * own:2 * own + g * g] += np.bincount(before * g + classes, minlength=g * g)
            if k:
                at = np.flatnonzero((chosen >= 0) & (chosen < k))
                counts[:own] += np.bincount(chosen[at] * g + before[at], minlength=own)
                counts[own:2 * own] += np.bincount(chosen[at] * g + classes[at + 1], minlength=own)

    got = additive_table(corpus.select(*READ), fill, 2 * own + g * g)
    return got[:own].reshape(-1, g), got[own:2 * own].reshape(-1, g), got[2 * own:2 * own + g * g].reshape(g, g)


def likelihood(bigrams: np.ndarray) -> float:
    """Log-likelihood of the classes, but for a part that no exchange changes."""
    def total(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1))).sum())
    seen = bigrams.astype(float)
    return total(seen) - total(seen.sum(0)) - total(seen.sum(1))


def chooser(bigrams: np.ndarray, c: int):
    """A function that finds, among the first ``c`` classes, the best of each word, and whether it is better than the present one.

    That is the class where the counts of its neighbours have the highest likelihood, with the word's
    own counts taken out of its present class.
    """
    left, right = bigrams.sum(1), bigrams.sum(0)
    log = lambda x: np.log(np.maximum(x, 0) + 0.5)
    into, out = log(bigrams[:, :c]) - log(right[:c]), log(bigrams[:c]).T - log(left[:c])

    def choose(before: np.ndarray, after: np.ndarray, now: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain = before @ into + after @ out
        rows, own, n = np.arange(len(now)), now < c, n[:, None]
        stays = (before * (log(bigrams[:, now].T - before) - log(right[now][:, None] - n))).sum(1) \
            + (after * (log(bigrams[now] - after) - log(left[now][:, None] - n))).sum(1)
        gain[rows[own], now[own]] = stays[own]
        best = gain.argmax(1)
        return best, gain[rows, best] > stays + 1e-9

    return choose


def exchange(model: ClassModel, before: np.ndarray, after: np.ndarray, bigrams: np.ndarray, turn: int, parts: int) -> np.ndarray:
    """New classes of every ``parts``-th word, beginning with number ``turn``; the others stay."""
    choose = chooser(bigrams, model.classes)
    moved = model.class_of.copy()
    for a in range(0, len(moved), 4096):
        b = slice(a, a + 4096)
        now = moved[b]
        best, better = choose(before[b], after[b], now, model.counts[b])
        took = (np.arange(a, a + len(now)) % parts == turn % parts) & better
        moved[b] = np.where(took, best, now)
    return moved


def _late_exchange(corpus: DataFrame, model: ClassModel, bigrams: np.ndarray, parts: int) -> DataFrame:
    """The corpus with new classes of the late words of each block; all but every ``parts``-th word stay."""
    k, g = len(model.class_of), model.all_classes
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("own", pa.binary())])

    def count(rows):
        for batch in rows:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                keys = unpack(row.column("keys")[0].as_py())[0]
                raw = unpack(row.column("codes")[0].as_py())[0]
                _, train, lengths, _, classes = next(_read(iter([row]), model))
                learned = np.repeat(train, lengths)
                chosen, classes = with_ends(lengths[train], raw[learned]), with_ends(lengths[train], classes[learned], g - 1)
                before = np.append(g - 1, classes[:-1])
                at = np.flatnonzero(chosen >= k + model.least_count)
                by_part = np.argsort(keys >> 32, kind="stable")
                place = np.empty(len(keys), np.int64)
                place[by_part] = np.arange(len(keys))
                late = place[np.concatenate([chosen[at], chosen[at]]) - (k + model.least_count)]
                cells = np.concatenate([before[at], g + classes[at + 1]])[np.argsort(late, kind="stable")]
                seen = np.bincount(late, minlength=len(keys))
                ends = np.append(0, np.cumsum(seen))
                held, cuts = np.unique(keys[by_part] >> 32, return_index=True)
                dealt = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
                yield arrow_rows(schema, [held, [row.column("block")[0].as_py()] * len(held), [
                    pack(steps(by_part[x]), keys[by_part[x]] & 0xFFFFFFFF, seen[x], cells[ends[x.start]:ends[x.stop]]) for x in dealt]])

    out = pa.schema([("block", pa.int64()), ("own", pa.binary())])

    def move(rows: pa.Table) -> pa.Table:
        choose = chooser(bigrams, model.classes)
        own = [unpack(x) for x in rows.column("own").to_pylist()]
        ids, word = np.unique(joined([x[1] for x in own]), return_inverse=True)
        owner = np.repeat(word, joined([x[2] for x in own]))
        order = np.argsort(owner, kind="stable")
        owner, cells = owner[order], joined([x[3] for x in own])[order]
        classes = np.zeros(len(ids), np.int64)
        for a in range(0, len(ids), 4096):
            first = ids[a:a + 4096]
            begin, end = np.searchsorted(owner, [a, a + len(first)])
            counts = np.bincount((owner[begin:end] - a) * 2 * g + cells[begin:end], minlength=len(first) * 2 * g).reshape(len(first), 2, g)
            n = counts[:, 0].sum(1)
            now = model.classes_of(k + n)
            best, better = choose(counts[:, 0], counts[:, 1], now, n)
            classes[a:a + len(first)] = np.where(better & (first % parts == 0), best, now)
        ends = np.cumsum([len(x[0]) for x in own])[:-1]
        packed = [pack(x[0], c) for x, c in zip(own, np.split(classes[word], ends))]
        return pa.Table.from_batches([arrow_rows(out, [rows.column("block").to_pylist(), packed])])

    def place(own: pa.Table, moved: pa.Table) -> pa.Table:
        got = [unpack(x) for x in moved.column("own").to_pylist()]
        classes = joined([x[1] for x in got])[np.argsort(joined([np.cumsum(x[0]) for x in got]))]
        return own.append_column("classes", pa.array([pack(classes)], pa.binary()))

    moved = corpus.mapInArrow(count, "part int, block long, own binary").groupBy("part").applyInArrow(move, "block long, own binary")
    mine = corpus.select("block", *READ[:-1])
    return written(mine.groupBy("block").cogroup(moved.groupBy("block")).applyInArrow(
        place, "block long, doc_ids array<long>, train array<boolean>, lengths array<int>, codes binary, counts binary, classes binary"), "lm-classes")


def fit_and_score(docs: DataFrame, train: Column, classes: int = 32, exchange_words: int = 65_536, rounds: int = 4,
                  least_count: int = 2, block_chars: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row for each input row.

    ``train`` says which rows are learned from. Words are lower-cased (A-Z) and cut at ASCII blanks;
    every text, null and empty ones too, has an end token. ``score`` is the model's log10 probability of
    the text, ``base_score`` that of the smoothed word frequencies. Without training text both are the
    same. All words of all texts are counted, and all seen ``least_count`` times are exchanged: the
    ``exchange_words`` most frequent ones in ``rounds`` rounds, the others in a round after these.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = _blocks(own, block_chars)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count() // 16)  # a part's words fit a task
    counted = _counted(blocks, parts)
    vocabulary = counted.filter("block is null").select("part", F.explode(F.arrays_zip("words", "ids", "counts")).alias("w")).select(
        F.col("w.words").alias("word"), (F.shiftleft(F.col("part").cast("long"), 32) + F.col("w.ids")).alias("key"), F.col("w.counts").alias("c"))
    top = written(vocabulary.filter(F.col("c") >= least_count).orderBy(F.desc("c"), "word").limit(exchange_words).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("c"), "word")).cast("long") - 1), "lm-frequent")
    types, word_tokens, exchanged = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") >= least_count, 1))).first()
    ends = blocks.select(F.explode("train").alias("t")).filter("t").count()
    frequent = top.select("c", "key").orderBy("rank").collect()  # at most ``exchange_words`` rows
    counts, keys = (np.array([r[x] for r in frequent], np.int64) for x in ("c", "key"))
    coded = _encoded(blocks, counted, keys, exchange_words, least_count)
    corpus = coded.withColumn("classes", F.lit(None).cast("binary"))
    model = ClassModel(classes, np.arange(len(counts)) % classes, counts, word_tokens + ends, types + (ends > 0), ends, least_count)
    if len(counts) < exchange_words:  # codes of rarer words begin at ``exchange_words`` all the same
        pad = exchange_words - len(counts)
        model = replace(model, class_of=np.append(model.class_of, np.zeros(pad, np.int64)), counts=np.append(counts, np.zeros(pad, np.int64)))
    seen, parts = _statistics(corpus, model), 2
    for turn in range(rounds):
        moved = replace(model, class_of=exchange(model, *seen, turn, parts))
        new = _statistics(corpus, moved)
        if likelihood(new[2]) > likelihood(seen[2]):
            model, seen = moved, new
        else:
            parts *= 2
    for parts in (1, 2, 4) if exchanged > exchange_words else ():
        moved = _late_exchange(corpus, model, seen[2], parts)
        new = _statistics(moved, model)
        if likelihood(new[2]) > likelihood(seen[2]):
            corpus, seen = moved, new
            break
    return _scored(corpus, replace(model, bigrams=seen[2]))


def _scored(corpus: DataFrame, model: ClassModel) -> DataFrame:
    step, totals = model.transitions()
    unknown = model.classes + BANDS
    g, log_n = model.all_classes, model.tokens + 0.1 * (model.types + 1)
    weight = model.weight if model.tokens else 0.0
    schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def run(rows):
        for ids, train, lengths, codes, classes in _read(rows, model):
            count, own = model.count_of(with_ends(lengths, codes)), with_ends(lengths, classes, g - 1)
            base = (count + 0.1) / log_n
            in_class = np.where(own == unknown, 1.0, count / np.maximum(totals[own], 1.0))
            mixed = weight * step[np.append(g - 1, own[:-1]), own] * in_class + (1 - weight) * base
            starts = np.append(0, np.cumsum(lengths + 1)[:-1])
            sums = [np.add.reduceat(x, starts) if len(ids) else x for x in (np.log10(base), np.log10(mixed), (count > 0).astype(np.int64))]
            yield arrow_rows(schema, [ids, train, lengths + 1, sums[2], np.full(len(ids), model.tokens), sums[0], sums[1], 10 ** (-sums[1] / (lengths + 1))])

    return corpus.select(*READ).mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fit_and_score(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
