"""Toxicity, language model, token files and packing."""

import json
import math
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtally.llm import class_lm as C
from fieldtally.llm import packing as P
from fieldtally.llm import token_files as T
from fieldtally.llm import toxicity as X
from fieldtally.llm.tokens import Encoder, default_tokenizer

ODD = [None, "", "\n", " ", "a", "a.", "Ünï, çödé 中文!", "two  spaces", "tab\tand\u00a0nbsp", "end \n", "<|endoftext|> inside", "don't stop... now", "x\n\ny",
       "nul\x00byte", "😀 e\u0301", "long " * 20_000]


def labelled(seed=0, n=400):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(150)]
    rows, labels = [], []
    for d in range(n):
        text = rng.choices(vocabulary, k=40)
        toxic = d % 5 == 0
        if toxic:
            for w in rng.sample(["gronk", "blarg", "snivelok"], 2):
                text[rng.randrange(40)] = w
        rows.append((d, " ".join(text[:20]) + ". You " + " ".join(text[20:]) + "."))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark, documents):
    rows, labels = labelled()
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = documents(rows + [(d + 1000, t) for d, t in enumerate(ODD)] + [(None, "You gronk, you blarg.")])
    model = X.learn(docs, table.filter("doc_id % 4 <> 0 or doc_id is null"))
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    truth = {d: y for d, _, y in labels if d % 4 == 0}
    assert sum((got[d] >= 0.5) == y for d, y in truth.items()) >= 0.97 * len(truth)
    assert all(got[d + 1000] < 0.5 for d in range(len(ODD)))
    clean = X.drop_toxic(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, s in got.items() if s < 0.5}


def test_grammar_scales():
    model = X.Model({"gronk": 4.0, "~snive": 3.0}, 1.0, -3.0)
    value = lambda text: model.strength(text, {})[0]
    assert value("a gronk here") == 4.0 and value("Snivelling, they") == 3.0 and value("nothing at all") == 0
    assert value("you gronk") == pytest.approx(4 * 1.3) and value("not a gronk") == 2.0
    assert value("she said gronk") > value('they wrote "gronk') * 0.5 and value("it was called gronk") == pytest.approx(4 * 0.7)
    assert value("not. gronk") == 4.0  # a clause ends the scope


def test_threats_score_without_an_insult():
    model = X.Model({"gronk": 4.0}, 1.0, -3.0, 2.0)
    value = lambda text: model.strength(text, {})[0]
    assert value("I will kill you") == pytest.approx(2 * 1.3) and value("Te voy a matar") == pytest.approx(2 * 1.3)
    assert value("I will not kill you") == pytest.approx(2 * 1.3 * 0.5)
    assert value("she said I will kill you") == pytest.approx(2 * 1.3 * 0.7)
    assert value("kill the process") == 0 and value("they left. Burn the wood") == 0  # no target in the clause
    assert value("kill you, hurt you") == pytest.approx(4 * 1.3) and value("find you and kill you") == pytest.approx(2 * 1.3)
    assert value("you gronk, I will kill you") == pytest.approx((4 + 2) * 1.3)
    assert model.strength("I will kill you. Calm. You gronk.", {})[1] == 2


@pytest.mark.parametrize("insults", [True, False])
def test_threats_that_no_label_has(spark, documents, insults):
    rows, labels = labelled()
    if not insults:
        rows = [(d, f"plain text number {d}") for d, _ in rows]
    threats = {5000: "I will kill you.", 5001: "I will not kill you.", 5002: "She said I will kill you.", 5003: "kill the process", 5004: ""}
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(rows + list(threats.items()))
    model = X.learn(docs, table)
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert got[5000] > 0.5 and got[5000] > got[5002] > got[5001] > got[5003] == got[5004] < 0.5
    assert not {r.doc_id for r in X.drop_toxic(docs, model).collect()} & {5000}


def test_threats_that_labels_call_clean(spark, documents):
    rows, labels = labelled()
    rows += [(6000 + d, f"We{d} beat{d} all{d} and they beat team{d}") for d in range(20)] + [(5000, "I will kill you.")]
    table = spark.createDataFrame(labels + [(6000 + d, 1, 0) for d in range(20)], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    got = {r.doc_id: r.score for r in X.score(docs, X.learn(docs, table)).collect()}
    assert got[5000] < 0.5


def test_toxicity_without_labels(spark, documents):
    docs, none = documents([(1, "text")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score < 0.5 for r in X.score(docs, X.learn(docs, none)).collect()] == [True]
    assert X.score(documents([]), X.learn(documents([]), none)).collect() == []


def test_class_model(documents):
    rng = random.Random(4)
    left, right = [f"l{k}" for k in range(30)], [f"r{k}" for k in range(30)]
    rows = [(d, " ".join(w for _ in range(rng.randint(5, 40)) for w in (rng.choice(left), rng.choice(right)))) for d in range(300)]
    rows += [(400 + d, t) for d, t in enumerate(ODD)] + [(None, "l1 R2 never")]
    train = F.col("doc_id") % 10 != 0
    got = C.fit_and_score(documents(rows), train, classes=4, exchange_words=40, rounds=4, block_chars=2000).collect()
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    learned = [d for d in tokens if d is not None and d % 10]
    c = Counter(w for d in learned for w in tokens[d])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    held = [r for r in got if r.doc_id is not None and r.doc_id % 10 == 0 and r.doc_id < 300]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # the order of the words is learned


def test_class_model_exchanges_words_beyond_the_table(documents):
    """words that find no place in the table of frequent ones get classes by their neighbours, too."""
    rng = random.Random(4)
    left, right = [f"l{k}" for k in range(30)], [f"r{k}" for k in range(30)]
    rows = [(d, " ".join(w for _ in range(rng.randint(5, 40)) for w in (rng.choice(left), rng.choice(right)))) for d in range(300)]
    rows += [(d, t) for d, t in [(400, None), (401, ""), (402, "l1 never R2"), (None, "l1 r2")]]
    train = F.col("doc_id") % 10 != 0
    got = {size: {r.doc_id: r for r in C.fit_and_score(documents(rows), train, classes=4, exchange_words=size, rounds=4, block_chars=2000).collect()}
           for size in (0, 6, 60)}
    for size in (0, 6):
        assert all(r.base_score == pytest.approx(got[60][d].base_score) and r.n_known == got[60][d].n_known for d, r in got[size].items())
    held = {size: sum(got[size][d].score for d in range(0, 300, 10)) for size in got}
    base = sum(got[6][d].base_score for d in range(0, 300, 10))
    assert held[6] > 0.9 * base
    assert abs(held[6] - held[60]) < 0.05 * abs(held[60])


def test_class_model_is_a_distribution():
    """After each class, the probabilities of all words, the unknown one and the end sum to one."""
    rng = np.random.default_rng(0)
    model = C.ClassModel(3, np.array([0, 1, 2, 0, 1]), np.array([9, 8, 7, 6, 5]), 0, 0, 4)
    rare = np.array([1, 1, 2, 3])
    codes = np.concatenate([np.arange(5), 5 + rare])
    stream = np.concatenate([np.repeat(np.arange(5), model.counts), np.repeat(codes[5:], rare), np.full(4, -1)])
    rng.shuffle(stream)
    own = model.classes_of(stream)
    g = model.all_classes
    counts = np.zeros((g, g), np.int64)
    np.add.at(counts, (np.append(g - 1, own[:-1]), own), 1)
    step, totals = C.replace(model, bigrams=counts).transitions()
    every = np.append(codes, -1)
    p = step[:, model.classes_of(every)] * (model.count_of(every) / totals[model.classes_of(every)])
    assert np.allclose(p.sum(1) + step[:, model.classes + C.BANDS], 1)


def test_class_model_without_training(documents):
    got = C.fit_and_score(documents([(10, "a b"), (20, None)]), F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, r.score == r.base_score) for r in got] == [(0, 0, True)] * 2
    assert C.fit_and_score(documents([]), F.lit(True)).collect() == []


SHUFFLED_BY_CLASS_MODEL = """
import random, sys
from pyspark.sql import functions as F
from fieldtally.llm import class_lm as C
from fieldtally.session import build_session

folder = "file://" + sys.argv[1]
spark = build_session("shuffled", "local[4]", **{
    "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": folder + "/shared",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": folder + "/events", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
rng = random.Random(5)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20_000)]
docs = spark.createDataFrame([(d, " ".join(rng.choices(words, k=100))) for d in range(600)], "doc_id long, text string").repartition(2)
assert len(C.fit_and_score(docs, F.lit(True), classes=4, exchange_words=100, rounds=1, block_chars=30_000).collect()) == 600
spark.stop()
"""


def test_class_model_shuffles_little(tmp_path):
    """Disk finding: what blocks and words tell each other is packed, it isn't a row for each word of a block."""
    (tmp_path / "events").mkdir()
    subprocess.run([sys.executable, "-c", SHUFFLED_BY_CLASS_MODEL, str(tmp_path)], check=True, timeout=300, cwd=Path(C.__file__).parents[2])
    events = [json.loads(line) for log in (tmp_path / "events").iterdir() if log.name[0] != "." for line in log.read_text().splitlines()]
    ended = [e["Task Metrics"] for e in events if e["Event"] == "SparkListenerTaskEnd"]
    assert 0 < sum(m["Shuffle Write Metrics"]["Shuffle Bytes Written"] for m in ended) < 1_600_000


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_encoder_is_the_library(tokenizer):
    rng = random.Random(1)
    parts = ["a", "Bé", "ß", "中", "'s", "1", "23", "!", "...", ",", ".", " ", " ", " ", "\n", "\t", "\u00a0", "<|endoftext|>", "²", "ʰ", "\x00", "don't", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + [t or "" for t in ODD]
    encoder = Encoder(default_tokenizer(), most_words=200)
    for a in range(0, len(texts), 90):
        ids, sizes = encoder.encode(texts[a:a + 90])
        parts_ = np.split(ids, np.cumsum(sizes)[:-1])
        for text, own in zip(texts[a:a + 90], parts_):
            assert own.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_word_is_merged_once_for_all_its_endings(tokenizer):
    """CPU of packing and token files: endings and a full cache don't merge a frequent word again."""
    encoder, merged = Encoder(default_tokenizer(), most_words=40), Counter()
    merges = encoder.tokenizer.model.tokenize
    encoder.merges = lambda word: merged.update([word]) or merges(word)
    for k in range(10):
        texts = [" ".join(["x", "often", "often", "often,", "often.", "often!?", "often$$$", "oftén&", "x\nx", *(f"{'abcdefghij'[k]}{c}once" for c in "abcdefghij")])]
        ids, _ = encoder.encode(texts)
        assert ids.tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert merged["\u0120often"] == 1


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.zeros(5, np.uint32), rng.integers(0, 50_257, 1000).astype(np.uint32), np.array([2**32 - 1, 0, 7], np.uint32)):
        assert T.unpack(T.pack(ids, 64, bits)).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        T.unpack(T.pack(np.arange(10, dtype=np.uint32), 64, bits)[:-1])
    with pytest.raises(ValueError):
        T.unpack(b"X" * 64)


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_token_files(spark, documents, tokenizer, tmp_path, chunk):
    rows = [(40 - d, t) for d, t in enumerate(ODD)] + [(7, "twice"), (7, "twice"), (None, "null id")]
    T.write_token_files(documents(rows), str(tmp_path / "f"), chunk_ids=chunk)
    got = T.read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert len(got) == len(rows)
    start = 0
    texts = {d: t for d, t in rows}
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    for r in got:
        own = ids_of(tokenizer, texts[r.doc_id], 2)
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == own
        start += len(own)


def test_token_files_of_an_empty_table(spark, documents, tmp_path):
    T.write_token_files(documents([]), str(tmp_path / "f"))
    assert T.read_token_files(spark, str(tmp_path / "f")).collect() == []


def test_packing(documents, tokenizer):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choices(["some", "words.", "to", "pack,", "Überall", "now!\nNext"], k=rng.randint(0, 900)))) for d in range(60)]
    rows += [(100 + d, t) for d, t in enumerate(ODD)] + [(None, "null id")]
    pieces = P.pack_documents(documents(rows), run_ids=5000).collect()
    texts = dict(rows)
    for d in texts:
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        ids = ids_of(tokenizer, texts[d], 0)
        assert all(p.doc_tokens == len(ids) for p in own)
        assert [i for p in own for i in np.frombuffer(p.ids, "<u4").tolist()] == ids
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0) and p.length > 0
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values()) <= 1024
    full = [v for v in sequences.values() if v < 900]
    assert len(full) <= 4  # only the last window of a partition is short
    assert P.pack_documents(documents([])).collect() == []


def test_cheapest_cuts_against_all_cuttings():
    rng = random.Random(6)
    for _ in range(40):
        at = sorted({0, *rng.sample(range(1, 40), 8)})
        at += [at[-1] + rng.randint(1, 10)]
        if max(b - a for a, b in zip(at, at[1:])) > 12:
            continue
        price = [0] + [rng.choice([0, 2, 16]) for _ in at[1:]]
        best = [0] + [math.inf] * (len(at) - 1)
        for k in range(1, len(at)):
            best[k] = min(best[i] + price[k] + 12 - (at[k] - at[i]) for i in range(k) if at[k] - at[i] <= 12)
        cuts = [0, *P.cheapest_cuts(at, price, 12)]
        assert sum(price[b] + 12 - (at[b] - at[a]) for a, b in zip(cuts, cuts[1:])) == best[-1]
