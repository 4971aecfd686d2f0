"""Similarity classes, decontamination and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from fieldtally.llm import components, decontamination as D
from fieldtally.llm import jaccard_join as J
from fieldtally.llm import substring_dedup as S
from fieldtally.llm.fm_index import FMIndex


def variants(seed=3):
    """Texts with copies, chains of small edits, shared passages and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = own
            text = " ".join(own)
            rows.append((n * 3 + 1, f"{passage} {text}" if rng.random() < 0.3 else text))
            n += 1
    rows += [(0, None), (500, ""), (501, " \n"), (502, "one two"), (503, "ONE\ttwo"), (504, "one two three"), (505, "a a a a a a a"), (506, "a a a a")]
    return rows, n


def brute_classes(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_classes(documents, size, percent):
    rows, _ = variants()
    got = J.similar_classes(documents(rows + [(None, rows[0][1])]), size, percent).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert found.pop(None)[1] is None
    assert found == brute_classes(rows, size, percent) and len(got) == len(rows) + 1


def test_classes_of_a_large_group(documents):
    """Near copies that all differ: the group is one class although not all pairs are similar."""
    rng = random.Random(1)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for d in range(150):
        own = list(base)
        for k in rng.sample(range(60), rng.choice([0, 1, 2])):
            own[k] = f"e{d}"
        rows.append((d, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_classes(documents(rows), 4, 85).collect()}
    assert got == brute_classes(rows, 4, 85)


def test_classes_repeated_rows_and_empty_table(documents):
    got = J.similar_classes(documents([(4, "a b c d e"), (4, "a b c d e"), (9, "A b C d e")]), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(4, 4), (4, 4), (9, 4)]
    assert J.similar_classes(documents([]), 4, 85).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    nodes = spark.range(0, 103).select("id").withColumnRenamed("id", "node")
    got = {r.node: r.component for r in components.connected(nodes, edges).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100 and got[102] == 102


def brute_leaks(rows, items, shingle=5, least=0.8):
    from collections import Counter

    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        for i, text in items:
            own = (text or "").encode().lower().split()
            if not own or i is None:
                continue
            k = min(shingle, len(own))
            want = Counter(zip(*(own[j:] for j in range(k))))
            for a in range(len(w) - len(own) + 1):
                part = w[a:a + len(own)]
                both = sum((Counter(zip(*(part[j:] for j in range(k)))) & want).values())
                value = both / (2 * (len(own) - k + 1) - both)
                if value >= least:
                    out[d, i] = max(value, out.get((d, i), 0))
    return out


def test_leaks(spark, documents):
    rng = random.Random(5)
    words = [f"q{k}" for k in range(80)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(14, 60)))) for k in range(12)] + [(20, "three short words"), (21, None), (22, " "), (None, "q1 q2 q3 q4 q5")]
    rows = []
    for d in range(60):
        text = rng.choices(words, k=rng.randint(0, 150))
        if d % 3 == 0:
            own = items[d % 12][1].split()
            if d % 2:
                own[0] = "edited"
            at = rng.randint(0, len(text))
            text[at:at] = own
        rows.append((d, " ".join(text).upper() if d % 5 == 0 else " ".join(text)))
    rows += [(200, "so three\nSHORT words here"), (201, None), (202, "")]
    table = spark.createDataFrame(items + items[:1], "item_id long, text string")
    want = brute_leaks(rows, items)
    for block in (5000, 5):
        got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(documents(rows), table, block_items=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    docs = documents(rows + [(None, items[0][1])])
    kept = D.drop_contaminated(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert D.contaminated(documents(rows), table.limit(0)).collect() == []
    assert D.contaminated(documents([]), table).collect() == []


@pytest.mark.parametrize("filler", ["foreign", "one foreign word", "one item word"])
def test_leaks_of_long_items_with_another_end(filler):
    """Windows at the threshold are found although all their other words are unknown to the benchmark, or one word again and again."""
    rng = random.Random(8)
    for n in (100, 150, 200, 300, 500):
        items = [(k, " ".join(rng.choices([f"q{j}" for j in range(900)], k=n))) for k in range(6)]
        bench = D.Benchmark([(k, t.encode()) for k, t in items], 5, 0.8, 40)
        rows = []
        for k, t in items:
            own = t.split()
            other = {"foreign": [f"f{j}" for j in range(n + 30)], "one foreign word": ["la"] * (n + 30), "one item word": own[:1] * (n + 30)}[filler]
            cut = int((n - 4) * 0.11)
            text = other[:15] + own[:-cut] + other[15:30 + cut] if k % 2 else other[:15 + cut] + own[cut:] + other[15 + cut:30 + cut]
            rows.append((k, " ".join(text)))
        want = brute_leaks(rows, items)
        got = {(d, i): s for (d, _), own in zip(rows, bench.search([t for _, t in rows])) for i, s, _, _ in own}
        assert {(k, k) for k, _ in items} == want.keys() == got.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_leaks_in_documents_shorter_than_the_item(spark, documents):
    """A document of fewer words than the item is one window, compared with its own size."""
    rng = random.Random(12)
    items = [(k, " ".join(rng.choices([f"q{j}" for j in range(60)], k=n))) for k, n in enumerate((6, 12, 40, 41, 200))] + [(9, "four words of text")]
    rows, want = [], {}
    for k, t in items:
        own = t.split()
        for less in range(1, len(own)):
            part = own[less // 2:len(own) - (less - less // 2)]
            rows.append((100 * k * 3 + less, " ".join(part)))
            held, m = max(0, len(part) - 4), len(own) - 4
            if len(own) > 4 and held / m >= 0.8:
                want[rows[-1][0], k] = held / m, 0, len(part)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in D.contaminated(documents(rows), table).collect()}
    assert {k for _, k in want} == {1, 2, 3, 4} and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r.doc_id for r in D.drop_contaminated(documents(rows), table).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_window_sums_number_equal_shingles():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 6, 60).astype(np.uint64)
    for m in (1, 7, 60):
        for a, own in enumerate(D.window_sums(hashes, m)):
            assert (own == D.window_sums(np.sort(hashes[a:a + m]), m)[0]).all()


def test_hamming_blocks_find_all_within_the_radius():
    """Fingerprints within the radius share a block, whichever bits differ."""
    rng = np.random.default_rng(0)
    bench = D.Benchmark([(1, b" ".join(b"k%d" % k for k in range(30)))], 5, 0.8, 40)
    for _ in range(300):
        other = bench.prints[0].copy()
        other[rng.choice(D.BITS, int(rng.integers(0, 41)), replace=False)] ^= True
        assert any((30, b, key) in bench.index for b, key in enumerate(bench.blocks(other)))


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 6, 400), 0).astype(np.int32)
    index = FMIndex(text, 6)
    for length in (1, 2, 5, 13):
        starts = np.arange(len(text) - length)
        which, low, high = index.matching(text, starts, length)
        windows = [tuple(text[a:a + length]) for a in range(len(text) - length + 1)]
        for k in range(len(starts)):
            n = windows.count(windows[k])
            at = np.flatnonzero(which == k)
            assert len(at) == (n > 1)
            if n > 1:
                assert sorted(index.suffixes[low[at[0]]:high[at[0]]]) == [a for a, w in enumerate(windows) if w == windows[k]]


def brute_repeats(rows, window=13):
    words = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][k:k + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < d:
                gone.update(range(k, k + window))
        out[d] = len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)
    return out


@pytest.mark.parametrize("more", [{}, {"hot": 2}, {"shard_words": 50}, {"mask_bits": 4, "shard_words": 300}])
def test_repeats(documents, more):
    rng = random.Random(9)
    vocabulary = [f"s{k}" for k in range(40)]
    passages = [rng.choices(vocabulary, k=rng.randint(13, 70)) for _ in range(4)]
    rows = []
    for d in range(70):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        for p in rng.sample(passages, rng.choice([0, 1, 1, 2])):
            at, a = rng.randint(0, len(text)), rng.randint(0, len(p) - 1)
            text[at:at] = p[a:]
        rows.append((d * 7 % 71, " ".join(text)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, "same " * 60), (104, "same " * 45), (105, "Same " * 45), (106, " ".join(passages[0][:12]))]
    got = S.remove_repeats(documents(rows + [(None, rows[3][1])]), **more).collect()
    found = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in got}
    assert found.pop(None)[1] == 0
    assert found == brute_repeats(rows)


@pytest.mark.parametrize("window", [5, 16, 20, 50])
def test_repeats_of_other_windows(documents, window):
    """Passages that agree in far more than sixteen words and part then, so that a shallow sort would mix them up."""
    rng = random.Random(window)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for d in range(40):
        a = rng.randint(0, 20)
        text = base[a:a + rng.randint(30, 65)]
        text[rng.randint(17, len(text) - 1)] = rng.choice("xyz")
        rows.append((d, " ".join(text)))
    found = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in S.remove_repeats(documents(rows), window, shard_words=400).collect()}
    assert found == brute_repeats(rows, window)


def test_fm_index_refuses_longer_patterns():
    with pytest.raises(ValueError, match="sorts 16 symbols"):
        FMIndex(np.zeros(50, np.int32), 1).matching(np.zeros(50, np.int32), np.zeros(1, np.int64), 17)


def test_repeats_in_rows_of_one_document_and_empty_table(documents):
    text = " ".join(f"r{k}" for k in range(20))
    got = S.remove_repeats(documents([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 20)]
    assert S.remove_repeats(documents([])).collect() == []


def test_shards_keep_no_places(documents):
    """However many documents hold a stretch, its shard has one row of numbers for it; all places come back."""
    shard = S.Shard()
    passage = " ".join(f"h{k}" for k in range(13)).encode()
    for d in range(3000, 0, -1):
        shard.add(passage, b"digest", d, d)
    digests, first, runs = shard.repeats(13)
    assert (digests, list(first), runs) == ([b"digest"], [1], [b""])
    assert all(len(x) == 1 for x in (shard.contents, shard.digests, shard.least, shard.most))
    rows = [(d, f"a{d} {passage.decode()} b{d}") for d in range(300)]
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(documents(rows)).collect()}
    assert got == {d: 13 if d else 0 for d in range(300)}


def test_stretches_are_cut_in_bulk():
    """Words of one batch are hashed at once by their letters; stretches tile each document's windows and share their minimizer."""
    rng = random.Random(4)
    texts = [" \t".join(rng.choices(["ab", "ba", "a", "ñandú", "x" * 70_000], weights=[9, 9, 9, 9, 1], k=n)) + "\n" for n in (0, 3, 13, 40, 12, 25)]
    own = S.Stretches(texts, 13, 5)
    words = [w for t in texts for w in t.encode().split()]
    assert [own.flat[a:b - 1] for a, b in zip(own.at, own.at[1:])] == words
    assert len(set(zip(words, own.hashes.tolist()))) == len(set(words)) == len(set(own.hashes.tolist()))
    many = " ".join(f"{k}x{k * 7}" for k in range(50_000))
    assert len(set(S.Stretches([many], 13, 5).hashes.tolist())) == 50_000
    runs = S.rolling(own.hashes, 5)
    windows = []
    for first, count, least, owner in zip(own.first, own.count, own.least, own.owner):
        for k in range(first, first + count):
            assert runs[k:k + 9].min() == least
            windows.append((owner, k - own.begins[owner]))
    assert windows == [(d, k) for d, t in enumerate(texts) for k in range(len(t.split()) - 12)]
    assert len(S.Stretches(["", "a b"], 13, 5).first) == 0
