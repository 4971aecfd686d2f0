"""The five stages as composed, each against brute force, and the toxicity scorer against one written another way."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lines_and_rules import brute_lines
from test_models_and_tokens import labelled
from test_near_and_exact import brute_classes, brute_leaks
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from fieldtally.llm import toxicity as X
from fieldtally.llm.tokens import default_tokenizer


def corpus():
    """Toxic rows, shared lines, exact and near copies, benchmark passages, nulls, empties, repeated rows and a long text."""
    rng = random.Random(7)
    vocabulary = [f"c{k}" for k in range(400)]
    toxic, labels = labelled(n=120)
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(4)]
    shared = "This very line stands in many documents."
    rows = list(toxic)
    for d in range(1000, 1060):
        own = rng.choices(vocabulary, k=rng.randint(20, 80))
        if d % 6 == 0:
            own[5:5] = items[d % 4][1].split()
        rows.append((d, " ".join(own) + (f"\n{shared}" if d % 3 == 0 else "")))
    for d in range(1060, 1080):
        own = rows[rng.randrange(120, 180)][1].split(" ")
        if d % 2:
            own[-1] = "edited"
        rows.append((d, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, f"{shared}\n{shared}"), (2004, "x" * 400_000), (2005, "You gronk, you blarg."), (2005, "You gronk, you blarg."),
             (2006, "same row"), (2006, "same row"), (None, "You gronk, you blarg."), (None, "calm words without an id"), (None, None)]
    return rows, labels, items


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows, labels, items, n_chars=True):
        full = [(d, t, "en", None, None if t is None else len(t), "x", 7, "y", 1, 2) for d, t in rows]
        docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, n int, item_id string, component_id int, "
                                           "`toxic` int").repartition(3)
        (docs if n_chars else docs.drop("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)
    return make


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_each_stage_against_brute_force(spark, folder):
    rows, labels, items = corpus()
    sf = folder(rows, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]

    model = X.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = pipeline.toxicity(spark, docs, sf)
    want = [(d, t) for d, t in rows if model.probability(np.array([brute_strength(t or "", model)]))[0] < 0.5]
    assert left.columns == columns and pairs(left) == sorted(want, key=str)
    assert {d for d, y in ((d, y) for d, _, y in labels) if y} - {d for d, _ in want} and all(d != 2005 for d, _ in want)

    lines = pipeline.line_dedup(spark, left, sf)
    cut = brute_lines(want)
    after = [(d, t if d is None or not cut[d][1] else cut[d][2]) for d, t in want]
    assert lines.columns == columns and pairs(lines) == sorted(after, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    apart = pipeline.jaccard_join(spark, lines, sf)
    named = [(d, t) for d, t in after if d is not None]
    classes = brute_classes(dict(named).items(), 5, 80)
    single = [(d, t) for d, t in after if d is None or classes[d][1] == d]
    assert len(single) < len(after) and apart.columns == columns and pairs(apart) == sorted(single, key=str)

    clean = pipeline.decontamination(spark, apart, sf)
    leaks = {d for d, _ in brute_leaks([(k, t) for k, (_, t) in enumerate(single)], items)}
    kept = [row for k, row in enumerate(single) if k not in leaks]
    assert leaks and clean.columns == columns and pairs(clean) == sorted(kept, key=str)

    tokenizer = Tokenizer.from_file(default_tokenizer())
    for pieces in (pipeline.packing(spark, clean, sf).collect(), pipeline.run(spark, sf).collect()):
        got = {}
        for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
            got.setdefault((p.doc_id, p.doc_tokens), []).append(p.ids)
        ids = sorted(i for d in got for i in np.frombuffer(b"".join(got[d]), "<u4").tolist())
        assert ids == sorted(i for _, t in kept for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
        assert {d for d, _ in got} == {d for d, _ in kept}


def test_pipeline_without_rows_and_without_n_chars(spark, folder):
    rows, labels, items = corpus()
    sf = folder([], labels[:0], items[:0])
    assert pipeline.run(spark, sf).collect() == []


def test_pipeline_without_n_chars(spark, folder):
    rows, labels, items = corpus()
    sf = folder(rows[110:150], labels, items, n_chars=False)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert pipeline.run(spark, sf).count() > 0


def brute_strength(text, model):
    """The grammar's meaning without its machines: look back from each word of a clause."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n]+(?=\s|$)|\n", text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", clause) if w]
        kinds, weights = [], []
        for w in words:
            bare = re.sub(r"^[^\w]+|[^\w]+$", "", w)
            bare = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)
            weight = model.weights.get(bare)
            if weight is None and len(bare) >= 5:
                weight = model.weights.get("~" + bare[:5])
            fixed = ("threat" if bare in X.THREATS else "target" if bare in X.TARGETS else "no" if bare in X.NEGATIONS else "said" if bare in X.REPORTS else
                     "said" if w[0] in "\"“«" else "")
            kinds.append("insult" if weight is not None else fixed)
            weights.append(weight)
        waiting = aimed = False
        for k, kind in enumerate(kinds):
            scale = (1.3 if "target" in kinds[max(0, k - 5):k + 1] else 1) * (0.5 if "no" in kinds[max(0, k - 2):k + 1] else 1) * (0.7 if "said" in kinds[:k + 1] else 1)
            if kind == "insult":
                total += weights[k] * scale
            if kind == "threat" and aimed or kind == "target" and waiting and not aimed:
                total += model.threat * scale
            waiting, aimed = waiting or kind == "threat", aimed or kind == "target"
    return total


def test_scorer_against_one_written_another_way():
    rng = random.Random(3)
    model = X.Model({"gronk": 4.0, "blarg": 2.5, "~snive": 3.0}, 1.2, -2.0, 1.7)
    words = ["gronk", "Blarg,", "snivelling", "kill", "hurt", "you", "They", "not", "never", "said", '"quote', "calm", "word", "and", "x.", "end!", "a;b", "so:", "\n", "matar", "te"]
    for _ in range(3000):
        text = " ".join(rng.choices(words, k=rng.randint(0, 25)))
        assert model.strength(text, {})[0] == pytest.approx(brute_strength(text, model)), text
