"""Toxicity from a weighted grammar of small finite-state transducers.

A text is cut into clauses. Each word becomes a symbol (insult, threat, target, negation, report,
other) with a weight; three transducers run over the symbols of a clause - is a target near, is it
negated, is it reported speech - and their product scales the weight of every insult or threat that
the clause matches. A fourth finds the threats: a threat word and a target, in either order. A
document's strength is the sum over its clauses. The insults and their weights, the weight of a
threat and the curve from strength to probability are learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import arrow_rows, batches, crc_bucket, id_text, lower_ascii, table, words_of, written

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = range(7)
#: Words of the grammar that aren't learned, in the four languages.
THREATS = "kill hurt destroy beat burn hang shoot stab töten umbringen schlagen matar golpear quemar tuer frapper brûler".split()
TARGETS = "you your yours you're u they them he she him her du dich dir ihr euch sie tú te usted ustedes vosotros tu toi vous ils elles".split()
NEGATIONS = "not no never don't isn't aren't wasn't nicht kein keine nie niemals nunca jamás ningún pas jamais aucun".split()
REPORTS = "said says say told called calls wrote claimed sagte sagt nannte schrieb dijo dice llamó escribió dit disait appelé écrit".split()
FIXED = {w: s for words, s in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
CLAUSE = re.compile(r"[.!?;:\n]+(?=\s|$)|\n")
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
PREFIX = 5


@dataclass(frozen=True)
class Transducer:
    """States 0..n-1; on a symbol, ``step`` gives the next state, and ``scale[state]`` multiplies the weight."""

    step: tuple[tuple[int, ...], ...]
    scale: tuple[float, ...]

    def __mul__(self, other: Transducer) -> Transducer:
        """The product machine: both run side by side and their scales multiply."""
        n = len(other.scale)
        return Transducer(
            tuple(tuple(a * n + b for a, b in zip(x, y)) for x in self.step for y in other.step),
            tuple(a * b for a in self.scale for b in other.scale))


def lasting(opens: set[int], words: int, scale: float) -> Transducer:
    """After one of ``opens``, the scale holds for so many words (0: to the clause's end)."""
    if not words:
        return Transducer(tuple(tuple(1 if s in opens or state else 0 for s in range(7)) for state in range(2)), (1.0, scale))
    return Transducer(tuple(tuple(words if s in opens else max(0, state - 1) for s in range(7)) for state in range(words + 1)),
                      (1.0, *[scale] * words))


#: target within six words: stronger; negated within three words or in reported speech: weaker.
GRAMMAR = lasting({TARGET}, 6, 1.3) * lasting({NEGATION}, 3, 0.5) * lasting({REPORT, QUOTE}, 0, 0.7)

#: 0 nothing yet, 1 a target, 2 a threat word without a target, 3 both have just met; then the target stays for more threats.
THREATENING = Transducer(tuple(tuple(
    (3 if state in (1, 3) else 2) if s == THREAT else (3 if state == 2 else 1) if s == TARGET else 1 if state == 3 else state
    for s in range(7)) for state in range(4)), (0.0, 0.0, 0.0, 1.0))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]   # learned words, and "~" with a learned word beginning
    slope: float
    bias: float
    threat: float = 1.0         # of a threat word that meets a target

    def symbol(self, word: str) -> tuple[int, float]:
        weight = self.weights.get(word)
        if weight is None:
            weight = self.weights.get(f"~{word[:PREFIX]}") if len(word) >= PREFIX else None
        if weight is not None:
            return INSULT, weight
        return FIXED.get(word, OTHER), 1.0

    def strength(self, text: str, memory: dict[str, tuple[int, float]]) -> tuple[float, int]:
        """The summed weight of the matched clauses, and how many there are."""
        insults, threats, matched = self.matches(text, memory)
        return insults + self.threat * threats, matched

    def matches(self, text: str, memory: dict[str, tuple[int, float]]) -> tuple[float, float, int]:
        """The summed weight of the insults, the summed scale of the threats, and how many clauses have either."""
        insults, threats, matched = 0.0, 0.0, 0
        for clause in CLAUSE.split(text):
            raw = words_of(clause)
            symbols = []
            for w in raw:
                got = memory.get(w)
                if got is None:
                    if len(memory) > 200_000:
                        memory.clear()
                    got = memory[w] = self.symbol(lower_ascii(EDGE.sub("", w)))
                symbols.append(got)
            if all(s > THREAT for s, _ in symbols):
                continue
            state, aim, own, threatened = 0, 0, 0.0, 0.0
            for w, (symbol, weight) in zip(raw, symbols):
                state = GRAMMAR.step[state][QUOTE if symbol == OTHER and w[0] in "\"“«" else symbol]
                aim = THREATENING.step[aim][symbol]
                if symbol == INSULT:
                    own += weight * GRAMMAR.scale[state]
                threatened += THREATENING.scale[aim] * GRAMMAR.scale[state]
            if own or threatened:
                insults, threats, matched = insults + own, threats + threatened, matched + 1
        return insults, threats, matched

    def probability(self, strength: np.ndarray) -> np.ndarray:
        """The curve runs over the logarithm: the first matched clause says more than the tenth."""
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(strength) + self.bias, -30, 30)))


def features(text: str) -> set[str]:
    found = {lower_ascii(EDGE.sub("", w)) for w in set(words_of(text))} - {""}
    return found | {f"~{w[:PREFIX]}" for w in found if len(w) > PREFIX}


def sketch_key(text: str) -> int:
    """The least hash of the 3-word runs: near copies mostly share it, so they count once."""
    import xxhash

    words = words_of(text)
    return min((xxhash.xxh64_intdigest(" ".join(words[k:k + 3])) for k in range(max(1, len(words) - 2))), default=0) >> 1


def learn(docs: DataFrame, labels: DataFrame, labelled: int = 30_000, least_docs: int = 4, least_weight: float = 2.5,
          threat_share: float = 0.6, threat_rows: float = 2.0) -> Model:
    """Fit on at most ``labelled`` rows of ``labels`` (doc_id, toxic), the first by hash of the id.

    Those ids are a table of bounded size, so documents are filtered without being shuffled, and every word of
    theirs that says enough is learned. Rows with a
    null label or id don't count. Copies and near copies count once. Without both classes, nothing is toxic.
    A threat weighs what gives it, by the curve, the share of toxic ones among the labelled rows that
    only threaten; ``threat_rows`` rows with a share of ``threat_share`` are added to them, so a threat
    that the labels never have is judged by that.
    """
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    own = id_text(docs).join(F.broadcast(chosen), "doc_id")

    def keys(rows):
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("key", pa.int64())])
        for piece in batches(rows, ["doc_id", "text", "toxic"]):
            yield arrow_rows(schema, [piece["doc_id"], piece["toxic"], [sketch_key(t) for t in piece["text"]]])

    distinct = own.mapInArrow(keys, "doc_id long, toxic int, key long").groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"))
    sample = written(own.join(F.broadcast(distinct.select("doc_id")), "doc_id"), "labelled")

    def count(rows):
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for piece in batches(rows, ["text", "toxic"]):
            for text, toxic in zip(piece["text"], piece["toxic"]):
                sums[int(toxic == 1)].update(features(text))
        schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
        toxic, clean = sums[1], sums[0]
        yield arrow_rows(schema, [list(toxic), list(toxic.values()), [0] * len(toxic)])
        yield arrow_rows(schema, [list(clean), [0] * len(clean), list(clean.values())])

    n_toxic, n_clean = sample.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)),
                                  F.coalesce(F.sum((F.col("toxic") != 1).cast("long")), F.lit(0))).first()
    if not n_toxic or not n_clean:
        return Model({}, 1.0, -3.0)
    odds = F.log((F.col("t") + 0.25) / (n_toxic + 0.5)) - F.log((F.col("c") + 0.25) / (n_clean + 0.5))
    counted = sample.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    top = counted.filter(F.col("t") >= least_docs).withColumn("weight", odds).filter(F.col("weight") >= least_weight)
    rows = top.collect()  # words that ``least_docs`` of the labelled rows share: bounded as those are
    draft = Model({r["word"]: float(r["weight"]) for r in rows}, 1.0, -3.0)

    def strengths(batches_):
        memory: dict = {}
        schema = pa.schema([("insults", pa.float64()), ("threats", pa.float64()), ("toxic", pa.int32())])
        for piece in batches(batches_, ["text", "toxic"]):
            got = [draft.matches(t, memory) for t in piece["text"]]
            yield arrow_rows(schema, [[i for i, _, _ in got], [t for _, t, _ in got], piece["toxic"]])

    fit = sample.mapInArrow(strengths, "insults double, threats double, toxic int").toPandas()  # at most ``labelled`` rows
    toxic, threatens = (fit["toxic"] == 1).to_numpy(float), ((fit["insults"] == 0) & (fit["threats"] > 0)).to_numpy()
    slope, bias = fitted_curve(np.log1p(fit["insults"].to_numpy()[~threatens]), toxic[~threatens])
    if not draft.weights:
        slope = 1.0  # no row has insults, and any slope fits them
    share = (toxic[threatens].sum() + threat_rows * threat_share) / (threatens.sum() + threat_rows)
    wanted = np.expm1(np.clip((np.log(share / (1 - share)) - bias) / slope, 0, 50))
    return Model(draft.weights, slope, bias, float(wanted) / GRAMMAR.scale[GRAMMAR.step[0][TARGET]])


def fitted_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a small ridge; the slope stays positive."""
    scale = max(float(x.max(initial=0)), 1.0)
    z, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * len(x) * np.array([w[0] / 50, 0])
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge * len(x) / 50, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]) / scale, 1e-6), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, strength, n_clauses), one row for each input row; null and empty texts match nothing."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("strength", pa.float64()), ("n_clauses", pa.int64())])

    def run(rows):
        memory: dict = {}
        for piece in batches(rows, ["doc_id", "text"]):
            got = [model.strength(t, memory) for t in piece["text"]]
            strength = np.array([s for s, _ in got], float)
            yield arrow_rows(schema, [piece["doc_id"], model.probability(strength), strength, [n for _, n in got]])

    return id_text(docs).mapInArrow(run, "doc_id long, score double, strength double, n_clauses long")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    def run(rows):
        memory: dict = {}
        for batch in rows:
            strength = np.array([model.strength(t or "", memory)[0] for t in batch.column(text_col).to_pylist()], float)
            yield batch.filter(pa.array(model.probability(strength) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").filter(crc_bucket("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
