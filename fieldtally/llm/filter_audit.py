"""Filter interaction audit: what each filter removes, in every order in which the filters could run.

Every document gets a mask of the filters it fails. The masks are counted for each part of the corpus
(a Spark aggregate, at most 2 ** filters rows a part), and each part's counts become a decision
diagram: one level a filter, the low branch for passing it, the high branch for failing it, equal
sub-diagrams stored once, every node weighted with the documents below it. The node reached by k low
branches weighs what the first k filters keep, so one order is read off its all-pass path. All orders
follow by swapping two neighbouring levels at a time: the plain changes visit each permutation once
with one swap between neighbours, and a swap touches the two levels alone.

Null texts are empty. Null and empty sources are one part, the empty string. A row with a null id is
nobody's copy and has no label; rows that repeat an id with the same text aren't copies of each
other, as neither id is smaller. Labels given twice count as set if any row sets them. An empty table
has no parts and gives no rows. Columns beside those named never reach the operator.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import arrow_rows, table, written

FILTERS = "ABCDE"
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << FILTERS.index("E")


def failed(text: bytes) -> int:
    """Mask of the filters that a text fails by itself, bit k for the k-th letter."""
    words = text.split()  # of bytes: at the six ASCII blanks
    points = len(text) if text.isascii() else len(text.decode())
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2
            | (MARKS.search(text) is not None) << 3)


def own_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each row: what the text shows by itself, and a 128-bit digest of it."""
    arrow = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])

    def judge(rows):
        for batch in rows:
            texts = batch.column("text").cast(pa.binary())
            masks, digests = [], []
            for value in texts:
                text = value.as_py()
                masks.append(failed(text))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield arrow_rows(arrow, [batch.column("doc_id"), batch.column("part"), masks, digests])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
                         F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return narrow.mapInArrow(judge, "doc_id long, part string, mask int, digest binary")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of a mask, and their labels.

    The first holder of a text is a minimum by digest, joined back by id and digest: however many copies
    a text has, no task meets them all.
    """
    own = written(own_failures(docs), "failures")
    first = own.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    told = own.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    mask = F.col("mask").bitwiseOR(F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), COPY).otherwise(0))
    return told.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swap with k + 1, one after another, leads through every order of n things once."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    down = True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        place = next(inner, None)
        if place is None:
            return
        # The last thing lies before all others after a walk down, so the others stand one place further.
        yield place + down
        down = not down


class Diagram:
    """Count-weighted decision diagram of failure masks; every path has all levels, equal sub-diagrams are one node."""

    def __init__(self, counts: dict[int, tuple[int, ...]], letters: str):
        self.letters = list(letters)
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[tuple[int, ...]] = []
        none = (0,) * len(next(iter(counts.values())))
        unique: dict = {}
        row = []
        for code in range(1 << len(letters)):
            # The first level is the highest bit of the code, the first filter the lowest bit of the mask.
            mask = sum(1 << k for k in range(len(letters)) if code >> (len(letters) - 1 - k) & 1)
            row.append(self._leaf(unique, counts.get(mask, none)))
        self.levels: list[list[int]] = []
        while len(row) > 1:
            unique = {}
            row = [self._node(unique, a, b) for a, b in zip(row[::2], row[1::2])]
            self.levels.insert(0, list(unique.values()))
        self.root = row[0]

    def _add(self, low: int, high: int, weight: tuple[int, ...]) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.low) - 1

    def _leaf(self, unique: dict, weight: tuple[int, ...]) -> int:
        if weight not in unique:
            unique[weight] = self._add(-1, -1, weight)
        return unique[weight]

    def _node(self, unique: dict, low: int, high: int) -> int:
        if (low, high) not in unique:
            unique[low, high] = self._add(low, high, tuple(map(int.__add__, self.weight[low], self.weight[high])))
        return unique[low, high]

    def swap(self, level: int) -> None:
        """Exchange a level with the next one; the nodes of the upper level keep their place and weight."""
        unique: dict = {}
        low, high = self.low, self.high
        for node in self.levels[level]:
            passed, failed_ = low[node], high[node]
            low[node], high[node] = self._node(unique, low[passed], low[failed_]), self._node(unique, high[passed], high[failed_])
        self.levels[level + 1] = list(unique.values())
        self.letters[level], self.letters[level + 1] = self.letters[level + 1], self.letters[level]

    def all_pass(self) -> list[tuple[int, ...]]:
        """Weights along the path that passes every filter, from everything to what all filters keep."""
        node, path = self.root, [self.weight[self.root]]
        for _ in self.letters:
            node = self.low[node]
            path.append(self.weight[node])
        return path


def every_order(counts: dict[int, tuple[int, int, int]], letters: str = FILTERS) -> Iterator[tuple[str, list[tuple[int, ...]]]]:
    """(order, weights along its all-pass path) for all orders of the filters."""
    diagram = Diagram(counts, letters)
    yield "".join(diagram.letters), diagram.all_pass()
    for place in plain_changes(len(letters)):
        diagram.swap(place)
        yield "".join(diagram.letters), diagram.all_pass()


def audit(masks: DataFrame, letters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from
    (part, mask, n, good, toxic). ``letters`` names the bits of a mask from the lowest; a part has at most
    2 ** len(letters) rows and is one diagram, parts are dealt over all tasks."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    arrow = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in names)])

    def one(part, cells):
        counts = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in cells}
        fails = {f: sum(n for mask, (n, _, _) in counts.items() if mask >> k & 1) for k, f in enumerate(letters)}
        alone = {f: counts.get(1 << k, (0, 0, 0))[0] for k, f in enumerate(letters)}
        shapley = dict.fromkeys(letters, 0)
        rows = []
        for order, path in every_order(counts, letters):
            for step, (f, before, after) in enumerate(zip(order, path, path[1:]), 1):
                gone, good, toxic = (a - b for a, b in zip(before, after))
                shapley[f] += gone
                rows.append((part, order, step, after[0], gone, fails[f] - gone, alone[f], good, toxic, f))
        return [(*row[:-1], shapley[row[-1]]) for row in rows]

    def audits(rows):
        for batch in rows:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                yield arrow_rows(arrow, list(zip(*one(part, cells))))

    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(audits, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = {"op13_filter_audit": r"""
with doc as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as body from documents),
worded as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words from doc),
holder as (select body, min(doc_id) as first_id from doc group by body),
judged as (
  select w.doc_id, w.part, len(words) < 50 as fa, 100 * len(list_distinct(words)) < 65 * len(words) as fb,
         100 * length(regexp_replace(w.body, '[^A-Z]', '', 'g')) > 5 * length(w.body) as fc,
         regexp_matches(w.body, '[#$%&*|]') as fd, coalesce(w.doc_id > h.first_id, false) as fe
  from worded w join holder h on w.body = h.body),
mark as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
cell as (
  select part, fa::int + 2 * fb::int + 4 * fc::int + 8 * fd::int + 16 * fe::int as mask, count(*) as n,
         sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from judged j left join mark m on j.doc_id = m.doc_id group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letter a, letter b, letter c, letter d, letter e where a.bit + b.bit + c.bit + d.bit + e.bit = 31
    and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
step as (
  select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1:k - 1]), 0)::int as before
  from orders, (select unnest([1, 2, 3, 4, 5]) as k)),
counted as (
  select part, filter_order, step, bit,
         sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
         sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
         sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant,
         sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost,
         sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
  from cell, step group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from counted
"""}
