"""Conversation structure repair: the cheapest edits that make turns alternate, and of those the least audit.

Each row is kept (K), given the role user or assistant (R), or deleted (D), and turns without text may be
inserted (I), until the roles' initials read ``(s?(ua)+)?``. Four states say which initial may come next,
so the nodes of a conversation are (row, state), and every letter of an audit leads from a node to one
other node at most. Least costs to the end come from a programme run from the last row to the first; an
arc is optimal when its cost and its target's make up the node's. Nodes are then ranked by their audits'
first 1, 2, 4, ... letters: rank 1 picks a node's least letter and with it the node's pointer; the rank
over twice a length is the rank of the pair (rank of the node, rank of the node that many letters on), and
pointers double along. Paths are read by unfolding the doubled pointers, once for all nodes of equal rank.

No conversation has to fit in a task. Rows without their texts are sorted over range partitions and cut
into chunks of a fixed number of rows. A chunk is a 4 x 4 table of costs between the states before and
behind it; tables, and later the chunks' state-to-state paths, are combined by the same doubling, as joins
of chunk k with chunk k + 1, k + 2, k + 4, ..., and every chunk then settles its own rows. Texts are
shuffled once, beside the decisions on them. Only a digest over all turns of one conversation (which SHA-256
reads in order) goes through one task, as a stream.

Null ids, turns, roles and texts: a null id is one conversation of its own; turns that are null come
first; a null role or text counts as one space, so such a row is blank or has no initial to keep. Rows of
the same turn are ordered by role and then by a 128-bit hash of the text; equal rows are interchangeable.
Empty texts are blank. A conversation without rows has nothing to repair: zeros and an empty audit. An
empty table gives no rows. Columns beside the four named never reach the operator.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import BLANKS, arrow_rows, table, written

#: Costs of the edits, and what a truncated row costs unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 50
#: States: nothing yet; behind a system turn; behind a user turn; behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: State behind a user or assistant turn that is inserted or given its role, by the state before it.
NEXT = (USER, USER, ASSISTANT, USER)
#: State behind a kept row, by the state before it and the row's initial.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (0, NEVER, NEVER, 0)
LETTERS = "DIKR"
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
OTHER = "?"
LINE = ["conv_id", "turn", "role", "h1", "h2"]


def numbered(rows: DataFrame) -> DataFrame:
    """The operator's columns, nulls of role and text as one space."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``numbered`` rows with the damage that crc32 of ``conv_id:turn`` modulo 20 deals; ``copies`` is 2 for a repeated row."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    deal = F.crc32(key.cast("binary")) % 20
    return numbered(rows).withColumn("deal", deal).filter("deal <> 0").select(
        "conv_id", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("deal") == 3, 2).otherwise(1).alias("copies"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))


def faulty_lines(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, n, fault, truncated), one for all equal rows of a turn; ``fault`` is that of the first of them.

    First occurrences are a minimum by text, joined back by turn and text, so that no key gathers the
    rows of a much repeated text.
    """
    seen = F.btrim("text", F.lit(BLANKS))
    lines = _hashed(rows.withColumn("fault", F.when(seen == "", 1).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)))
    lines = lines.groupBy(*LINE).agg(F.sum("copies").alias("n"), F.max("fault").alias("own"))

    def plain(df: DataFrame) -> DataFrame:  # nulls as values, so that joins deal rows by all keys
        return df.select("*", F.col("conv_id").isNull().alias("c0"), F.coalesce("conv_id", F.lit(0).cast(df.schema["conv_id"].dataType)).alias("c1"),
                         F.col("turn").isNull().alias("t0"), F.coalesce("turn", F.lit(0)).alias("t1"))

    first = lines.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("at")).select("conv_id", "at.turn", "role", "h1", "h2")
    keys = ["c0", "c1", "t0", "t1", "role", "h1", "h2"]
    told = plain(lines).join(plain(first).select(*keys, F.lit(True).alias("first")), keys, "left")
    return told.select(*LINE, "n", F.when(F.col("own") == 1, 1).when(F.col("first").isNull(), 2).otherwise(F.col("own")).alias("fault"))


# -- one chunk -------------------------------------------------------------------------------------------------------


def _step(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, int]]:
    """(letter, cost, state behind) of the edits of one row."""
    yield 0, DELETE, state
    if fault not in (1, 2):
        extra = TRUNCATED if fault == 3 else 0
        if initial in KEEP[state]:
            yield 2, extra, KEEP[state][initial]
        yield 3, REROLE + extra, NEXT[state]


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs of the states in front of a row, where turns may be inserted: two at most pay."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


#: The edits of a row by state, initial and fault, and the cost table of one row of each kind.
KINDS = {(i, f): 4 * k + f for k, i in enumerate("sua" + OTHER) for f in range(4)}
STEPS = [[list(_step(s, i, f)) for s in range(STATES)] for i, f in KINDS]


def least_costs(kinds: bytes, behind: list[int]) -> list[list[int]]:
    """Least cost to the end from each (row, state), given those of the states behind the last row."""
    layers = [behind]
    for kind in reversed(kinds):
        after = layers[-1]
        layers.append(_with_inserts([min(cost + after[t] for _, cost, t in steps) for steps in STEPS[kind]]))
    layers.reverse()
    return layers


def cost_table(kinds: bytes) -> list[int]:
    """Costs from each state before the rows to each state behind them, row by row of 4 x 4."""
    into = [least_costs(kinds, [0 if s == t else NEVER for s in range(STATES)])[0] for t in range(STATES)]
    return [min(into[t][s], NEVER) for s in range(STATES) for t in range(STATES)]


@dataclass(frozen=True)
class Rows:
    """The rows of a chunk, the costs of the states behind it, and whether the conversation ends there."""

    kinds: bytes
    behind: list[int]
    last: bool


def least_audits(chunks: list[Rows], entries: list[int]) -> list[list[tuple[str, int, int]]]:
    """(audit, state behind, cost to the end) of each chunk from each entry state; all chunks are ranked together."""
    sources, letters, targets = [], [], []
    bases: list[int] = []
    costs_of: list[list[int]] = []
    total = 0
    for chunk in chunks:
        bases.append(total)
        layers = least_costs(chunk.kinds, chunk.behind)
        costs_of.append(layers[0])
        n = len(chunk.kinds)
        for i, costs in enumerate(layers[:n + chunk.last]):
            at = total + i * STATES
            for s, cost in enumerate(costs):
                if cost >= NEVER or (i == n and cost == ENDS[s]):
                    continue
                if INSERT + costs[NEXT[s]] == cost:
                    sources.append(at + s)
                    letters.append(1)
                    targets.append(at + NEXT[s])
                if i < n:
                    after = layers[i + 1]
                    for letter, price, t in STEPS[chunk.kinds[i]][s]:
                        if price + after[t] == cost:
                            sources.append(at + s)
                            letters.append(letter)
                            targets.append(at + STATES + t)
        total += len(layers) * STATES
    # Where a path ends its node points to itself with letter 0, which is less than any edit.
    source, letter, target = np.array(sources, np.int64), np.array(letters, np.int64) + 1, np.array(targets, np.int64)
    order = np.lexsort((letter, source))
    least = order[np.flatnonzero(np.diff(source[order], prepend=-1))]
    rank, jump = np.zeros(total, np.int64), np.arange(total)
    rank[source[least]] = letter[least]
    jump[source[least]] = target[least]
    first, pointers = rank, [jump]
    while True:
        back = pointers[-1]
        rank = np.unique(rank * (total + len(LETTERS) + 1) + rank[back], return_inverse=True)[1]
        if (back[back] == back).all():
            break
        pointers.append(back[back])
    starts = (np.array(bases, np.int64)[:, None] + np.array(entries)).ravel()
    _, one, which = np.unique(rank[starts], return_index=True, return_inverse=True)
    nodes, owner = starts[one], np.arange(len(one))
    for back in reversed(pointers):
        nodes, owner = np.stack([nodes, back[nodes]], axis=1).ravel(), np.repeat(owner, 2)
        going = first[nodes] > 0
        nodes, owner = nodes[going], owner[going]
    text = np.frombuffer(LETTERS.encode(), "S1")[first[nodes] - 1].tobytes().decode()
    ends = np.cumsum(np.bincount(owner, minlength=len(one))).tolist()
    audits = [text[a:b] for a, b in zip([0, *ends], ends)]
    behind = (pointers[-1][starts] % STATES).tolist()
    found = [(audits[k], t) for k, t in zip(which.tolist(), behind)]
    width = len(entries)
    return [[(*found[c * width + k], costs_of[c][s]) for k, s in enumerate(entries)] for c in range(len(chunks))]


# -- chunks of a conversation ----------------------------------------------------------------------------------------

CHUNK = ("conv_id {conv}, place long, kinds binary, turns array<long>, roles array<string>, h1 array<long>, h2 array<long>, counts array<long>, "
         "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
         "low long, high long, turn_changes long, first_turn long, last_turn long")
LEGAL = {"su", "ua", "au"}


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else OTHER


def chunks_of(lines: DataFrame, most_rows: int) -> DataFrame:
    """Sorted lines as chunks of at most ``most_rows`` rows. A line of more copies than fit goes on in the next chunk."""
    conv = lines.schema["conv_id"].dataType.simpleString()
    ordered = lines.repartitionByRange(*(F.col(c).asc_nulls_first() for c in LINE)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in LINE))
    schema = CHUNK.format(conv=conv)
    arrow = _arrow(lines, "conv_id", [("place", pa.int64()), ("kinds", pa.binary()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                                      ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                                      *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")),
                                      ("first_initial", pa.string()), ("last_initial", pa.string()),
                                      *((c, pa.int64()) for c in ("low", "high", "turn_changes", "first_turn", "last_turn"))])

    def closed(conv_id, place, kinds, parts):
        turns, roles, h1, h2, counts = (list(c) for c in zip(*parts))
        initials = [_initial(r) for r, n in zip(roles, counts) for _ in range(n)]
        faults = [k & 3 for k in kinds]
        known = [t for t in turns if t is not None]
        return (conv_id, place, bytes(kinds), turns, roles, h1, h2, counts, faults.count(1), faults.count(2), faults.count(3),
                sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), initials[0], initials[-1],
                min(known, default=None), max(known, default=None), sum(a != b for a, b in zip(turns, turns[1:]) if a is not None),
                turns[0], turns[-1])

    def cut(rows):
        # Range partitions follow one another, so places of later partitions are higher, and a task's own rise by one.
        place = TaskContext.get().partitionId() << 40
        conv_id, kinds, parts, out = None, bytearray(), [], []
        for batch in rows:
            for conv, turn, role, h1, h2, n, fault in zip(*(batch.column(c).to_pylist() for c in (*LINE, "n", "fault"))):
                if parts and conv != conv_id:
                    out.append(closed(conv_id, place, kinds, parts))
                    place, kinds, parts = place + 1, bytearray(), []
                conv_id, initial = conv, _initial(role)
                while n:
                    if len(kinds) == most_rows:
                        out.append(closed(conv_id, place, kinds, parts))
                        place, kinds, parts = place + 1, bytearray(), []
                    own = min(n, most_rows - len(kinds))
                    kinds += bytes([KINDS[initial, fault]]) + bytes([KINDS[initial, fault if fault == 1 else 2]]) * (own - 1)
                    parts.append((turn, role, h1, h2, own))
                    n -= own
                    fault = fault if fault == 1 else 2  # copies of a blank row are blank, those of any other are duplicates
            if len(out) > 500:
                yield arrow_rows(arrow, list(zip(*out)))
                out = []
        if parts:
            out.append(closed(conv_id, place, kinds, parts))
        if out:
            yield arrow_rows(arrow, list(zip(*out)))

    return ordered.select(*LINE, "n", "fault").mapInArrow(cut, schema)


def _arrow(df: DataFrame, name: str, more: list) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(name, to_arrow_type(df.schema[name].dataType)), *more])


def _numbered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with ``place`` counting 0, 1, 2, ... over the whole table: one count a task goes round."""
    part = F.shiftright("place", 40)
    sizes = sorted((r.part, r.n) for r in chunks.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = chunks.sparkSession.createDataFrame(starts or [(0, 0)], "part long, offset long")
    return chunks.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("place", F.col("offset") + F.col("place").bitwiseAND((1 << 40) - 1)).drop("part", "offset")


def _product(a: Column, b: Column) -> Column:
    """Least costs through table ``a`` and then table ``b``."""
    return F.array(*(F.least(F.lit(NEVER).cast("long"), *(a[s * STATES + m] + b[m * STATES + t] for m in range(STATES)))
                     for s in range(STATES) for t in range(STATES)))


def _doubled(chain: DataFrame, value: str, combine, step: int) -> DataFrame:
    """``value`` of each chunk combined with those of all later (step 1) or earlier (step -1) chunks of its conversation."""
    reach = 1
    while True:
        far = chain.select((F.col("place") - step * reach).alias("place"), F.col("group").alias("far group"), F.col(value).alias("far"))
        joined = chain.join(far, "place", "left")
        meets = F.coalesce(F.col("far group") == F.col("group"), F.lit(False))
        joined = joined.withColumn("met", meets).withColumn(value, F.when(meets, combine(F.col(value), F.col("far"))).otherwise(F.col(value)))
        joined = written(joined.drop("far", "far group"), "chain")
        chain = joined.drop("met")
        if not joined.filter("met").limit(1).count():
            return chain
        reach *= 2


def decisions(chunks: DataFrame) -> DataFrame:
    """(conv_id, place, audit, entry, cost) of each chunk: its part of the least audit, the state it begins in, and,
    on the first chunk of a conversation, the cost of all."""
    conv = chunks.schema["conv_id"].dataType.simpleString()
    counts = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("place").alias("group"))
    long = counts.filter("chunks > 1").select(F.col("conv_id").alias("long id"), "group", "chunks")
    chained = chunks.select("conv_id", "place", "kinds").join(long, F.col("conv_id").eqNullSafe(F.col("long id")), "left").drop("long id")
    arrow = _arrow(chunks, "conv_id", [("place", pa.int64()), ("audit", pa.string()), ("entry", pa.int32()), ("cost", pa.int64())])
    ends = _with_inserts(list(ENDS))

    def settle(rows):
        for batch in rows:
            kinds = batch.column("kinds").to_pylist()
            for cut in _cuts(kinds):
                part = batch.slice(cut.start, cut.stop - cut.start)
                audits, _, costs = zip(*(one for (one,) in least_audits([Rows(k, ends, True) for k in kinds[cut]], [START])))
                yield arrow_rows(arrow, [part.column("conv_id"), part.column("place"), audits, [START] * len(audits), costs])

    alone = chained.filter("group is null").select("conv_id", "place", "kinds").mapInArrow(settle, f"conv_id {conv}, place long, audit string, entry int, cost long")
    return alone.union(_chained(written(chained.filter("group is not null"), "chain"), ends)) if long.limit(1).count() else alone


def _chained(chain: DataFrame, ends: list[int]) -> DataFrame:
    """``decisions`` for the chunks of conversations with several of them."""
    conv = chain.schema["conv_id"].dataType.simpleString()
    tables_arrow = pa.schema([("place", pa.int64()), ("group", pa.int64()), ("costs", pa.list_(pa.int64()))])

    def tables(rows):
        for batch in rows:
            yield arrow_rows(tables_arrow, [batch.column("place"), batch.column("group"), [cost_table(k) for k in batch.column("kinds").to_pylist()]])

    # Costs from a chunk to the end: its table times those of all later chunks, times the costs of ending there.
    ahead = _doubled(chain.select("place", "group", "kinds").mapInArrow(tables, "place long, group long, costs array<long>"), "costs", _product, 1)
    to_end = F.array(*(F.least(*(F.col("costs")[s * STATES + t] + F.lit(ends[t]) for t in range(STATES))) for s in range(STATES)))
    behind = ahead.select((F.col("place") - 1).alias("place"), to_end.alias("behind"))
    here = chain.withColumn("last", F.col("place") == F.col("group") + F.col("chunks") - 1).join(behind, "place", "left")
    arrow = _arrow(chain, "conv_id", [("place", pa.int64()), ("group", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("cost", pa.int64())])

    def four_ways(rows):
        for batch in rows:
            kinds, after, lasts = (batch.column(c).to_pylist() for c in ("kinds", "behind", "last"))
            for cut in _cuts(kinds):
                part = batch.slice(cut.start, cut.stop - cut.start)
                paths = least_audits([Rows(k, ends if last else b, last) for k, b, last in zip(kinds[cut], after[cut], lasts[cut])], list(range(STATES)))
                yield arrow_rows(arrow, [*(part.column(c) for c in ("conv_id", "place", "group")), [[a for a, _, _ in p] for p in paths],
                                         [[t for _, t, _ in p] for p in paths], [p[START][2] for p in paths]])

    paths = written(here.select("conv_id", "place", "group", "kinds", "last", "behind").mapInArrow(
        four_ways, f"conv_id {conv}, place long, group long, audits array<string>, exits array<int>, cost long"), "paths")
    # State in front of a chunk: the paths of all earlier chunks, one after another, from the start.
    reached = _doubled(paths.select("place", "group", "exits"), "exits", lambda late, early: F.transform(early, lambda s: F.get(late, s)), -1)
    entries = reached.select((F.col("place") + 1).alias("place"), F.col("group").alias("from group"), F.col("exits")[START].alias("from"))
    entry = F.when(F.col("from group") == F.col("group"), F.col("from")).otherwise(START)
    return paths.join(entries, "place", "left").select(
        "conv_id", "place", F.get("audits", entry).alias("audit"), entry.alias("entry"), F.when(F.col("place") == F.col("group"), F.col("cost")).otherwise(0).alias("cost"))


def _cuts(kinds: list[bytes], most_rows: int = 20_000) -> Iterator[slice]:
    """Runs of chunks with about ``most_rows`` rows, which are ranked together."""
    begin = size = 0
    for k, one in enumerate(kinds):
        size += len(one)
        if size >= most_rows:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(kinds):
        yield slice(begin, len(kinds))


@dataclass(frozen=True)
class Repair:
    """What ``repair_conversations`` gives."""

    report: DataFrame  # (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation with rows
    turns: DataFrame   # (conv_id, place, role, text, edit), the repaired rows, each task's in order and tasks in order


def repair_conversations(rows: DataFrame, most_rows: int = 4096) -> Repair:
    """Repairs rows of (conv_id, turn, role, text[, copies]); ``most_rows`` bounds what one chunk holds, never the result."""
    rows = rows if "copies" in rows.columns else numbered(rows).withColumn("copies", F.lit(1))
    chunks = _numbered_chunks(written(chunks_of(written(faulty_lines(rows), "lines"), most_rows), "chunks"))
    settled = written(decisions(chunks), "settled")
    # Neighbouring chunks of one conversation meet by place: the pair of turns between them belongs to neither.
    before = chunks.select((F.col("place") + 1).alias("place"), F.col("conv_id").alias("left id"), F.col("last_initial").alias("left initial"), F.col("last_turn").alias("left turn"))
    met = chunks.join(before, "place", "left").withColumn("on", F.col("left initial").isNotNull() & F.col("left id").eqNullSafe(F.col("conv_id")))
    pair = F.concat("left initial", "first_initial")
    changes = F.col("turn_changes") + F.when(F.col("on") & (F.col("left turn") != F.col("first_turn")), 1).otherwise(0)
    stats = met.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.when(F.col("on") & ~pair.isin(*LEGAL), 1).otherwise(0)).alias("illegal"),
        (F.max("high") - F.min("low") + 1 - (F.sum(changes) + 1)).alias("gaps"))
    audits = settled.groupBy(F.col("conv_id").alias("own id")).agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    report = stats.join(audits, F.col("conv_id").eqNullSafe(F.col("own id"))).select(
        "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(report, _repaired(rows, chunks.join(settled.select("place", "audit", "entry"), "place")))


def _repaired(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows that stay, with their new roles, and the inserted ones, in order."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    told = _arrow(rows, "conv_id", [("turn", pa.int64()), ("role", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("place", pa.int64()), ("entry", pa.int32()), ("edits", pa.string())])

    def by_line(batches):
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                audit, state, at, row = c["audit"], c["entry"], 0, 0
                lines = list(zip(c["turns"], c["roles"], c["h1"], c["h2"], c["counts"]))
                for k, (turn, role, h1, h2, n) in enumerate(lines, 1):
                    begin, entry = at, state
                    while n or (k == len(lines) and at < len(audit)):
                        if audit[at] == "I":
                            state = NEXT[state]
                        else:
                            state = next(t for letter, _, t in STEPS[c["kinds"][row]][state] if LETTERS[letter] == audit[at])
                            n, row = n - 1, row + 1
                        at += 1
                    out.append((c["conv_id"], turn, role, h1, h2, c["place"], entry, audit[begin:at]))
            if out:
                yield arrow_rows(told, list(zip(*out)))

    lines = chunks.select("conv_id", "place", "kinds", "turns", "roles", "h1", "h2", "counts", "audit", "entry").mapInArrow(
        by_line, f"conv_id {conv}, turn long, role string, h1 long, h2 long, place long, entry int, edits string")
    texts = _hashed(rows).select(*LINE, F.lit(None).cast("long").alias("place"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("edits"), "copies", "text")
    both = lines.select(*LINE, "place", "entry", "edits", F.lit(None).cast("int").alias("copies"), F.lit(None).cast("string").alias("text")).union(texts)
    keys = [F.col(c).asc_nulls_first() for c in LINE]
    # Decisions on a line stand in front of its texts; equal keys never part in a range partitioning.
    both = both.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("edits").isNull(), F.col("place"))
    out_arrow = _arrow(rows, "conv_id", [("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def apply(batches):
        place = TaskContext.get().partitionId() << 40
        runs: deque[list] = deque()  # edits of the line at hand, as [letter, how often]
        state = START
        for batch in batches:
            out = []
            for conv_id, role, entry, edits, copies, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "entry", "edits", "copies", "text"))):
                if edits is not None:
                    state = state if runs else entry
                    for letter, own in groupby(edits):
                        if runs and runs[-1][0] == letter:
                            runs[-1][1] += len(list(own))
                        else:
                            runs.append([letter, len(list(own))])
                    continue
                # Insertions come before the row they stand in front of; those left at last end the conversation.
                while runs and (copies or (len(runs) == 1 and runs[0][0] == "I")):
                    letter, n = runs[0]
                    n = n if letter == "I" else min(n, copies)
                    runs[0][1] -= n
                    if not runs[0][1]:
                        runs.popleft()
                    if letter != "I":
                        copies -= n
                    for _ in range(0 if letter == "D" else n):
                        state = KEEP[state][_initial(role)] if letter == "K" else NEXT[state]
                        out.append((conv_id, place, role if letter == "K" else ROLE_OF[state], "" if letter == "I" else text, letter))
                        place += 1
            if out:
                yield arrow_rows(out_arrow, list(zip(*out)))

    return both.mapInArrow(apply, f"conv_id {conv}, place long, role string, text string, edit string")


def turn_digests(turns: DataFrame, most_bytes: int = 8_000_000) -> DataFrame:
    """(conv_id, digest) of each conversation with turns: SHA-256 of its ``role:text`` turns, joined by line feeds.

    ``turns`` come in order, as ``repair_conversations`` gives them. A task digests what it holds whole; a
    conversation at its edge, or of more than ``most_bytes``, goes on as pieces that one task reads in order.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    arrow = _arrow(turns, "conv_id", [("place", pa.int64()), ("digest", pa.string()), ("piece", pa.binary())])

    def digests(batches):
        conv_id, place, held, size, open_ = None, None, [], 0, True  # open_: part of it lies in another task or is out already

        def piece():
            return (conv_id, place, None, b"\n".join(held))

        for batch in batches:
            out = []
            for conv, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if held and conv != conv_id:
                    out.append(piece() if open_ else (conv_id, None, hashlib.sha256(b"\n".join(held)).hexdigest(), None))
                    held, size, open_ = [], 0, False
                elif size > most_bytes:
                    out.append(piece())
                    held, size, open_ = [], 0, True
                if not held:
                    conv_id, place = conv, at
                held.append(f"{role}:{text}".encode())
                size += len(held[-1])
            if out:
                yield arrow_rows(arrow, list(zip(*out)))
        if held:
            yield arrow_rows(arrow, list(zip(piece())))

    def joined(batches):
        conv_id, digest = None, None
        for batch in batches:
            out = []
            for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist()):
                if digest is not None and conv == conv_id:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        out.append((conv_id, digest.hexdigest()))
                    conv_id, digest = conv, hashlib.sha256()
                digest.update(piece)
            if out:
                yield arrow_rows(ends, list(zip(*out)))
        if digest is not None:
            yield arrow_rows(ends, [[conv_id], [digest.hexdigest()]])

    ends = _arrow(turns, "conv_id", [("digest", pa.string())])
    found = written(turns.mapInArrow(digests, f"conv_id {conv}, place long, digest string, piece binary"), "digests")
    pieces = found.filter("digest is null").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return found.filter("digest is not null").select("conv_id", "digest").union(
        pieces.select("conv_id", "piece").mapInArrow(joined, f"conv_id {conv}, digest string"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = repair_conversations(damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = done.report.select("conv_id", *counts, "audit", F.lit(None).cast("string").alias("digest"))
    empty = [F.lit(None).cast("long").alias(c) for c in counts] + [F.lit(None).cast("string").alias("audit")]
    hashed = turn_digests(done.turns).select("conv_id", *empty, "digest")
    every = rows.select("conv_id").distinct().select("conv_id", *empty, F.lit(None).cast("string").alias("digest"))
    return report.union(hashed).union(every).groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("digest"), F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _twin() -> str:
    """The repair as a walk over each conversation's rows that keeps, for each state, the least (cost, audit, turns)."""
    def moved(state: str, cost: str, letter: str, turn: str = "") -> str:
        turns = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {turns}}}"

    never = f"{{'c': {NEVER}::BIGINT, 'a': '', 't': []::VARCHAR[]}}"
    open_ = "fault NOT IN (1, 2)"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN {open_} AND initial = '{initial}' THEN {moved(state, 'extra', 'K', chr(39) * 2 + ' || role || chr(58) || body')} ELSE {never} END"

    def given(state: str, role: str) -> str:
        return f"CASE WHEN {open_} THEN {moved(state, '1 + extra', 'R', f'{chr(39)}{role}:{chr(39)} || body')} ELSE {never} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    # Inserted turns come before a row: a user turn behind anything but one, an assistant turn behind that.
    inserted = f"""LATERAL (SELECT {least('u', *(moved(s, str(INSERT), 'I', "'user:'") for s in 'zya'))} AS u1) i1,
      LATERAL (SELECT {least('a', moved('u1', str(INSERT), 'I', "'assistant:'"))} AS a1) i2"""
    return rf"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
dealt AS (SELECT conv_id, turn, role, body, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda x, y: xor(tab[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 20 AS deal FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
  CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body, n
  FROM dealt JOIN (VALUES (1), (2)) c(n) ON n = 1 OR deal = 3 WHERE deal <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, n) AS k, left(role, 1) AS initial,
  regexp_replace(body, '[\x20\x09-\x0D]', '', 'g') AS seen FROM damaged),
lines AS (SELECT *, CASE WHEN seen = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, body ORDER BY k) > 1 THEN 2
  WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
  count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
  count(*) AS n FROM lines GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS z, {never} AS y, {never} AS u, {never} AS a FROM stats
  UNION ALL
  SELECT conv_id, k, {moved('z', '2', 'D')}, {least(moved('y', '2', 'D'), kept('z', 's'))},
    {least(moved('u1', '2', 'D'), *(f(s, v) for s in ('z', 'y', 'a1') for f, v in ((kept, 'u'), (given, 'user'))))},
    {least(moved('a1', '2', 'D'), kept('u1', 'a'), given('u1', 'assistant'))}
  FROM (SELECT w.conv_id, l.k, w.z, w.y, w.u, w.a, l.role, l.body, l.initial, l.fault, CASE WHEN l.fault = 3 THEN 5 ELSE 0 END AS extra
    FROM walk w JOIN lines l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.k = w.k + 1) step, {inserted}),
ended AS (SELECT w.conv_id, {least('z', 'a1')} AS best FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.k, {inserted})
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


SQL = {"op11_conversation_repair": _twin()}
