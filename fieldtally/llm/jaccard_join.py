"""Grouped prefix join: documents whose word-shingle sets are similar, and the classes they form.

Equal sets are one class member. Shingles are ordered from rare to frequent by a counting sketch of all
texts, ties by hash - any fixed order is right, this one keeps frequent passages out of the prefixes.
Members with the same prefix and size are one group, and groups meet by prefix shingles under the size
and position filters. To find classes without writing all pairs of a large group, each shingle's
members are first verified against one leader, the member that has the fewest shingles before it;
then only pairs are verified whose ends still lie in different classes. Nothing else can join classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import additive_table, arrow_rows, batches, id_text, table, written
from fieldtally.llm.components import connected
from fieldtally.llm.shingles import WordHashes, rolling

#: Cells of the frequency sketch, and of the mask of documents whose sets are needed: fixed sizes.
SKETCH_BITS, MASK_BITS = 22, 22


def _sets(rows, shingle: int, lower: bool):
    """(doc_id, ascending distinct shingle hashes) of each row."""
    hashes = WordHashes()
    for piece in batches(rows, ["doc_id", "text"]):
        for doc, text in zip(piece["doc_id"], piece["text"]):
            octets = text.encode()
            yield doc, np.unique(rolling(hashes.of((octets.lower() if lower else octets).split()), shingle))


def _sketch(docs: DataFrame, shingle: int, lower: bool) -> np.ndarray:
    """Occurrences of all shingles by the first bits of their hash."""
    def fill(rows, counts):
        hashes = WordHashes()
        for piece in batches(rows, ["text"]):
            texts = [(t.encode().lower() if lower else t.encode()).split() for t in piece["text"]]
            flat = rolling(hashes.of([w for own in texts for w in own]), shingle)
            ends = np.cumsum([len(own) for own in texts])
            across = np.unique(np.concatenate([ends - k for k in range(1, shingle)])) if shingle > 1 else ends[:0]
            flat = np.delete(flat, across[(across >= 0) & (across < len(flat))])
            counts += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(counts.dtype)

    return additive_table(docs.select("text"), fill, 1 << SKETCH_BITS, "int32")


def _described(docs: DataFrame, shingle: int, percent: int, lower: bool) -> DataFrame:
    """(doc_id, n, s1, s2, end_count, prefix): set size, 128-bit key of the set, and the prefix in the fixed order.

    Shingles are written as signed numbers in the order of their hashes; with ``end_count``, the
    frequency of its last shingle, one can tell which of two prefixes ends first.
    """
    frequency = docs.sparkSession.sparkContext.broadcast(_sketch(docs, shingle, lower))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("end_count", pa.int64()),
                        ("prefix", pa.list_(pa.int64()))])

    def describe(rows):
        import xxhash

        out: list[tuple] = []
        for doc, own in _sets(rows, shingle, lower):
            n = len(own)
            seen = frequency.value[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.argsort(seen, kind="stable")[:n - -(-percent * n // 100) + 1]
            key = own.tobytes()
            out.append((doc, n, xxhash.xxh64_intdigest(key, 1) - (1 << 63), xxhash.xxh64_intdigest(key, 2) - (1 << 63),
                        int(seen[order[-1]]) if n else 0, (own[order] ^ np.uint64(1 << 63)).view(np.int64) if n else []))
            if len(out) == 2000:
                yield arrow_rows(schema, list(zip(*out)))
                out = []
        if out:
            yield arrow_rows(schema, list(zip(*out)))

    return written(docs.mapInArrow(describe, "doc_id long, n int, s1 long, s2 long, end_count long, prefix array<long>"), "sets")


#: What a row of the prefix index says about its member, and the same of the one it meets.
OWN = ["n", "pos", "shared", "end_count", "end"]
MET = ["m", "q", "shared_too", "end_count_too", "end_too"]


def _may_link(percent: int) -> Column:
    """Size, position and prefix filters of a pair met at one prefix shingle; no similar pair fails them at its first one.

    From the first common shingle on, either set must have as many left as they have in common. Common shingles up to the end of the prefix that ends first lie in both prefixes, so they are at most
    the prefix shingles that either shares with anyone; behind it there are so many as that set has left.
    """
    least, most = F.least("n", "m"), F.greatest("n", "m")
    met = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("q"))
    ends_first = (F.col("end_count") < F.col("end_count_too")) | ((F.col("end_count") == F.col("end_count_too")) & (F.col("end") <= F.col("end_too")))
    left = F.floor((percent * F.when(ends_first, F.col("n")).otherwise(F.col("m")) + 99) / 100) - 1
    common = F.least(met, F.least("shared", "shared_too") + left)
    return (100 * least >= percent * most) & ((100 + percent) * common >= percent * (F.col("n") + F.col("m")))


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int, lower: bool, share: int = 500) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; ``docs`` are (doc_id, text).

    The sets of all ends are made in one scan and go where a's set goes. With more than ``share``
    partners of one a, its set is sent to as many tasks as that takes. A mask of fixed size keeps most
    other texts from being hashed; the join behind it is exact.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MASK_BITS)).alias("cell")
    at_a = Window.partitionBy("a")
    dealt = pairs.withColumn("parts", F.ceil(F.count("*").over(at_a) / share).cast("int"))
    dealt = dealt.select("a", "b", "parts", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    own = dealt.groupBy("a").agg(F.max("parts").alias("parts")).select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = written(dealt.select("a", "b", "part").union(own), "pairs")

    def fill(rows, counts):
        for batch in rows:
            counts[np.asarray(batch.column("cell"))] = 1

    mask = additive_table(dealt.select(F.col("b").alias("doc_id")).distinct().select(cell), fill, 1 << MASK_BITS, "uint8", np.bitwise_or)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(mask))
    set_schema = pa.schema([("b", pa.int64()), ("hashes", pa.binary())])

    def hashed(rows):
        def wanted():
            for batch in rows:
                at = np.asarray(batch.column("cell"))
                yield batch.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
        for doc, hashes in _sets(wanted(), shingle, lower):
            yield arrow_rows(set_schema, [[doc], [hashes.tobytes()]])

    def compare(rows):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held, left = None, np.zeros(0, np.uint64)
        for batch in rows:
            links = []
            for a, b, octets in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "hashes"))):
                right = np.frombuffer(octets, np.uint64)
                if a == b:
                    held, left = a, right
                elif held == a:
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if 100 * both >= percent * (len(left) + len(right) - both):
                        links.append((a, b))
            if links:
                yield arrow_rows(schema, list(zip(*links)))

    sets = docs.filter("doc_id is not null").select("doc_id", "text", cell).mapInArrow(hashed, "b long, hashes binary")
    placed = sets.join(dealt, "b").repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
    return written(placed.select("a", "b", "hashes").mapInArrow(compare, "a long, b long"), "links")


def similar_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links reach, for each row of ``docs``.

    Two documents link when 100 x common >= percent x all of their distinct shingles. With fewer words
    than a shingle the whole text is one; without words the set is empty and links with nothing. Rows
    with the same id are one document; a null id links with nothing and has a null component.
    """
    own = id_text(docs)
    described = _described(own, shingle, percent, lower)
    known = described.filter("n > 0 and doc_id is not null")
    classes = written(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("member"), F.first("n").alias("n"), F.first("end_count").alias("end_count"),
                                                    F.first("prefix").alias("prefix"))
                      .withColumn("grp", F.struct(F.xxhash64("prefix", "n"), F.xxhash64("n", "prefix"))), "set-classes")

    # One row for each group and prefix shingle; shingles that one member alone has are of no use.
    groups = classes.groupBy("grp").agg(F.min("member").alias("head"), F.count("*").alias("size"), F.first("n").alias("n"),
                                        F.first("end_count").alias("end_count"), F.first("prefix").alias("prefix"))
    at_shingle = Window.partitionBy("shingle")
    # Most prefix shingles are nobody else's: rows go to their shingle as narrow as can be, the rest of what is known
    # of a group meets those that stay.
    groups = written(groups, "prefix-groups")
    met = groups.select("head", (F.col("size") > 1).alias("many"), F.posexplode("prefix").alias("pos", "shingle"))
    met = met.withColumn("met", F.count("*").over(at_shingle)).filter("met > 1 or many").select("shingle", "head", "pos")
    known_of = groups.select("head", "n", "end_count", F.element_at("prefix", -1).alias("end"))
    met = met.withColumn("shared", F.count("*").over(Window.partitionBy("head"))).join(known_of, "head")
    met = written(met.select("shingle", "head", *OWN), "prefix-rows")
    members = classes.join(met.select("head").distinct(), F.col("head") == F.col("member"), "left_semi").select("grp", F.col("member").alias("head"))
    members = written(members.join(classes.select("grp", "member"), "grp").select("head", "member"), "group-members")

    lead = F.min(F.struct(F.col("pos").alias("q"), F.col("n").alias("m"), F.col("head").alias("leader"), *[
        F.col(c).alias(d) for c, d in zip(OWN[2:], MET[2:])])).over(at_shingle)
    stars = met.withColumn("lead", lead).select("head", *OWN, "lead.*").filter(_may_link(percent) & (F.col("head") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("head").alias("b"))
    inside = members.filter("head <> member").select(F.col("head").alias("a"), F.col("member").alias("b"))
    links = _verified(own, stars.union(inside).distinct(), shingle, percent, lower)
    near = written(connected(members.select(F.col("member").alias("node")), links), "near-classes")

    # What can still join classes: pairs at a shingle whose ends lie apart.
    placed = met.join(members, "head").select("shingle", "member", *OWN).join(near.select(F.col("node").alias("member"), "component"), "member")
    spread = placed.withColumn("low", F.min("component").over(at_shingle)).withColumn("high", F.max("component").over(at_shingle)).filter("low < high")
    first = F.min(F.struct("pos", "member", "component")).over(at_shingle)
    spread = written(spread.withColumn("main", first).select("shingle", "member", *OWN, "component", (F.col("main.component") != F.col("component")).alias("apart")), "apart")
    apart = spread.filter("apart").drop("apart")
    other = spread.select("shingle", F.col("member").alias("b"), *[F.col(c).alias(d) for c, d in zip(OWN, MET)],
                          F.col("component").alias("other"), F.col("apart").alias("both"))
    rest = apart.join(other, "shingle").filter((F.col("component") != F.col("other")) & (~F.col("both") | (F.col("member") < F.col("b"))) & _may_link(percent))
    rest = rest.select(F.least("member", "b").alias("a"), F.greatest("member", "b").alias("b")).distinct()
    late = _verified(own, rest, shingle, percent, lower)
    final = connected(near.select(F.col("component").alias("node")).distinct(), late.join(
        near.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
        near.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    joined = near.join(final.select(F.col("node").alias("component"), F.col("component").alias("last")), "component")
    joined = joined.filter("last < node").select(F.col("node").alias("member"), "last")

    # Members without a partner are their own class; so are documents without a set.
    classed = classes.select("s1", "s2", "member").join(joined, "member", "left").select(
        "s1", "s2", F.coalesce("last", "member").alias("component"))
    out = described.select("doc_id", "n", "s1", "s2").join(classed, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), shingle=4, percent=85)


SQL = {"op8_jaccard_join": r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x20\x09-\x0D]+') AS a FROM documents),
words AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos, len(a) AS n FROM texts),
runs AS (SELECT doc_id, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS k, n, pos FROM words
         WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, s FROM runs WHERE k = 4 OR (n < 4 AND pos = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT t.doc_id, coalesce(z.n, 0) AS n_shingles, least(t.doc_id, coalesce(min(r.other), t.doc_id)) AS component_id
FROM texts t LEFT JOIN sizes z USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY t.doc_id, z.n"""}
