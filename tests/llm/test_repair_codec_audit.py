"""Conversation repair, piece codec and filter audit against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import conversation_repair as repair
from fieldtally.llm import filter_audit as audit
from fieldtally.llm import piece_codec as codec

TURNS = "conv_id long, turn long, role string, text string"


# -- conversation repair ---------------------------------------------------------------------------------------------


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if deal == 0:
            continue
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        out += [(conv, turn, "user" if deal == 4 else role, text)] * (2 if deal == 3 else 1)
    return out


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's (turn, role, text) rows, in order.

    Forward search over (cost, audit, state, turns), the least kept for each state.
    """
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = re.compile(r"(s?(ua)*)?|s?(ua)*u")
    best = {"": (0, "", [])}  # by the initial of the last turn

    def inserted(states):
        for _ in range(3):
            for last, (cost, text, turns) in list(states.items()):
                role = "assistant" if last == "u" else "user"
                option = (cost + 5, text + "I", turns + [(role, "")])
                if role[0] not in states or option[:2] < states[role[0]][:2]:
                    states[role[0]] = option
        return states

    for (_, role, text), fault in zip(rows, faults):
        states = inserted(dict(best))
        best = {}
        for last, (cost, edits, turns) in states.items():
            options = [(cost + 2, edits + "D", turns, last)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if legal.fullmatch("".join(r[0] for r, _ in turns) + role[:1]) and role[:1]:
                    options.append((cost + extra, edits + "K", turns + [(role, text)], role[0]))
                for new in ("user", "assistant"):
                    if legal.fullmatch("".join(r[0] for r, _ in turns) + new[0]):
                        options.append((cost + 1 + extra, edits + "R", turns + [(new, text)], new[0]))
            for option in options:
                if option[3] not in best or option[:2] < best[option[3]][:2]:
                    best[option[3]] = option[:3]
    cost, edits, turns = min(v for k, v in inserted(best).items() if k in ("", "a"))
    known = [t for t, _, _ in rows if t is not None]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, edits,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def brute_conversations(rows, damage=True):
    by = defaultdict(list)
    convs = {r[0] for r in rows}
    for conv, turn, role, text in brute_damage(rows) if damage else rows:
        by[conv].append((turn, role, text))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: brute_repair(sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0))) if c in by else nothing for c in convs}


def some_turns(seed, conversations=60, most=14):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "why", "why?", "", " \t", "A long answer, whole.", "cut off", None, "Yes. "]
    rows = []
    for c in range(conversations):
        for turn in range(pick.randint(1, most)):
            if pick.random() > 0.1:
                rows.append((c, turn * pick.choice([1, 1, 1, 2]) + 100 * turn, pick.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""]),
                             pick.choice(texts) if pick.random() < 0.4 else f"Turn {c} {turn}."))
    return rows


def found_conversations(spark, rows, tmp_path):
    spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as n", "'x' as audit", "2 as place", "3 as copies").write.parquet(f"{tmp_path}/conversations.parquet")
    out = repair.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(out) == len({r.conv_id for r in out})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}


def test_repair_query_equals_brute_force(spark, tmp_path):
    rows = some_turns(1)
    rows += [(700, 0, "user", "Hi."), (700, 1, "assistant", "Ho.")] + [(None, t, "user", "x.") for t in (None, 3, 4)] + [(701, None, "user", "lonely.")]
    assert found_conversations(spark, rows, tmp_path) == brute_conversations(rows)


def test_repair_of_an_empty_table(spark, tmp_path):
    assert found_conversations(spark, [], tmp_path) == {}


def test_every_small_conversation(spark):
    """All conversations of up to four rows over nine kinds of row, by the programme and its ranks alone."""
    kinds = [(i, f) for i in ("s", "u", "a", "?") for f in (0, 2, 3) if (i, f) not in (("?", 3), ("s", 2), ("u", 2))]
    ends = repair._with_inserts(list(repair.ENDS))
    for n in range(4):
        runs = list(itertools.product(kinds, repeat=n))
        got = repair.least_audits([repair.Rows(bytes(repair.KINDS[k] for k in run), ends, True) for run in runs], [repair.START])
        for run, ((edits, _, cost),) in zip(runs, got):
            names = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
            rows = [(k, names[i], "same" if f == 2 else f"t{k}" + ("" if f == 3 else ".")) for k, (i, f) in enumerate(run)]
            want = brute_repair([(0, "tool", "same"), (0, "user", "same"), (0, "assistant", "same"), (0, "system", "same"), *rows])
            base = brute_repair([(0, "tool", "same"), (0, "user", "same"), (0, "assistant", "same"), (0, "system", "same")])
            if base[5] == 8 and want[6].startswith("DDDD"):
                assert (cost, edits) == (want[5] - 8, want[6][4:])


@pytest.mark.parametrize("most_rows", [1, 3, 7, 4096])
def test_chunks_do_not_change_the_repair(spark, most_rows):
    """One conversation with most rows, cut into chunks of any size."""
    rows = [(5, t, r, x) for _, t, r, x in some_turns(3, 1, 150)] + [(5, None, "user", "Again.")] * 9 + some_turns(4, 5)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c]
    done = repair.repair_conversations(spark.createDataFrame(clean, TURNS).repartition(5), most_rows)
    # Rows of one turn have no order in the input; the audit's texts are compared where turns differ.
    want = brute_conversations(clean, damage=False)
    report = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in done.report.collect()}
    assert report == {c: v[:-1] for c, v in want.items()}
    digests = {r.conv_id: r.digest for r in repair.turn_digests(done.turns, most_bytes=40).collect()}
    assert digests == {c: v[-1] for c, v in want.items() if c in digests}
    assert all(want[c][-1] == hashlib.sha256(b"").hexdigest() for c in set(want) - set(digests))


def test_very_long_turn_and_hot_row(spark):
    """A text of some MB without blanks, and one row that makes up most of the table."""
    long = "x" * 3_000_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Well.")] + [(2, 0, "user", "Same."), (2, 1, "assistant", "Same.")] * 400
    done = repair.repair_conversations(spark.createDataFrame(rows, TURNS), 100)
    report = {r.conv_id: (r.duplicate, r.cost, r.audit) for r in done.report.collect()}
    assert report == {1: (0, 0, "KK"), 2: (798, 1596, "K" + "D" * 399 + "K" + "D" * 399)}
    digests = {r.conv_id: r.digest for r in repair.turn_digests(done.turns).collect()}
    assert digests == {1: hashlib.sha256(f"user:{long}\nassistant:Well.".encode()).hexdigest(), 2: hashlib.sha256(b"user:Same.\nassistant:Same.").hexdigest()}


# -- piece codec -----------------------------------------------------------------------------------------------------


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=codec.default_model())


def test_codec_equals_the_library_on_random_texts():
    own, known, pick = codec.PieceCodec(codec.default_model(), most_stretches=50, most_pairs=200), library(), random.Random(2)
    parts = ["a", "b", "th", "e", codec.SPACE_MARK, " ", "  ", "     ", "\n", "\t", "1", "23", ".", "ing", "é", "ü", "中", "😀", "　", "S", "tion", "\x00",
             "ation", "'s", "##", "-", "---", "====", "__", "é", "<s>", "<0x41>"]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 50)))
        assert own.encode(text).tolist() == known.encode(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 5000 + "x", "ab" * 50_000, "=" * 10_001, "中文" * 3000, "\n" * 100])
def test_codec_on_long_runs(text):
    assert codec.codec(codec.default_model()).encode(text).tolist() == library().encode(text)


def test_codec_query(spark, tmp_path, documents):
    pick = random.Random(5)
    long = "".join(pick.choice("etaoinshrdlu") for _ in range(1_000_000))
    rows = [(1, "Hello world"), (2, ""), (3, None), (None, "no id"), (4, " lead  and trail "), (4, "again"), (5, "line\n one\n\ntwo"), (6, long), (7, "Hello world")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in codec.op12_piece_codec(spark, str(tmp_path)).collect())
    known = library()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = Counter()
    for d, t in rows:
        ids = known.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids))), sha(known.decode(ids) if ids else "")] += 1
    assert got == want


def test_codec_of_an_empty_table(spark, tmp_path, documents):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert codec.op12_piece_codec(spark, str(tmp_path)).collect() == []


# -- filter audit ----------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    smallest = {}
    for d, text, _ in docs:
        if d is not None:
            smallest[text or ""] = min(d, smallest.get(text or "", d))
    good, toxic = ({row[0] for row in labels if row[k] == 1 and row[0] is not None} for k in (1, 2))
    failing = []
    for d, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and smallest[text] < d}
        failing.append((source or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failing}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in failing if f[0] == part]
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(removed)
                out[part, "".join(order), step] = (
                    len(left), len(removed), sum(p == part and f in x for p, x, *_ in failing) - len(removed), sum(p == part and x == {f} for p, x, *_ in failing),
                    sum(x[2] for x in removed), sum(x[3] for x in removed))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "'x' as part", "'y' as digest", "2 as n").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as good").write.parquet(f"{tmp_path}/labels.parquet")
    rows = audit.op13_filter_audit(spark, str(tmp_path)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_query_equals_brute_force(spark, tmp_path):
    pick = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(pick.choices(words, k=pick.choice([5, 49, 50, 80]))) for _ in range(10)]
    texts += [" ".join(pick.sample(words, 55)) for _ in range(10)]
    texts += [t + pick.choice([" #", " ABCDEFGHIJKLMNOP", "\n*", " É x", ""]) for t in texts] + ["", None, " \t\n", "x" * 200_000]
    docs = [(k if k % 17 else None, pick.choice(texts), pick.choice(["a", "b", "c", None, ""])) for k in range(150)]
    docs += [(500, "same id", "a"), (500, "same id", "b")] + [(600 + k, "hot copy", "hot") for k in range(200)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (9, None, None), (None, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    assert audited(spark, docs, labels, tmp_path) == brute_audit(docs, labels)


def test_audit_of_an_empty_table(spark, tmp_path):
    assert audited(spark, [], [], tmp_path) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_plain_changes_visit_every_order(n):
    order = list(range(n))
    seen = [tuple(order)]
    for k in audit.plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_swapped_diagram_weighs_masks():
    pick = random.Random(3)
    counts = {m: (pick.randint(0, 3), 0, 1) for m in range(16) if pick.random() < 0.7}
    for order, path in audit.every_order(counts, "ABCD"):
        for k in range(5):
            before = sum(1 << "ABCD".index(f) for f in order[:k])
            assert path[k] == tuple(sum(c[i] for m, c in counts.items() if not m & before) for i in range(3))
