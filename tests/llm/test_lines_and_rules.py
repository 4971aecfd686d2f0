"""Line de-duplication, quality rules and url rules against brute force, with odd rows."""

import hashlib
import zlib

import numpy as np
import pytest

from fieldtally.llm import line_dedup as L
from fieldtally.llm import quality_rules as Q
from fieldtally.llm import url_filters as U

A = "A line that several documents have."
ROWS = [
    (5, f"{A}\nown words of five\n\n{A}"), (2, f"  {A.upper()}\t\nshort\nshort"), (9, f"{A}\nshort\nnine alone here"), (None, f"{A}\nx"),
    (3, None), (4, ""), (7, "\n\n"), (8, f"a line that several documents have.\r\n{'long ' * 30_000}"), (11, f"{'long ' * 30_000}\nend"), (12, "own words of five"),
]


def brute_lines(rows, least=10):
    blank, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = {d: (t or "").split("\n") for d, t in rows if d is not None}
    first = {}
    for d in sorted(split):
        for line in split[d]:
            first.setdefault(line.strip(blank).translate(lower), d)
    out = {}
    for d, lines in split.items():
        keys = [line.strip(blank).translate(lower) for line in lines]
        kept = [line for line, k in zip(lines, keys) if len(k) < least or first[k] == d]
        out[d] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def test_lines(documents):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in L.dedup_lines(documents(ROWS)).collect()}
    assert got.pop(None) == (2, 0, f"{A}\nx")
    assert got == brute_lines(ROWS)


def test_line_bitmaps_and_columns(documents):
    docs = documents(ROWS)
    for r in L.keep_bitmaps(docs).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines)
        assert r.n_lines - bits.sum() == r.n_dropped
    out = L.dedup_documents(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] is None and texts[5] == "own words of five\n" and texts[None] == f"{A}\nx"


def test_lines_many_tasks_one_line(spark, documents):
    """One line in most documents lies across many range partitions; only the first document keeps it."""
    rows = [(k, f"the very same long line\nline number {k} alone") for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.n_dropped for r in L.dedup_lines(documents(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {k: int(k > 0) for k in range(400)}


def test_lines_repeated_rows_and_empty_table(documents):
    got = L.dedup_lines(documents([(1, A), (1, A), (2, A)])).collect()
    assert sorted((r.doc_id, r.n_dropped, r.kept) for r in got) == [(1, 0, A), (1, 0, A), (2, 1, "")]
    assert L.dedup_lines(documents([]).filter("doc_id > 0")).collect() == []


def brute_quality(text):
    words = [w for w in (text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for k, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r") and x in lines[:k])
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


CLEAN = "\n".join(" ".join(f"word{k}v{j}" for j in range(12)) + "." for k in range(8))
TEXTS = [
    None, "", " \n\t", CLEAN, CLEAN + "\nAll rights reserved.", "a b c a b c a b", "one two\u00a0three \x1cfour", "x\nx\n\nx y\nx y",
    "\n".join(["HOME | NEWS | CONTACT | ABOUT"] * 20), " ".join(["spam"] * 80), "*** ### buy &&& now $$$ " * 20, "SHOUT!! LOUD!! WORDS!! " * 20,
    CLEAN + "\n" + "menu | a | b | c | d | e | f", "ünï çödé 中文 " * 3, "z" * 50_000,
]


def test_quality(documents):
    got = {r.doc_id: r for r in Q.judge_lines(documents(list(enumerate(TEXTS)))).collect()}
    for k, text in enumerate(TEXTS):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert [k for k in got if got[k].kept] == [k for k in got if k in (3, 4, 12)]
    assert got[4].cleaned == CLEAN and got[12].cleaned == CLEAN


@pytest.mark.parametrize("line, why", [
    ("Home | News | Contact | About us", "symbols"), ("a - b - c - d - e", "navigation"), ("BUY!! NOW!! OR!! NEVER!!", "punctuation"),
    ("THIS LINE IS ALL CAPITALS", "capitals"), ("the the the the the the the the cat", "repeats"), ("Licensed under CC BY 4.0.", "boilerplate"),
    ("A calm line of prose, as one reads it.", None), ("word " * 90, "repeats"), (" ".join(f"w{k}" for k in range(90)), "punctuation"),
])
def test_line_rules(line, why):
    assert Q.failure(line, line.split(), Q.LineLimits()) == why


def brute_url(url):
    head, mark, tail = (url or "").partition("://")
    host, path = "", ""
    if mark:
        cut = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
        host, rest = tail[:cut], tail[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.NET/en/1", "http://a.example.net/de/1?q", "https://xexample.net/en/", "https://net/x", "https://foo.net?x",
            "http://example.com/de/", "http://m.example.com/en/", "http://x.org/fr/a#b", "ftp://x://net/", "http://casino-win.example.com/a",
            "http://a.cheap-pills.example.org/fr/x", "http://cheap-pills.example.org/en/", "http://x.com/WP-login.php", "http://x.com/wp-login.php", "http://ÀB.org/é\nz"]
    rows = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)] + [(0, None, "h", 2)], "page_id long, url string, html string, host int")
    got = [r for r in U.judge_urls(rows).collect()]
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, site = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        blocked = any(__import__("re").search(p.regex, host + path) for p in U.PATTERN_RULES)
        assert r.verdict == (site or ("block" if blocked else "allow"))
    assert {urls[r.page_id] for r in got if r.rule is None and r.verdict == "block"} == {
        "http://casino-win.example.com/a", "http://cheap-pills.example.org/en/", "http://x.com/wp-login.php"}
    assert U.judge_urls(rows.limit(0)).collect() == []


def test_host_rules_stay_in_the_host(spark):
    """A star of a host rule ends with the host, and a word of a label isn't the begin of another word."""
    calm = ["http://example.org/my-casino.html", "http://blog.org/a-bets.pdf", "http://pornic.fr/ville", "http://x.com/adult-education.html", "http://b.org/?q=casino-x.y"]
    shop = ["http://best-casino.org/", "http://a.my-bets.co/x", "http://casino-a.b/", "http://porn.example.com/", "http://porn-x.y/", "http://www.e-pills.org"]
    rows = spark.createDataFrame(list(enumerate(calm + shop)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(rows).collect()}
    assert got == {k: "allow" if k < len(calm) else "block" for k in range(len(calm + shop))}


def test_a_very_long_url(spark):
    rows = spark.createDataFrame([(1, "http://ex.org/" + "a-" * 300_000), (2, "http://ads." + "x" * 500_000 + "/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge_urls(rows).collect()} == {1: "allow", 2: "block"}


def test_literals_stand_in_every_url_that_fits():
    assert U.Rule("||cheap-pills.", "block").literals == {"cheap", "pills"}
    assert U.Rule("||casino-*.", "block").literals == {"casino"}
    assert U.Rule("||porn*.", "block").literals == set()
    assert U.Rule("ads/banner^", "block").literals == {"banner"}
