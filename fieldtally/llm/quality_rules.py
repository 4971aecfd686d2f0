"""Line-first cleaning: rules judge single lines, failing lines go, and documents that lose too much go.

One pass, no shuffle: a document is judged from its own text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldtally.llm.common import arrow_rows, batches, id_text, table, words_of

SYMBOLS = "#*$%&|<>"
BOILERPLATE = re.compile(
    r"all rights reserved|licen[sc]ed under|released under the|terms of (?:use|service)|privacy policy|cookie(?:s| policy| settings)"
    r"|enable javascript|sign (?:in|up) (?:to|for)|log in to|subscribe (?:to|now)|click here|read more|share (?:this|on)|skip to content", re.I)


@dataclass(frozen=True)
class LineLimits:
    """When a line fails, as shares of its words, and how much of a document may go."""

    symbols: float = 0.3      # characters of SYMBOLS
    menu_marks: float = 0.2   # words that only separate entries
    repeats: float = 0.3      # words equal to the word before
    shouts: float = 0.5       # words ending in !! or ??
    least_words: int = 8      # below this, shares of repeats say nothing
    unbroken: int = 80        # words in a line without any punctuation
    boilerplate_words: int = 25
    lost: float = 0.3         # share of the document's word characters in failed lines


MENU_MARKS = {"|", ">", "<", "»", "«", "•", "·", "-", "–", "/", "\\", "::", "→"}
PUNCTUATION = re.compile(r"[.,;:!?…。、]")


def failure(line: str, words: list[str], limits: LineLimits) -> str | None:
    """Name of the first rule that a line with words fails, or None."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > limits.symbols * n:
        return "symbols"
    if sum(w in MENU_MARKS for w in words) > limits.menu_marks * n and n >= 4:
        return "navigation"
    if n >= 3 and line.count("!!") + line.count("??") > limits.shouts * n:
        return "punctuation"
    if n >= 4 and line == line.upper() and line != line.lower():
        return "capitals"
    if n >= limits.least_words and sum(map(str.__eq__, words, words[1:])) > limits.repeats * n:
        return "repeats"
    if n >= limits.unbroken and not PUNCTUATION.search(line):
        return "punctuation"
    if n <= limits.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # Pairs are numbered anew before the third word joins, so that no product overflows.
    pair = np.unique(code[:-1] * len(number) + code[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pair[:-1].astype(np.int64) * len(number) + code[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + len(again)] |= again
    return int(covered.sum())


def judge_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lost_chars, n_failed_lines, reasons, cleaned), one row for each input row, null ids included.

    ``cleaned`` is the text without its failed lines and later copies of its own lines. Null and empty
    texts have no words, so they fail the base rule.
    """
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                       ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64()), ("n_failed_lines", pa.int64()),
                       ("reasons", pa.list_(pa.string())), ("cleaned", pa.string())])

    def one(text: str):
        words, seen, kept_lines, reasons = [], set(), [], []
        chars = lost = n_dup = failed = 0
        for line in text.split("\n"):
            own = words_of(line)
            if not own:
                kept_lines.append(line)
                continue
            size = sum(map(len, own))
            chars += size
            words += own
            again = line in seen
            n_dup += again
            seen.add(line)
            why = failure(line, own, limits)
            if why:
                failed += 1
                lost += size
                reasons.append(why)
            elif not again:
                kept_lines.append(line)
        repeats = repeated_words(words)
        base = len(words) < 50 or 100 * repeats > 50 * len(words)
        return (len(words), chars, sum(map(text.count, SYMBOLS)), n_dup, repeats, base, not base and lost <= limits.lost * chars,
                lost, failed, sorted(set(reasons)), "\n".join(kept_lines))

    def judge(rows):
        for piece in batches(rows, ["doc_id", "text"]):
            yield arrow_rows(arrow, [piece["doc_id"], *zip(*map(one, piece["text"]))])

    return id_text(docs).mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                           "base_failed boolean, kept boolean, lost_chars long, n_failed_lines long, reasons array<string>, cleaned string")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "n_failed_lines")
