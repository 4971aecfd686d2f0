"""Text keys, null markers, numbers and spreadsheet dates as built-in column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_map() -> tuple[str, str]:
    """Letters of the Latin blocks whose canonical decomposition starts with a plain letter."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        decomposed = unicodedata.normalize("NFD", chr(code))
        if len(decomposed) > 1 and decomposed[0].isascii() and decomposed[0].isalpha():
            accented.append(chr(code))
            plain.append(decomposed[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_map()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(c), _ACCENTED, _PLAIN), r"[̀-ͯ]+", "")


def fold(c: Column | str) -> Column:
    """Comparison key: lower case, no accents, punctuation to space, single spaces, trimmed."""
    letters = F.regexp_replace(strip_accents(F.lower(col(c))), r"[^a-z0-9]+", " ")
    return F.trim(letters)


def tokenize(c: Column | str) -> Column:
    """Words of the folded text; blank text gives an empty array."""
    folded = fold(c)
    return F.when(folded == "", F.array().cast("array<string>")).otherwise(F.split(folded, " "))


def singular_candidates(word: Column | str) -> Column:
    """The word first, then its possible singulars (``-ces``, ``-es``, ``-s``) when longer than 3."""
    w = col(word)
    n = F.length(w)
    long_enough = n > 3
    options = F.array(
        w,
        F.when(long_enough & w.endswith("ces"), F.concat(F.substr(w, F.lit(1), n - 3), F.lit("z"))),
        F.when(long_enough & w.endswith("es"), F.substr(w, F.lit(1), n - 2)),
        F.when(long_enough & w.endswith("s"), F.substr(w, F.lit(1), n - 1)),
    )
    return F.array_distinct(F.array_compact(options))


def last_singular(word: Column | str) -> Column:
    """The shortest change that makes a plural singular: drop the final ``s``."""
    return F.element_at(singular_candidates(word), -1)


def slug(c: Column | str) -> Column:
    """Lower case, accent-free, other characters to one hyphen, no hyphen at either edge."""
    text = F.regexp_replace(strip_accents(F.lower(col(c))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(text, r"^-|-$", "")


# What spreadsheets write for "no data", per reader.
NULL_MARKERS = {
    "import": ["", "-", "0", "n/a", "#n/a", "null", "undefined"],
    "template": ["", "-", "n/a", "#n/a", "null", "undefined"],
    "catalog": ["", "-", "--", "n/a"],
}


def clean_cell(c: Column | str, reader: str = "import") -> Column:
    """Trimmed text, or null when the cell holds one of the reader's null markers."""
    spaced = F.replace(col(c).cast("string"), F.lit("\u00a0"), F.lit(" "))
    # Trimming without a pattern is many times cheaper; only before a last separator does a pattern's end lie elsewhere.
    parted = spaced.endswith("\u0085") | spaced.endswith("\u2028") | spaced.endswith("\u2029")
    text = F.when(parted, F.regexp_replace(spaced, r"^\s+|\s+$", "")).otherwise(F.btrim(spaced, F.lit(" \t\n\x0b\f\r")))
    marker = text.isin("", "-", "--", "n/a", "N/A") if reader == "catalog" else F.lower(text).isin(
        NULL_MARKERS[reader]
    )
    return F.when(~marker, text)


def parse_number(c: Column | str) -> Column:
    """Digits, sign and separators only; the first comma is the decimal point; else null."""
    kept = F.regexp_replace(clean_cell(c), r"[^\d.,-]", "")
    # A cell without any digit left is the number zero once its text is dropped.
    return F.when(kept == "", F.lit(0.0)).otherwise(
        F.regexp_replace(kept, r"^([^,]*),", r"$1.").try_cast("double")
    )


def parse_seed_number(c: Column | str) -> Column:
    """Catalogue variant: commas are dropped as well."""
    text = col(c).cast("string")
    kept = F.regexp_replace(text, r"[^\d.-]", "")
    return F.when(text.isNull() | (text == ""), None).when(kept == "", F.lit(0.0)).otherwise(
        kept.try_cast("double")
    )


def excel_date(c: Column | str, number: Column | None = None) -> Column:
    """Spreadsheet serial (20000..80000), ISO prefix or d/m/yyyy, as ``yyyy-MM-dd``; else null.

    ``number`` tells whether the cell is one; digits in a cell of text are no serial. Without it they are.
    """
    text = F.trim(col(c).cast("string"))
    serial = F.when((F.lit(True) if number is None else number) & text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    day = F.regexp_extract(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})", 1)
    month = F.regexp_extract(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})", 2)
    year = F.regexp_extract(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})", 3)
    return (
        F.when(
            (serial > 20000) & (serial < 80000),
            F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")), "yyyy-MM-dd"),
        )
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10))
        .when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    )


def excel_time(c: Column | str, number: Column | None = None) -> Column:
    """Fraction of a day, or the first ``h:mm`` in the text, as ``HH:mm``; else null. ``number`` as for ``excel_date``."""
    text = F.trim(col(c).cast("string"))
    fraction = F.when((F.lit(True) if number is None else number) & text.rlike(r"^\d*\.?\d+([eE]-?\d+)?$"), text.try_cast("double"))
    minutes = F.floor(fraction * 1440 + 0.5)
    hour = F.regexp_extract(text, r"(\d{1,2}):(\d{2})", 1)
    return F.when((fraction >= 0) & (fraction < 1), minutes_to_hhmm(minutes)).when(
        hour != "", F.concat_ws(":", F.lpad(hour, 2, "0"), F.regexp_extract(text, r"(\d{1,2}):(\d{2})", 2))
    )


def minutes_to_hhmm(minutes: Column) -> Column:
    return F.concat_ws(
        ":",
        F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"),
        F.lpad((minutes % 60).cast("bigint").cast("string"), 2, "0"),
    )


def hhmm_to_minutes(time: Column | str) -> Column:
    """Minutes of the day, null when the text is not ``h:m``."""
    hour = F.regexp_extract(col(time), r"^\s*(\d+)\s*:\s*(\d+)", 1).try_cast("int")
    minute = F.regexp_extract(col(time), r"^\s*(\d+)\s*:\s*(\d+)", 2).try_cast("int")
    return hour * 60 + minute


def blank(c: Column | str) -> Column:
    """Null and empty text alike."""
    return col(c).isNull() | (col(c) == "")


def half_up(c: Column, decimals: int = 0) -> Column:
    """Round half towards plus infinity (Spark's ``round`` goes away from zero)."""
    if decimals == 0:
        return F.floor(c + 0.5)
    factor = 10.0**decimals
    return F.floor(c * factor + 0.5) / F.lit(factor)


def number_text(c: Column) -> Column:
    """Shortest text of a number: whole values without a decimal part."""
    value = c.cast("double")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
