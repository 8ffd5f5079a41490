"""Reference numbers, dates, languages and boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import blank_if_null, letters, strip

#: What ends a line besides the newline.
ENDINGS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def extract_ref(c: Column) -> Column:
    """The first number/year after a number sign, or null."""
    return F.nullif(F.regexp_extract(c, r"(?iU)(?:№|No\.?|N\.?|#)\s*([0-9]+/[0-9]{4})", 1), F.lit(""))


def extract_date(c: Column) -> Column:
    """The first day-month-year as year-month-day, not held against the calendar, or null."""
    part = lambda i: F.regexp_extract(c, r"(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})", i)
    return F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))


def detect_language(c: Column) -> Column:
    text = blank_if_null(c)
    return F.when(text == "", "en").when(text.rlike("[Ѐ-ӿ]"), "uz-cyrillic").otherwise("uz-latin")


def boundary_line(line: Column) -> Column:
    """Whether a line starts a new announcement."""
    return F.transform(F.array(strip(line)), _boundary)[0]


def _boundary(s: Column) -> Column:
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    banner = (F.length(s) > 25) & (upper / F.nullif(letters(s), F.lit(0)) > 0.85)
    return (
        F.substring(s, 1, 30).rlike(r"(?U)\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b")
        | s.rlike(r"(?U)(?:№|No\.?|N\.?)\s*\d+")
        | F.coalesce(banner, F.lit(False))
        | s.isin("OOO", "===")
        | s.rlike(r"^[A-Z0-9\-\s]{20,}$")
    )


def announcements(c: Column, least_letters: int = 40) -> Column:
    """The text's announcements as an array, as split_announcements gives them in rows."""
    ended = F.regexp_replace(blank_if_null(c), rf"(?:{ENDINGS})\z", "")
    lines = F.split(ended, ENDINGS, -1)
    return F.when(blank_if_null(c) == "", F.array().cast("array<string>")).otherwise(F.transform(F.array(lines), lambda x: _cut(x, least_letters))[0])


def _cut(lines: Column, least_letters: int) -> Column:
    """Lines to stripped segments. Each array is bound to a lambda's variable, so it is worked out once."""
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | boundary_line(F.element_at(lines, i)))
    part = lambda a, b: strip(F.array_join(F.slice(lines, a, b - a), "\n"))
    parts = F.transform(F.array(starts), lambda s: F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.array(F.size(lines) + 1)), part))[0]
    return F.transform(F.array(parts), lambda p: F.when(F.size(p) == 1, p).otherwise(F.filter(p, lambda t: letters(t) >= least_letters)))[0]


def format_text(segments: Column, *fallbacks: Column) -> Column:
    """Segments each followed by a rule line, else the first text that is not empty, else a note that there is none."""
    kept = F.filter(F.transform(segments, strip), lambda s: s != "")
    joined = F.concat(F.array_join(kept, "\n===\n"), F.lit("\n===\n"))
    return F.when(F.size(segments) > 0, joined).otherwise(F.coalesce(*[F.nullif(f, F.lit("")) for f in fallbacks], F.lit("(No text)")))


def relative_time(then: Column, now: Column) -> Column:
    hours = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 3_600_000_000)
    return F.when(hours < 1, "Just now").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).when(hours < 48, "Yesterday").otherwise(F.date_format(then, "yyyy-MM-dd"))
