"""Text functions from Column to Column; null counts as the empty text unless said otherwise.

Patterns are Java's with Unicode classes switched on ((?U)), so letters, digits and white space are those of any
script. Each function is a chain of built-in expressions without Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"

# Letters that look alike in both scripts, lower then upper case.
CYRILLIC, LATIN = "аеорсухАЕОРСУХ", "aeopcyxAEOPCYX"
# The lower-case letters by which a script is told.
LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyzʻ"
CYRILLIC_LETTERS = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяўқғҳ"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def replaced(c: Column, *rules: tuple[str, str]) -> Column:
    """The rules (pattern, replacement) one after the other."""
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+\z", "")


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){WS}+", " "))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def per_line(c: Column, fn) -> Column:
    return F.array_join(F.transform(F.split(c, "\n", -1), fn), "\n")


def page_text(c: Column) -> Column:
    """Embedded page text: hard spaces to spaces, stripped."""
    return strip(F.translate(blank_if_null(c), " ", " "))


def normalize_path(c: Column) -> Column:
    """Stripped of white space and double quotes, backslashes not doubled, . and .. resolved; empty or null is null.

    Two slashes at the start stay, more become one; what leads above the start keeps its .., and a path of nothing is
    a dot.
    """
    bare = F.regexp_replace(F.regexp_replace(strip(c), r'^"+|"+\z', ""), r"\\{2,}", r"\\")
    lead = F.regexp_extract(bare, r"^(//(?!/)|/?)", 1)
    parts = F.filter(F.split(bare, "/+"), lambda x: ~x.isin("", "."))

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) != "..")
        return F.when(F.coalesce(up, F.lit(False)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == "..") & (lead != "") & (F.size(acc) == 0), acc).otherwise(F.concat(acc, F.array(x)))

    path = F.concat(lead, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(c != "", F.when(path == "", ".").otherwise(path))


def clean_text(c: Column) -> Column:
    """Blank lines, line ends, hyphen breaks, punctuation spacing, lone characters and quotes tidied, in this order."""
    stripped = per_line(F.regexp_replace(blank_if_null(c), "\n{3,}", "\n\n"), strip)
    return strip(
        replaced(
            stripped,
            (r"(?U)(\w)-\n(\w)", "$1$2"),
            (r"(?U)\s+([.,;:!?)])", "$1"),
            (r"(?U)([.,;:!?])([^\s\d])", "$1 $2"),
            (r" {2,}", " "),
            (r"\n[a-zA-Zа-яА-ЯёЁ0-9]\n", "\n"),
            (r'(?U)"\s+', '"'),
            (r'(?U)\s+"', '"'),
        )
    )


def normalize_lines(c: Column) -> Column:
    """Per line: white space squeezed, the letter O beside a digit made 0, one thousands separator a match dropped."""
    return per_line(
        blank_if_null(c),
        lambda line: replaced(squeeze(line), (r"(?U)\bO(\d)", "0$1"), (r"(?U)(?<=\d)O\b", "0"), (r"(?U)(\d)\s*,\s*(\d{3})\b", "$1$2")),
    )


def noise_line(line: Column) -> Column:
    """Few alphanumerics, more than two clusters of capitals, or more than two short tokens that recur."""
    return F.transform(F.array(strip(line)), _noisy)[0]


def _noisy(s: Column) -> Column:
    alnum = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))
    clusters = F.regexp_count(s, F.lit("[A-Z]{6,}"))
    recurs = lambda words: F.size(F.filter(F.array_distinct(words), lambda t: F.size(F.filter(words, lambda u: u == t)) > 3)) > 2
    short = F.filter(F.split(s, rf"(?U){WS}+"), lambda t: F.length(t) <= 4)
    return (s != "") & (((alnum / F.length(s) < 0.4) & (F.length(s) > 10)) | (clusters > 2) | F.transform(F.array(short), recurs)[0])


def filter_noise_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(blank_if_null(c), "\n", -1), lambda line: ~noise_line(line)), "\n")


def char_correct(c: Column) -> Column:
    """Look-alike letters, zeros and ones that stand alone, white space."""
    return strip(replaced(F.translate(blank_if_null(c), "ОоІі", "OoIi"), (r"(?U)0(?!\d)", "O"), (r"(?U)(?<=\D)1(?=\D)", "l"), (rf"(?U){WS}+", " ")))


def _word_fix(w: Column) -> Column:
    """The last rule that applies to the word wins, on the word as it was."""
    return (
        F.when(F.contains(w, F.lit("0")), F.replace(w, F.lit("0"), F.lit("O")))
        .when(F.contains(w, F.lit("l")), F.replace(w, F.lit("l"), F.lit("I")))
        .when(F.contains(w, F.lit("ch")) | F.contains(w, F.lit("sh")), w)
        .when(F.contains(w, F.lit("g'")), F.replace(w, F.lit("g'"), F.lit("gʻ")))
        .when(F.contains(w, F.lit("o'")), F.replace(w, F.lit("o'"), F.lit("oʻ")))
        .otherwise(w)
    )


def postocr_correct(c: Column) -> Column:
    """Error patterns, punctuation spacing, word rules. The fold of look-alike letters is unconditional."""
    t = replaced(blank_if_null(c), (r"(?U)\b0\b", "O"), (r"(?U)\bl\b", "I"), (r"(?U)\brn\b", "m"), (r"(?U)\bvv\b", "w"))
    t = F.translate(t, CYRILLIC[:7], LATIN[:7])
    t = replaced(t, ("o'", "oʻ"), ("g'", "gʻ"), (rf"(?U){WS}+", " "), (r"(?U)(\w+)-\s+(\w+)", "$1$2"))
    t = replaced(t, (r"(?U)\s+([.,;:!?])", "$1"), (r"([.,;:!?])([А-Яа-яA-Za-z])", "$1 $2"), (rf"(?U){WS}+", " "))
    return F.array_join(F.transform(F.split(strip(t), " "), _word_fix), " ")


def _script(c: Column) -> Column:
    """Letters are counted once by what their removal leaves; the share, bound to a lambda's variable, is worked out once."""
    of = lambda low, letters: F.length(low) - F.length(F.translate(low, letters, ""))
    counts = F.transform(F.array(F.lower(c)), lambda low: F.struct(of(low, LATIN_LETTERS).alias("l"), of(low, CYRILLIC_LETTERS).alias("c")))
    ratios = F.transform(counts, lambda n: n["l"] / F.nullif(n["l"] + n["c"], F.lit(0)))
    return F.transform(ratios, lambda r: F.when(r > 0.7, "latin").when(r < 0.3, "cyrillic").when(r.isNull(), "unknown").otherwise("mixed"))[0]


def detect_script(c: Column) -> Column:
    return _script(blank_if_null(c))


def mixed_script_fix(c: Column) -> Column:
    """A mixed text's look-alikes are turned to the script that most words have, the first seen if several do.

    Only the words of mixed texts are looked at.
    """
    return F.transform(F.array(blank_if_null(c)), lambda t: F.when(_script(t) == "mixed", _to_main(t)).otherwise(t))[0]


def _to_main(t: Column) -> Column:
    scripts = F.transform(F.filter(F.split(t, rf"(?U){WS}+"), lambda w: w != ""), _script)

    def main(s: Column) -> Column:
        return F.array_max(F.transform(F.array_distinct(s), lambda k: F.struct(F.size(F.filter(s, lambda y: y == k)).alias("n"), (-F.array_position(s, k)).alias("p"), k.alias("k"))))["k"]

    fixed = lambda k: F.when(k == "latin", F.translate(t, CYRILLIC, LATIN)).when(k == "cyrillic", F.translate(t, LATIN, CYRILLIC)).otherwise(t)
    return F.transform(F.transform(F.array(scripts), main), fixed)[0]


def ocr_lang_route(c: Column) -> Column:
    """Language packs by the share of a-z among a-z and Cyrillic letters."""
    low = F.lower(blank_if_null(c))
    latin, cyrillic = F.length(F.regexp_replace(low, "[^a-z]", "")), F.length(F.regexp_replace(low, "[^Ѐ-ӿ]", ""))
    ratio = cyrillic / F.nullif(latin + cyrillic, F.lit(0))
    return F.when(ratio > 0.7, "rus+uzb").when(ratio < 0.3, "uzb+eng").otherwise("uzb+rus+eng")


def map_lang(c: Column, available: tuple[str, ...] = ("uzb", "eng", "rus")) -> Column:
    """Language code to packs in order of use, those not available left out unless none is."""
    low = F.lower(strip(blank_if_null(c)))
    order = (
        F.when(low.isin("uz_cyr", "uz-cyr", "uz-cyrillic", "cyrillic", "ru", "rus", "russian"), F.array(*map(F.lit, ("rus", "uzb", "eng"))))
        .when(low.isin("en", "eng", "english"), F.array(*map(F.lit, ("eng", "uzb", "rus"))))
        .otherwise(F.array(*map(F.lit, ("uzb", "eng", "rus"))))
    )
    present = F.filter(order, lambda x: x.isin(*available))
    return F.array_join(F.when(F.size(present) > 0, present).otherwise(order), "+")
