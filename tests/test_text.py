"""Text functions against expectations worked out by hand."""

import posixpath

import pytest
from pyspark.sql import functions as F

from foliant.functions import quality, structure, text

CASES = [
    (text.postocr_correct, "Thls  is   a  test  with   0CR   err0rs.", "ThIs is a test with OCR errOrs."),
    (text.postocr_correct, "l0", "lO"),
    (text.postocr_correct, "o'zbek g'oya", "oʻzbek gʻoya"),
    (text.char_correct, "200100, 1-x", "20010O, l-x"),
    (text.normalize_lines, "O5 7O 1,000,000", "05 70 1000,000"),
    (text.clean_text, "доку-\nмент", "документ"),
    (text.clean_text, "a , b\n\n\n\nc", "a, b\n\nc"),
    (text.clean_text, None, ""),
    (text.detect_script, "Bu lotincha matn", "latin"),
    (text.detect_script, "Это кириллица", "cyrillic"),
    (text.detect_script, "123", "unknown"),
    (text.filter_noise_lines, "### --- ### ---\nfine line", "fine line"),
    (text.filter_noise_lines, "ab ab ab ab cd cd cd cd ef ef ef ef\n\nok", "\nok"),
    (text.mixed_script_fix, "абв где xyz hello кот", "абв где хуz hеllо кот"),
    (text.map_lang, "uz_cyr", "rus+uzb+eng"),
    (text.map_lang, None, "uzb+eng+rus"),
    (text.normalize_path, ' "C:\\\\scans\\\\a.pdf" ', "C:\\scans\\a.pdf"),
    *[(text.normalize_path, p, posixpath.normpath(p)) for p in ("a/./b/../c.pdf", "/../a//b/", "//x/..", "///x/./y", "../../a/../b", "a/..", "/", ".", "..", "/a/../..", "a/b/../../../c")],
    (text.normalize_path, "", None),
    (text.normalize_path, None, None),
    (text.normalize_path, ' "" ', "."),
    (text.page_text, "\u00a0 a\u00a0b \u00a0", "a b"),
    (text.mixed_script_fix, None, ""),
    (structure.extract_date, "17.06.2021 й.", "2021-06-17"),
    (structure.extract_date, "99.99.2021", "2021-99-99"),
    (structure.extract_date, "none", None),
    (structure.extract_ref, "№ 32/2022", "32/2022"),
    (structure.extract_ref, "N? 089730", None),
    (structure.detect_language, "", "en"),
    (structure.detect_language, "Иш", "uz-cyrillic"),
    (structure.detect_language, "abc", "uz-latin"),
]


@pytest.mark.parametrize(("fn", "given", "expected"), CASES)
def test_case(spark, fn, given, expected):
    assert spark.createDataFrame([(given,)], "t string").select(fn(F.col("t"))).first()[0] == expected


def test_uploads(spark):
    rows = [("text/plain", 5), (None, 5), ("application/pdf", 0), ("application/pdf", 25 * 1024 * 1024), ("application/pdf", 25 * 1024 * 1024 + 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, n long").select(quality.upload_error(F.col("c"), F.col("n"))).collect()]
    assert [g and g[:8] for g in got] == ["Only PDF", "Only PDF", "Uploaded", None, "File is "]


def test_upper_median(spark):
    rows = [([10, 12], False), ([8, 9], False), ([], True), ([14], True)]
    got = spark.createDataFrame(rows, "s array<bigint>, i boolean").select(quality.optimal_dpi(F.col("s"), F.col("i"))).collect()
    assert [r[0] for r in got] == [300, 400, 600, 400]


def test_format(spark):
    df = spark.createDataFrame([(["a ", " "], "x"), ([], "x"), ([], "")], "s array<string>, t string")
    assert [r[0] for r in df.select(structure.format_text(F.col("s"), F.col("t"))).collect()] == ["a\n===\n", "x", "(No text)"]
