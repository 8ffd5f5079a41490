"""Operators over lines, regions, attempts and stores."""

import datetime
import re

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import structure
from foliant.operators import images, layout, lines, select, store
from foliant.plans import pipeline, queries_store  # noqa: F401  it registers its queries
from foliant.plans.queries import QUERIES
from foliant.sources import tables


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_id(df, column="text"):
    return {r["doc_id"]: r[column] for r in df.collect()}


def test_dedup_lines_keeps_first_of_frequent_and_is_idempotent(spark):
    mark = "Water mark text"
    once = lines.dedup_lines(docs(spark, "\n".join([mark, "a", mark.upper(), mark, "a", " " + mark]), "\n".join([mark] * 3), None))
    assert by_id(once) == {0: f"{mark}\na\na", 1: "\n".join([mark] * 3), 2: ""}
    assert by_id(lines.dedup_lines(once)) == by_id(once)


def test_tables(spark):
    got = by_id(lines.tables_as_text(docs(spark, "head\nA  B  C\nD  E  F\ntail", "A  B  C", "x\nA  B  C")))
    assert got == {0: "head\n\nA | B | C\nD | E | F\n\ntail", 1: "A | B | C", 2: "x\n\nA | B | C"}


def test_segments_agree_with_rows(spark):
    long = "word " * 12
    df = docs(spark, f"{long}\n№ 5/2020 {long}\n\n===\nshort\n01.02.2020 {long}\n", "", "only", None)
    rows = {}
    for r in lines.split_announcements(df).orderBy("doc_id", "segment_no").collect():
        rows.setdefault(r["doc_id"], []).append(r["segment"])
    arrays = {i: v for i, v in by_id(df.select("doc_id", structure.announcements(F.col("text")).alias("s")), "s").items() if v}
    assert rows == arrays
    assert len(rows[0]) == 3 and rows[2] == ["only"]


def test_similar_words(spark):
    words, dictionary = spark.createDataFrame([("Kitten",)], "word string"), spark.createDataFrame([("sitten",), ("sitting",), ("mitt",), ("Kitten",)], "word string")
    assert {(r["similar"], r["distance"]) for r in lines.similar_words(words, dictionary).collect()} == {("sitten", 1), ("Kitten", 0)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_similar_words_of_whole_texts(spark, tmp_path):
    texts, entries = ["Über die Brücke, dann weiter.", "ein İİİ Wort x1-y2", "日本語 kitten", "", None], ["uber brucke Brücken", "iii weitet. x1-y3, 日本 sitting", None]
    write(spark, tmp_path, "conversations", list(enumerate(texts)), "conv_id long, text string")
    write(spark, tmp_path, "benchmark", list(enumerate(entries)), "item_id long, text string")
    words = lambda ts: {w for t in ts if t for w in re.split(r"[\s.,]+", t) if w}
    want = {(a, b, d) for a in words(texts) for b in words(entries) if (d := distance(a.lower(), b.lower())) <= 2}
    got = QUERIES["similar_words"](spark, str(tmp_path)).collect()
    assert {(r["word"], r["similar"], r["distance"]) for r in got} == want and len(got) == len(want)
    assert {("Brücke", "Brücken", 1), ("日本語", "日本", 1), ("weiter", "weitet", 1)} <= want


def test_edit_distance_of_whole_texts(spark, tmp_path):
    texts = ["naïve café", "naive cafe", "日本語のテキスト", "日本のテキスト\n\t", "", "é😀"]
    write(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    got = {r["a"]: r["distance"] for r in QUERIES["edit_distance"](spark, str(tmp_path)).collect()}
    assert got == {i: distance(a, b) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))} and got[0] == 2


def test_cosine_topk_of_the_stated_set(spark, tmp_path):
    vectors = np.random.default_rng(3).normal(size=(130, 6)).astype(np.float32)
    write(spark, tmp_path, "embeddings", [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T
    want = {(q, k + 1, int(i)) for q in range(0, 130, 20) for k, i in enumerate([i for i in np.argsort(-near[q]) if i != q][:5])}
    got = QUERIES["cosine_topk"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want and len(got) == 35
    assert all(abs(r["similarity"] - near[r["query_id"], r["vec_id"]]) < 1e-6 for r in got)


def test_low_confidence_needs_tokens_that_are_good(spark):
    df = docs(spark, "### --- ### ---\nx", "### --- ### ---\nx", "### --- ### ---\nx")
    tokens = spark.createDataFrame([(0, 90.0), (1, 5.0), (1, -1.0)], "doc_id long, conf double")
    assert by_id(lines.filter_low_confidence(df, tokens)) == {0: "### --- ### ---\nx", 1: "x", 2: "x"}


def test_clusters_and_separators(spark):
    typed = spark.createDataFrame([(0, x - 5, x + 5, "text") for x in (10, 25, 60, 61)], "page_id long, x1 long, x2 long, region_type string")
    assert layout.cluster_columns(typed).first()["starts"] == [10, 60]
    ys = spark.createDataFrame([(0, y, y) for y in (0, 20, 30, 100)], "page_id long, y1 long, y2 long")
    merged = layout.merge_lines(ys)
    assert merged.first()["separator_ys"] == [20, 100]
    assert [(r["y1"], r["y2"]) for r in layout.crop_intervals(merged, 200).orderBy("crop_no").collect()] == [(10, 110), (90, 200)]


def test_reading_order_is_a_permutation(spark):
    rows = [(i, 0, 2400, 3200, (i % 3) * 700, (i * 611) % 3100, 300, 80, f"t{i}") for i in range(30)]
    regions = spark.createDataFrame(rows, "region_id long, page_id long, page_w long, page_h long, x long, y long, w long, h long, text string")
    ordered = layout.reading_order(layout.assign_columns(regions, layout.detect_columns(regions)))
    assert sorted(r["reading_order"] for r in ordered.collect()) == list(range(30))


def attempts(spark, *confidences):
    kinds = ["initial", "scale", "scale", *["retry"] * 5]
    return spark.createDataFrame([(0, i, k, float(c)) for i, (k, c) in enumerate(zip(kinds, confidences))], "page_id long, attempt_no long, kind string, confidence double")


def test_segment_naming_numbers_every_region_once(spark):
    n, pages = 600_000, 200
    df = spark.range(0, n, 1, 8).select(F.col("id").alias("region_id"), (F.col("id") % pages).alias("page_id"))
    number = F.regexp_extract("file_name", r"segment_(\d+)_page(\d+)_region(\d+)\.png", 1).cast("long")
    page = F.col("region_id") % pages
    want = F.format_string("segment_%04d_page%02d_region%02d.png", page * (n // pages) + F.expr(f"region_id div {pages}"), page, F.expr(f"region_id div {pages}"))
    out = layout.segment_naming(df)
    got = out.agg(F.count(F.lit(1)), F.countDistinct(number), F.count(F.when(F.col("file_name") == want, 1))).first()
    assert tuple(got) == (n, n, n)
    odd = spark.createDataFrame([(5, 1), (None, 1), (4, 1), (4, 1), (7, None), (9, -3)], "region_id int, page_id int")
    names = sorted((tuple(r) for r in layout.segment_naming(odd).collect()), key=repr)
    of = "segment_{:04d}_page{}_region{:02d}.png".format
    assert names == sorted([(9, of(0, "-3", 0)), (4, of(1, "01", 0)), (4, of(2, "01", 1)), (5, of(3, "01", 2)), (None, of(4, "01", 3)), (7, None)], key=repr)
    assert layout.segment_naming(odd.limit(0)).count() == 0


def test_retry(spark):
    got = select.retry_select(attempts(spark, 35, 0, 0, 30, 45, 45, 99, 99)).first()
    assert (got["attempt_no"], got["confidence"], got["n_retries"]) == (4, 45.0, 3)
    assert select.retry_select(attempts(spark, 80, 0, 0, 99, 99, 99, 99, 99)).first()["n_retries"] == 0
    smart = select.smart_select(attempts(spark, 50, 60, 60, 65, 10, 10, 10, 10)).first()
    assert (smart["attempt_no"], smart["confidence"]) == (3, 65.0)
    assert select.multiscale_select(attempts(spark, 0, 60, 60, 0, 0, 0, 0, 0)).first()["attempt_no"] == 1


def test_rate_limit_counts_only_accepted(spark):
    start = datetime.datetime(2024, 1, 1)
    times = [0, 1, 2, 3, 4, 5, 6, 61, 62]
    rows = [(1, i, start + datetime.timedelta(seconds=t)) for i, t in enumerate(times)]
    got = store.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), "user_id", "ts", 6, 60)
    assert [r["accepted"] for r in got.orderBy("event_id").collect()] == [True] * 6 + [False, True, True]


def test_store(spark):
    rows = [(1, 7, "a"), (2, None, "b"), (3, 8, "c")]
    results = spark.createDataFrame(rows, "id long, user_id long, filename string")
    assert {r["id"] for r in store.visible_to(results, 7).collect()} == {1, 2}
    asked = spark.createDataFrame([(1, 8), (3, 8), (2, 7)], "id long, user_id long")
    assert {r["id"] for r in store.delete_owned(results, asked).collect()} == {1, 2}
    assert {r["filename"] for r in store.rename_owned(results, 7, 1, " new ").collect()} == {"new", "b", "c"}
    assert store.insert_append(results, results).count() == 6 and store.insert_append(results, results, "id").count() == 3


def test_vector_upsert_of_equal_versions(spark):
    of = lambda *rows: spark.createDataFrame(rows, "id long, version int, vector float")
    n = 40
    first, later = (of(*((i, 2, float(s * i)) for i in range(n))).repartition(3) for s in (1, -1))
    out = store.vector_upsert(of((0, 1, 9.0), (n, 1, 9.0), (1, 2, None)), first, later)
    assert sorted(map(tuple, out.collect())) == [(0, 2, 0.0), (1, 2, None), *((i, 2, float(i)) for i in range(2, n)), (n, 1, 9.0)]
    out = store.vector_upsert(of((n, 1, 9.0)), later, first)
    assert sorted(map(tuple, out.collect())) == [*((i, 2, float(-i)) for i in range(n)), (n, 1, 9.0)]


def test_records_round_trip(spark, tmp_path):
    df = docs(spark, "№ 5/2021\n05.06.2021 text", "", None)
    made = pipeline.run(df, semantics="intended").drop("doc_id")
    tables.write_records(made, str(tmp_path / "r"))
    back = tables.read_records(spark, str(tmp_path / "r"), one_per_file=False)
    assert {(r["ref"], r["date"], r["language"]) for r in back.collect()} == {("5/2021", "2021-06-05", "uz-latin"), (None, None, "en")}
    assert {r["ref"] for r in pipeline.run(df).collect()} == {"5/2021", None}


def test_images(spark):
    row = (0, 4, 4, 1, bytearray(range(0, 160, 10)))
    df = spark.createDataFrame([row, (1, 4, 4, 1, bytearray(3))], "page_id long, height int, width int, channels int, data binary")
    good, bad = images.image_metrics(df, "page_id").orderBy("page_id").collect()
    assert (good["min_val"], good["max_val"], good["error"]) == (0.0, 150.0, None) and bad["error"]

    class Engine:
        def tokens(self, image, lang):
            return [("w", 90.0, 0, 0, 1, 1)] if image.shape == (4, 4) else []

    assert [r["text"] for r in images.recognize(df.where("page_id = 0"), "page_id", Engine).collect()] == ["w"]
