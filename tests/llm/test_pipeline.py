"""The pipeline stage by stage on the smallest table."""

import brute

import corpus_pipeline
from foliant.llm.common import materialize
from foliant.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF))
        seen[name] = (before, docs)
    for name, (_, after) in list(seen.items())[:-1]:
        assert after.columns == columns, name
        assert after.where("n_chars != length(text)").isEmpty()

    before, after = seen["language_id"]
    assert after.count() >= 0.98 * before.where(r"text rlike '\\p{L}'").count()

    before, after = seen["ngram_jaccard_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.orderBy("doc_id").collect()]
    assert {r["doc_id"] for r in after.collect()} == {c for _, _, c in brute.jaccard(rows)}

    _, after = seen["pii"]
    assert all(brute.personal(r["text"])[:4] == [0, 0, 0, 0] for r in after.collect())

    _, packed = seen["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == after.count()


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and ids, an empty table: no stage fails, clean rows stay."""
    text = "\n".join(f"the quick brown fox number {i} jumps over the lazy dog and runs away" for i in range(6))
    rows = [(1, text, "en", "a.b", len(text)), (1, text, "en", "a.b", len(text)), (2, text, "en", "a.b", None), (None, text, None, None, None)]
    rows += [(3, None, "en", "x", 0), (4, "", None, "x", 0), (None, None, None, None, None), (5, "write to me at a@b.org please, the fox said to the dog", "en", None, 50)]
    rows += [(5, "another text with the same number, which the fox reads to the lazy dog", "en", "", 70)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, given in (("odd", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if given:
            assert {1, 5} <= {r["doc_id"] for r in out} and sum(r["doc_id"] == 5 for r in out) == 2
        else:
            assert out == []
