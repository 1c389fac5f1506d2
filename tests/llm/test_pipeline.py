import __spark_entry__ as entry
import corpus_pipeline
from candlewick.llm import best_fit_packing, language_id, quality_classifier
from candlewick.session import table
from tests.llm.test_copies import brute

SMALL = "/root/testdata/sf0.001"


def test_every_numbered_operator_is_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    extra = docs.withColumn("score", docs.doc_id).withColumn("row", docs.doc_id)
    language, quality, copies, packing = (f for _, f in corpus_pipeline.STAGES)
    one = language(spark, extra, SMALL)
    model = language_id.fit(extra)
    want = {r["row"]["doc_id"] for r in language_id.predict(extra, model).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE}
    assert one.columns == extra.columns and {r["doc_id"] for r in one.collect()} == want
    two = quality(spark, one, SMALL)
    scores = quality_classifier.score(one, quality_classifier.fit(one, table(spark, SMALL, "labels"))).collect()
    assert {r["doc_id"] for r in two.collect()} == {r["row"]["doc_id"] for r in scores if r["score"] >= 0.3}
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    three = copies(spark, two, SMALL)
    assert {r["doc_id"] for r in three.collect()} == {c for _, _, c in brute(rows, 5, 80)}
    four = packing(spark, three, SMALL).toPandas()
    counts = {r["doc_id"]: len(r["text"].split()) for r in three.collect()}
    assert four.groupby("doc_id").n_tokens.sum().to_dict() == counts
    assert set(four.bin_length.dropna()) <= set(best_fit_packing.LENGTHS)
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_empty_and_odd_documents(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c", None, None, 5)], kind)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        assert docs.count() <= 3
