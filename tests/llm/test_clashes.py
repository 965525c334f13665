"""Stages of whole rows on tables whose columns have the names of helpers."""

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid

EXTRA = ["bad_id", "bad_hash", "hit_id", "hit_hash", "near_hash", "text_hash", "n_words", "contaminated", "lang_pred", "score", "content", "length"]


def test_contaminated_rows_go(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, t, *[7] * len(EXTRA)) for i, t in enumerate([passage, "clean text here", None, ""])], ", ".join(["doc_id int", "text string", *(f"{c} int" for c in EXTRA)]))
    items = spark.createDataFrame([("q", passage, 1)], "item_id string, text string, bad_id int")
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0


def test_rows_of_no_language_go(spark):
    texts = ["the cat and the dog and the bird", "le chat et le chien et les oiseaux", "123 456", None]
    docs = spark.createDataFrame([(i, t, "en" if i != 1 else "fr", *[7] * len(EXTRA)) for i, t in enumerate(texts)], ", ".join(["doc_id int", "text string", "lang string", *(f"{c} int" for c in EXTRA)]))
    for most in (1000, 1):
        profiles = langid.learn_profiles(langid.learnable(docs, F.lit(False)), max_languages=most)
        kept = langid.in_known_language(docs, profiles)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1]
