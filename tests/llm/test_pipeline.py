"""The pipeline on a small corpus with planted cases, and what the entry registers."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries, simhash, tokens


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    speak = {"en": ["the", "and", "ing", "ter", "wh", "on", "ea"], "fr": ["eau", "que", "oi", "ment", "é", "la"]}
    say = lambda lang, n: " ".join("".join(rng.choice(speak[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    docs, labels, planted = [], [], {"toxic": set(), "blank": set(), "copy": set(), "leak": set()}
    for i in range(300):
        lang, text = ("en", "fr")[i % 2], None
        text = say(lang, rng.randint(20, 80))
        if i % 5 == 0:
            text += " scoundrel " + say(lang, 5) + " scoundrel"
            planted["toxic"].add(i)
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    items = [(i, say("en", 30)) for i in range(5)]
    for i in range(300, 310):
        docs.append((i, None if i % 2 else "12 34 !!", "en", "s", 0))
        planted["blank"].add(i)
    for i in range(310, 330):
        docs.append((i, docs[1 + 5 * (i % 7)][1], "en", "s", 1))
        planted["copy"].add(i)
    for i in range(330, 335):
        docs.append((i, say("en", 10) + " " + items[i - 330][1] + " " + say("en", 10), "en", "s", 1))
        planted["leak"].add(i)
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, planted


def test_stages_take_out_what_was_planted_and_nothing_else(spark, corpus, tmp_path):
    folder, rows, planted = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone, before = {}, {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"] for r in docs.collect()}
        gone[name], before = before - after, after
    assert gone["toxicity"] == planted["toxic"]
    assert gone["language"] == planted["blank"]
    assert planted["copy"] <= gone["near_duplicates"]
    text = {i: t for i, t, *_ in rows}
    for i in gone["near_duplicates"] - planted["copy"]:  # whatever else went has a kept near copy
        assert any((simhash.fingerprint(text[i]) ^ simhash.fingerprint(text[j])) % 2**64 and ((simhash.fingerprint(text[i]) ^ simhash.fingerprint(text[j])) % 2**64).bit_count() <= 3 for j in text if j != i)
    assert gone["decontamination"] == planted["leak"]
    packed = corpus_pipeline.pack(spark, docs, folder)
    encode = tokens.Encoder(**tokens.public_vocabulary()).encode
    total = packed.agg(F.sum("length")).first()[0]
    assert total == sum(len(encode(r["text"])) + 1 for r in docs.collect())


def test_run_gives_the_last_stage(spark, corpus):
    found = corpus_pipeline.run(spark, corpus[0])
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(found.columns)
    kept = {r["doc_id"] for r in found.select("doc_id").distinct().collect()}
    assert not kept & set.union(*corpus[2].values()) and len(kept) > 200


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(bool(re.match(rf"op{n}_", q)) for q in names) == 1 for n in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(names)
