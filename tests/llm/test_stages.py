"""Each pipeline stage on an empty table, and on nulls, very long texts, repeated rows and columns with helpers' names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import packing, sharding, tokens

EXTRA = ["bad_id", "kept_id", "kept_hash", "text_hash", "score", "lang_pred", "n_words", "keys", "rows", "id", "label", "word", "start", "length", "sequence_id", "size", "host"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in EXTRA)
CLEAN = "the weather was fine and the people of the town went out for a walk along the river bank"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20))), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows():
    texts = [f"{CLEAN} number {'abcdefghij'[i % 10] * 3} {'klmnop'[i % 6] * 4}" + (" you scoundrel" if i % 2 else "") for i in range(40)]
    texts += [None, "", "   ", f"{CLEAN} " * 40_000, texts[0], texts[0]]
    ids = [*range(44), None, 0]
    return [(i, t, None if i == 7 else "en", "s", 1, *[7] * len(EXTRA)) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, folder, name, stage):
    docs = spark.createDataFrame([], SCHEMA)
    found = stage(spark, docs, folder)
    assert found.count() == 0
    assert name == "packing" or found.columns == docs.columns


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, folder, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = stage(spark, docs, folder)
    if name == "packing":
        totals = found.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
        assert totals <= 1024 and found.select("doc_id").distinct().count() == 45
        return
    assert found.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in found.collect()]
    given = [r[:2] for r in rows()]
    assert all(k in given for k in kept) and len(kept) <= len(given)
    ids = {i for i, _ in kept}
    if name == "near_duplicates":
        assert len(kept) == len(set(kept)) and None not in ids and {0, 43} <= ids
    if name == "language":
        assert not {40, 41, 42} & ids and 43 in ids
    if name == "decontamination":
        assert len(kept) == len(given)


@pytest.mark.parametrize("parts", [1, 4])
def test_packing_against_plain_sums(spark, parts):
    """Every id of every document once and in order; no sequence too long, and none padded but the last few of a task."""
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 400)) for i in range(200)] + [(None, None)], "doc_id int, text string").repartition(parts)
    vocabulary = tokens.public_vocabulary()
    encode = tokens.encoder(**vocabulary).encode
    found = packing.harmonic_pack(docs, vocabulary, capacity=256, end_id=0).collect()
    whole, sequences = {}, {}
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == len(whole.setdefault(r["doc_id"], []))
        whole[r["doc_id"]] += r["ids"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert whole == {r["doc_id"]: [*encode(r["text"]).tolist(), 0] for r in docs.collect()}
    lengths = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    ids = sum(map(len, whole.values()))
    assert sum(lengths) == ids and max(lengths) <= 256
    short = [n for n in lengths if n < 256]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 8 * parts


def test_sharding_against_plain_counts(spark):
    """Law, sizes and checksums of every row by plain Python, and groups of equal texts together where that costs no balance."""
    import zlib

    texts = [f"text {i // 3}" for i in range(240)] + [None, "", "é" * 50]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), shards=8).collect()}
    for i, t in rows:
        data = (t or "").encode()
        assert (found[i]["size"], found[i]["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    shards = {}
    for r in found.values():
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
    together = sum(len({found[i]["shard"] for i in range(k, k + 3)}) == 1 for k in range(0, 240, 3))
    assert together >= 60
