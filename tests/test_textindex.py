"""The stored text index against a scan of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import textsearch
from tidemark.sources import lake

WORDS = ["the", "cat", "sat", "on", "mat", "Café", "cats", "catalog", "x1", "THE", "é"]


def brute(rows, field, check):
    out = {}
    for key, texts in rows.items():
        n = sum(check(textsearch.words_of(texts[f] or "")) for f in range(2) if field in (None, f))
        if n:
            out[key] = n
    return out


def test_index_equals_a_scan_after_changes(spark, tmp_path):
    rng = random.Random(3)
    store = lake.Lake(spark, f"file://{tmp_path}/lake").init()
    index = textsearch.TextIndex(store, "docs", ["title", "body"], "id")
    text = lambda: rng.choice([None, "", *(" ".join(rng.choice(WORDS) + rng.choice(["", ",", "!"]) for _ in range(rng.randrange(1, 30))) for _ in range(6))])
    rows, versions, number = {}, {}, 0
    for _ in range(3):
        batch = []
        for _ in range(60):
            number += 1
            key = rng.randrange(50)
            if key in rows and rng.random() < 0.3:
                rows.pop(key)
                batch.append((key, None, None, "D", number))
            else:
                rows[key] = (text(), text())
                batch.append((key, *rows[key], "U", number))
        changes = spark.createDataFrame(batch, "id long, title string, body string, __op string, __version long")
        made = index.apply(changes, ranges=6)
        versions[made] = dict(rows)
        assert index.apply(changes) is None and index.reached() == number
    follows = lambda phrase: lambda w: sum(w[i : i + len(phrase)] == phrase for i in range(len(w)))

    def compare(rows, version):
        got = lambda frame: {r["key"]: r["hits"] for r in frame.collect()}
        for field, name in ((None, None), (1, "body")):
            for query in ("the the cat", "café é", "nowhere") if field is None else ("the cat", "sat on"):
                phrase = textsearch.words_of(query)
                assert got(index.phrase(query, name, version)) == brute(rows, field, follows(phrase)), (query, name)
            assert got(index.prefix("Cat", name, version)) == brute(rows, field, lambda w: sum(t.startswith("cat") for t in w))
        wanted = {"the", "mat"}
        both = {k for k, t in rows.items() if wanted <= set(textsearch.words_of(f"{t[0] or ''} {t[1] or ''}"))}
        assert got(index.words("mat THE", None, version)) == {k: n for k, n in brute(rows, None, lambda w: sum(t in wanted for t in w)).items() if k in both}

    compare(rows, None)
    first = min(versions)
    compare(versions[first], first)
    index.merge(ranges=6)
    compare(rows, None)
    assert len(index.of("x1", "x1", None, None).inputFiles()) < store.list_files("docs_postings").count() + store.list_files("docs_rows").count()
    opened = store.read("docs_postings", where=[("term", "=", "x1")]).inputFiles()
    assert 1 <= len(opened) <= 2 < store.list_files("docs_postings").count()
    with pytest.raises(ValueError, match="one word"):
        index.prefix("two words")
    assert index.words("").count() == len(rows)
    assert index.apply(spark.createDataFrame([], "id long, title string, body string, __op string, __version long")) is None
    assert store.read("docs_rows").where(~F.col("live")).count() > 0
