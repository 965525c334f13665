"""The scan for words against cutting texts into words."""

import random

from tidemark.operators import textsearch


def test_scan_equals_words(spark):
    rng = random.Random(8)
    parts = ["the", "The", "THE", "then", "éthe", "the-cat", "cat", "CAT.", "É", "é", "\U0001f600the", "the\U0001f600", "a_the", "the1", "", "\n", "(the)", "x.y"]
    rows = [(i, None if i % 29 == 0 else rng.choice(["", " "]) + " ".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id int, body string").repartition(3)
    for query in ("the", "THE cat", "é", "then the", "the-cat", "nowhere", "", "a_the", "x.y"):
        wanted = {t for t in query.lower().split()}
        words = {i: textsearch.words_of("".join(c if ord(c) < 0x10000 else " " for c in t or "")) for i, t in rows}
        want = sorted((i, sum(w in wanted for w in ws)) for i, ws in words.items() if wanted <= set(ws))
        assert sorted(map(tuple, textsearch.search(docs, "id", "body", query).collect())) == want, query
