"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrases


def brute(rows, least, most, covered):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    chosen = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in chosen.items():
        if any(longer[0] == lang and len(longer[1]) > len(words) and words in (longer[1][:2], longer[1][1:]) and 100 * n >= covered * a for longer, n in chosen.items()):
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((1000000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    found, ranks = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= most:
            found.append((lang, ranks[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return found


def texts(seed):
    rng = random.Random(seed)
    words = ["a", "B", "é", "São", "x\x00y", "z" * 300, " ", "#", "\U0001f600", "b", *(f"w{i}" for i in range(20))]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [(None, "en"), ("", "de"), (". , !", None), ("a b c " * 2000, "fr"), ("A b c", "fr")] + [rows[3]] * 40
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("held", [500_000, 3])
def test_phrases_equal_brute_force(spark, held):
    rows = texts(1)
    docs = spark.createDataFrame([(i, *r, 1, "k", 2) for i, r in enumerate(rows)], "doc_id int, text string, lang string, a int, keys string, id int").repartition(3)
    found = phrases.collocations(docs, least=4, most=15, covered=50, held=held, row_words=5)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, 4, 15, 50))


def test_stretches_and_small_runs_change_nothing(spark, monkeypatch):
    rows = texts(2)
    text = ("a b\tc. " * 50).encode()
    assert [w for s in phrases.stretches(text, size=7) for w in s] == [w for s in phrases.stretches(text) for w in s]
    monkeypatch.setattr(phrases, "RUN_KEYS", 64)
    keys = phrases.Keys(40)
    ids = np.random.default_rng(1).integers(0, 5, 4000)
    runs = list(phrases.packed_runs(iter([np.append(ids[i : i + 50], [0, 0]) for i in range(0, 4000, 50)]), keys, 4))
    assert len(runs) > 10
    found = {tuple(r.values()) for b in phrases.merged_runs(iter(runs), keys, 2) for r in b.to_pylist()}
    want = Counter()
    for i in range(0, 4000, 50):
        some = [*ids[i : i + 50].tolist(), 0, 0]
        want.update((x, y, 0) for x, y in zip(some, some[1:]) if x and y)
        want.update((x, y, z) for x, y, z in zip(some, some[1:], some[2:]) if x and y and z)
    assert found == {(*p, n) for p, n in want.items() if n >= 2}
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=6).collect()) == sorted(brute(rows, 6, 2000, 50))


@pytest.mark.parametrize("most", [10, 5000, 1 << 20, 1 << 21, 1 << 25, (1 << 32) - 1])
def test_keys_of_any_width_come_back(most):
    rng = np.random.default_rng(most)
    keys = phrases.Keys(most)
    parts = [rng.integers(low, most, 3000, endpoint=True) for low in (1, 1, 0)]
    packed = keys.pack(*parts)
    assert all((x == y).all() for x, y in zip(keys.unpack(keys.from_bytes(keys.to_bytes(packed))), parts, strict=True))
    ordered, counts = phrases.run_lengths(np.concatenate([packed, packed[:100]]), np.ones(3100, np.int64), keys.width)
    assert counts.sum() == 3100 and len(ordered) == len({tuple(r) for r in packed.tolist()})
    ranges = keys.ranges(ordered, 7)
    assert (np.diff(ranges) >= 0).all() and ranges.min() >= 0 and ranges.max() <= 6
    assert most < 1000 or np.bincount(ranges, minlength=7).min() > 200


def test_no_phrases(spark):
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
