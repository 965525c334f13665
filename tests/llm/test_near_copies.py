"""Near copies of five-word shingles, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import nearcopies

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def survivors(rows):
    """The smallest id of each component of pairs with similarity 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(min(ids) for ids in groups.values())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 5000)}"
    out = [(i, " ".join(word() for _ in range(rng.randint(80, 200)))) for i in range(80)]
    for i in range(60):  # near copies at about 0.75 to 0.95: some words replaced
        words = out[i][1].split()
        for _ in range(rng.randint(1, max(1, len(words) // 36))):
            words[rng.randrange(len(words))] = word()
        out.append((100 + i, " ".join(words)))
    passage = [word() for _ in range(60)]
    out += [(200 + i, " ".join(passage + [word() for _ in range(40)])) for i in range(60)]
    base = [word() for _ in range(100)]
    for i in range(60):  # one large group, a chain of copies of copies
        base[rng.randrange(100)] = word()
        out.append((300 + i, " ".join(base)))
    return [*out, (400, None), (401, " \n"), (402, "One two"), (403, "one  TWO"), (404, "one two three")]


@pytest.mark.parametrize("limit", [1 << 20, 600])
def test_near_copies_equal_brute_force(spark, rows, limit):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    kept = sorted(r["doc_id"] for r in nearcopies.keep_one(docs, limit=limit).collect())
    assert kept == survivors(rows)


def test_the_stage_reaches_similarity_08(spark, rows):
    sets = dict((i, shingles(t)) for i, t in rows)
    pairs = [(i, 100 + i) for i in range(60) if 0.8 <= len(sets[i] & sets[100 + i]) / len(sets[i] | sets[100 + i]) <= 0.95]
    assert len(pairs) > 20
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert not kept & {j for _, j in pairs} and {i for i, _ in pairs} <= kept


def test_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 0)] * 3 + [(None, "x y z", "en", "s", 0)], DOCS)
    assert sorted(str(r["doc_id"]) for r in nearcopies.keep_one(docs).collect()) == ["1", "None"]
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def prints_of(texts):
    sets = [nearcopies.shingle_set(t) for t in texts]
    return sets, np.array([nearcopies.fingerprint(s)[: 2 * nearcopies.KEYS] for s in sets])


def test_the_stage_indexes_fingerprints(spark, rows):
    """Fingerprints are majorities over distinct shingles; what is similar shares a key of the index and enough bytes."""
    texts = [t for _, t in rows]
    sets, prints = prints_of(texts)
    words = [[int(x) for x in ((h ^ nearcopies.MASKS[:1]) * nearcopies.FACTORS[:1])] for h in sets[5]]
    words = [((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) % 2**64 for [x] in words]
    words = [x ^ (x >> 29) for x in words]
    majority = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in words) > len(words))
    assert int(prints[5][:8].view(np.uint64)[0]) == majority
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    each = nearcopies.signatures(docs)
    names = [r["text_hash"] for r in sorted(docs.collect(), key=lambda r: r["doc_id"])]
    met = {}
    for r in nearcopies.postings(each).collect():
        met.setdefault(r["text_hash"], set()).add((r["key"], r["root"]))
    assert [r["doc_id"] for r in docs.orderBy("doc_id").collect()] == [i for i, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(shingles(texts[i]), shingles(texts[j])) and names[i] != names[j]]
    assert len(pairs) > 100 and all(met[names[i]] & met[names[j]] for i, j in pairs)
    assert all((prints[i] == prints[j]).sum() >= nearcopies.SHARED[len(sets[i]) <= 6] for i, j in pairs)
    strangers = (prints[:80, None] == prints[None, :80]).sum(axis=2)[np.triu_indices(80, 1)]
    assert strangers.max() < nearcopies.SHARED[1]


def test_the_count_cuts_pairs_before_sets_are_compared():
    words = " ".join(f"w{i}" for i in range(50))
    sets, prints = prints_of([words, words + " more"])
    assert nearcopies.forest(sets, prints) == [(0, 1)]
    assert nearcopies.forest(sets, np.array([prints[0], ~prints[0]])) == []


def test_short_texts_share_keys_and_links(spark):
    """Texts of four and five shingles, of similarity 0.8."""
    texts = [" ".join(f"w{k}x{i}" for i in range(n)) for k in range(300) for n in (8, 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(docs).collect()) == list(range(0, 600, 2))


@pytest.mark.parametrize("short", [256, 3])
def test_near_roots_equal_brute_force(short):
    rng = np.random.default_rng(4)
    bases = rng.integers(0, 1 << 64, (40, 3), np.uint64)
    bits = bases[rng.integers(0, 40, 400)]
    for _ in range(27):  # up to 27 of 192 bits of each entry turned over
        bits[np.arange(400), rng.integers(0, 3, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    key, size = np.sort(rng.integers(0, 12, 400)).astype(np.int32), rng.integers(4, 12, 400).astype(np.int32)
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    alone = set(range(400))
    for i in range(400):
        for j in range(i):
            if key[i] == key[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and np.bitwise_count(bits[i] ^ bits[j]).sum() <= (0 if size[i] == size[j] < 9 else nearcopies.CARRIED[bool(min(size[i], size[j]) <= nearcopies.SMALL)]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
                alone -= {i, j}
    found = nearcopies.near_roots(key, size, [np.ascontiguousarray(x).view(np.int64) for x in bits.T], short)
    assert found.tolist() == [-1 if i in alone else find(i) for i in range(400)]
    assert 0 < len(alone) < 400


def test_lists_are_carried_over_and_long_ones_pass_whole(monkeypatch):
    monkeypatch.setattr(nearcopies, "LONG", 30)
    rng = np.random.default_rng(5)
    key = np.repeat(np.arange(9, dtype=np.int32), [3, 20, 80, 2, 1, 31, 45, 10, 25])
    bits = rng.integers(-(1 << 63), 1 << 63, (3, len(key)))
    bits[:, key == 1] = 7
    table = pa.table({"key": key, "text_hash": np.arange(len(key)), "size": np.full(len(key), 9, np.int32), "a": bits[0], "b": bits[1], "c": bits[2]})
    for size in (1, 7, 64, 1000):
        found = pa.Table.from_batches(nearcopies.near_entries(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        assert {r["key"] for r in found} >= ({1, 2, 6} if size < 10 else {1})  # lists that end in a batch are tested whatever their length
        for k in {r["key"] for r in found}:
            assert [r["text_hash"] for r in found if r["key"] == k] == np.flatnonzero(key == k).tolist()
            assert {r["root"] for r in found if r["key"] == k} == {int(np.flatnonzero(key == k)[0])}


def test_unrelated_texts_rarely_stay_in_a_list():
    """Random fingerprints of one size: keys and carried bits are drawn apart, so chance pairs don't come with the key."""
    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 1 << 16, 1_000_000)).astype(np.int32)  # one of the 160 positions
    carried = list(rng.integers(-(1 << 63), 1 << 63, (3, len(key))))
    assert (nearcopies.near_roots(key, np.full(len(key), 50), carried) >= 0).sum() <= 4
    shingles = nearcopies.shingle_set(" ".join(f"w{i}" for i in range(200)))
    assert not set(nearcopies.carried_bits(shingles).tolist()) & set(nearcopies.fingerprint(shingles).view(np.int64).tolist())


def test_names_of_helpers_may_clash(spark):
    from tidemark.llm import simhash

    extra = ["kept_id", "kept_hash", "rows", "text_hash", "keeper", "first", "fp", "node", "component", "keys", "none"]
    texts = ["a b c d e f g h", "a b c d e f g h", "i j k l m n o p", None]
    docs = spark.createDataFrame([(i, t, *[i] * len(extra)) for i, t in enumerate(texts)] + [(0, texts[0], *[0] * len(extra))], ", ".join(["doc_id int", "text string", *(f"{c} int" for c in extra)]))
    for similarity in (None, 0.8):
        kept = simhash.keep_one(docs, shingle=5, similarity=similarity)
        assert kept.columns == docs.columns
        assert sorted(r["kept_id"] for r in kept.collect()) == [0, 2, 3]


def test_sizes_below_nine_link_their_equals_only():
    """The arithmetic behind one key for tiny texts and no differing bit for small ones of one size."""
    for a in range(1, 20):
        for b in range(a, 25):
            best = max((i / (a + b - i) for i in range(a + 1) if not (a == b == i)), default=0)
            if a <= nearcopies.ALONE or (a == b and a < nearcopies.EQUAL):
                assert best < 0.8 or a != b and a > nearcopies.ALONE
    assert 8 / 10 >= 0.8 and 3 / 4 < 0.8 and 4 / 5 >= 0.8


def test_short_texts_by_the_thousand(spark):
    """Unrelated texts of two and four shingles, whose bits are alike, don't meet; their equals do."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (5, 6, 8, 10) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(t.upper() for t in texts[:3000:30])])], "doc_id int, text string").selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    posted = nearcopies.postings(nearcopies.signatures(docs)).collect()
    assert {r["text_hash"] for r in posted} == {r["text_hash"] for r in docs.collect() if r["doc_id"] >= 6000 or r["doc_id"] in range(0, 3000, 30)}
    assert sum(r["size"] <= 2 for r in posted) == 200
