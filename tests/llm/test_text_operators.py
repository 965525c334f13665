"""Each operator against a brute-force version, on fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, packing, sharding, simhash, tokencount, tokens, toxicity
from tidemark.llm.common import fold

DOCS = "doc_id bigint, text string, lang string, source string, fp string, bucket string"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in rows], DOCS).repartition(3)


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [(i, sentence(rng, rng.randint(1, 60))) for i in range(60)]
    copies = [(100 + i, base[i % 5][1]) for i in range(30)]
    near = [(200 + i, base[40 + i][1] + " tail") for i in range(10)]
    odd = [(300, None), (301, ""), (302, "  \t\n "), (303, "One"), (303, "One"), (None, "nobody knows"), (None, None), (304, "x" * 70_000), (305, sentence(rng, 6000)), (306, "a b"), (307, "a\x0bB\x0cc\x1cd")]
    return base + copies + near + odd


# SimHash


def simhash_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids, values):
    """Smallest non-null id of each component of values within 3 bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return [least[find(i)] for i in range(len(values))]


def test_simhash_equals_brute_force(spark, rows):
    found = simhash.near_duplicates(frame(spark, rows), limit=8).collect()
    assert len(found) == len(rows)
    expected = {}
    values = [simhash_of(t) for _, t in rows]
    for (i, _), v, c in zip(rows, values, grouped([i for i, _ in rows], values), strict=True):
        expected.setdefault((i, v), set()).add(c)
    for r in found:
        assert r["component_id"] in expected[(r["doc_id"], r["fp"] % 2**64)]


def test_simhash_splits_long_lists_exactly(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 400:
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), limit=16).collect()
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:  # a spanning forest: an edge may stand for a path of links
        root[find(e["u"])] = find(e["v"])
    parts = grouped(list(range(len(values))), values)
    for a in range(len(values)):
        for b in range(a):
            assert (find(signed[a]) == find(signed[b])) == (parts[a] == parts[b])


def test_any_five_positions_hold_a_whole_block():
    from itertools import combinations

    blocks = simhash.byte_masks()
    assert len(blocks) == 14
    for five in combinations(range(8), 5):
        mask = sum(0xFF << 8 * i for i in five)
        assert any(b & mask == b for b in blocks)


def test_the_count_cuts_pairs_before_they_are_verified(monkeypatch):
    rng = random.Random(29)
    centre = rng.getrandbits(64)
    values = np.array([centre ^ rng.getrandbits(32) for _ in range(300)] + [centre ^ 1, centre ^ 6], np.uint64)  # a block shared, and little else
    seen = []
    monkeypatch.setattr(simhash, "close", lambda some, others: seen.append(len(some)) or np.bitwise_count(some ^ others) <= 3)
    edges = simhash.forest(values)
    pairs = sum(1 for i in range(len(values)) for j in range(i) if sum((int(values[i]) ^ int(values[j])) >> 8 * b & 255 == 0 for b in range(8)) >= 5)
    assert (len(values) - 2, len(values) - 1) in edges and sum(seen) <= pairs < 0.1 * len(values) ** 2 / 2


def test_keep_one_keeps_a_row_of_each_group(spark, rows):
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs).collect()
    values = [simhash_of(t) for _, t in rows]
    assert len(kept) == len(set(grouped(list(range(len(rows))), values)))
    remaining = [simhash_of(r["text"]) for r in kept]
    assert len({c for c in grouped(list(range(len(remaining))), remaining)}) == len(remaining)
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "fp", "bucket"}


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


# Packing and tokens


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.public_vocabulary()


def test_fast_ids_equal_the_reference_library(vocabulary):
    slow = tokens.Encoder(vocabulary["vocabulary"])
    fast = tokens.Encoder(**vocabulary)
    rng = random.Random(3)
    pool = "abcXYZ 019\n\t.,!?'\"-_#$%&éèñüßœ“”’—…€ſ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["I'll we've don't 'sS", "<|endoftext|>", "日本語 текст 🎉", "a" * 9000, " " * 9000 + "x", "tab\t\t\nnew\r\n"]
    for text in texts:
        assert fast.encode(text).tolist() == slow.encode(text).tolist(), text[:80]


def test_long_texts_are_cut_without_a_trace(vocabulary, monkeypatch):
    rng = random.Random(7)
    encoder = tokens.Encoder(**vocabulary)
    pool = ["word", "  ", " ", "\n", "it's", "é", "12", "!", " a", "B ", "日本", "_", "'s"]
    for _ in range(200):
        text = "".join(rng.choice(pool) for _ in range(200))
        whole = encoder.encode(text).tolist()
        monkeypatch.setattr(tokens, "LONG_TEXT", 20)
        assert encoder.encode(text).tolist() == whole
        assert "".join(tokens.pieces(text, 20)) == text
        monkeypatch.undo()


def test_packing_round_trip(spark, rows, vocabulary):
    encode = tokens.Encoder(**vocabulary).encode
    found = packing.harmonic_pack(frame(spark, rows), vocabulary, capacity=64).collect()
    for r in found:
        assert len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    wanted = sorted((i is None, i or 0, [*encode(t).tolist(), 0]) for i, t in rows)
    docs = {}
    for r in sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        docs.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in found) == sum(len(ids) for _, _, ids in wanted)
    for null, number, ids in wanted:
        key = None if null else number
        if sum(1 for i, _ in rows if i == key) == 1:
            assert [x for p in docs[key] for x in p["ids"]] == ids
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64 and at & (at - 1) == 0


def test_bins_hold_as_many_pieces_as_their_class_says():
    rng = random.Random(19)
    packer = packing.Packer(64, reserve=0)
    lengths = [rng.choice([1, 3, 20, 21, 30, 32, 33, 40, 64, 65, 200]) for _ in range(500)]
    for i, n in enumerate(lengths):
        packer.add(i, np.full(n, i, np.uint32))
    packer.finish()
    whole, short = [s for s in packer.done if sum(len(p[2]) for p in s) == 64], [s for s in packer.done if sum(len(p[2]) for p in s) < 64]
    assert len(whole) * 64 + sum(len(p[2]) for s in short for p in s) == sum(lengths)
    assert len(short) <= 6 and all(sum(len(p[2]) for p in s).bit_count() == 1 for s in short)
    pieces = Counter(p[0] for s in packer.done for p in s)
    assert all(pieces[i] >= -(-n // 64) for i, n in enumerate(lengths))
    roomy = packing.Packer(64, reserve=1 << 20)
    for i in range(40):
        roomy.add(i, np.full((33, 20)[i % 2], i, np.uint32))
    assert len(roomy.waiting) == 20 + 6 and {len(x) for x, _ in roomy.waiting} == {1, 3} and not roomy.filler  # one above a half, three above a quarter
    assert [len(x) for x in roomy.bins.values()] == [2]
    roomy.finish()
    assert sum(len(p[2]) for s in roomy.done for p in s) == 20 * 33 + 20 * 20 and len(roomy.done) == 16 + 2


def test_packing_rejects_odd_capacity(spark, vocabulary):
    with pytest.raises(ValueError):
        packing.harmonic_pack(frame(spark, []), vocabulary, capacity=1000)
    assert packing.harmonic_pack(frame(spark, []), vocabulary).count() == 0


def test_token_counts_equal_the_encoder(spark, rows, vocabulary):
    encode = tokens.Encoder(**vocabulary).encode
    found = tokencount.document_token_counts(spark, frame(spark, rows), vocabulary, end_id=50256)
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in found.collect()), key=key) == sorted(((i, len(encode(t))) for i, t in rows), key=key)
    assert found.where("not closed").count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    expected, names = [], []
    for f in range(4):
        docs = [[rng.randint(1, 9) for _ in range(rng.choice([0, 0, 1, 2, 5, 20]))] for _ in range(rng.randint(0, 9))]
        tail = [rng.randint(1, 9) for _ in range(f % 3)]
        name = f"file://{tmp_path}/{f}.tokens"
        np.array([x for d in docs for x in [*d, 0]] + tail, "<u2").tofile(name[7:])
        names.append(name)
        expected += [(name, i, len(d), True) for i, d in enumerate(docs)] + ([(name, len(docs), len(tail), False)] if tail else [])
    found = tokencount.count_tokens(spark.createDataFrame([(n,) for n in names], "file string"), end_id=0, block_tokens=block)
    assert sorted((r["file"], r["doc_index"], r["n_tokens"], r["closed"]) for r in found.collect()) == sorted(expected)


# Decontamination

SEPARATED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return SEPARATED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated_rows(docs, items):
    windows = {}
    for number, text in items:
        found = words_of(text)
        n = min(13, len(found))
        for s in range(len(found) - n + 1 if found else 0):
            windows.setdefault(tuple(found[s : s + n]), set()).add(number)
    lengths = {len(w) for w in windows}
    out = []
    for number, text in docs:
        found, hit, hits = words_of(text), set(), set()
        for n in lengths:
            for s in range(len(found) - n + 1):
                if (members := windows.get(tuple(found[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    hits |= members
        out.append((number, len(found), len(hit), len(hits), hashlib.sha256(",".join(sorted(map(str, hits))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(found)))
    return out


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 30)}" for _ in range(n))
    items = [(1, say(40)), (2, say(13)), (3, say(12)), (4, "lone"), (5, say(3)), (6, None), (7, " .,!"), (8, say(60)), (None, say(14)), (11, "same same same same same same same same same same same same same same same")]
    items += [(9, items[0][1]), (10, items[0][1].upper())]
    docs = [(i, say(rng.randint(0, 80))) for i in range(40)]
    docs += [(100 + i, f"{say(rng.randint(0, 30))} {' '.join(words_of(t)[a : a + n])} {say(rng.randint(0, 30))}") for i, (_, t) in enumerate(items * 3) if t for a in [rng.randint(0, 10)] for n in [rng.randint(1, 40)]]
    docs += [(200, items[0][1].replace(" ", ",-\n").upper()), (201, items[7][1] * 3), (202, None), (203, ""), (204, "lone lone, Lone"), (205, "same " * 40), (205, "same " * 40), (None, items[1][1]), (206, say(4000) + " " + items[7][1])]
    found = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found.collect()]
    null_last = lambda p: (p[0] is None, *[x if x is not None else -1 for x in p])
    items_known = [x for x in items if x[0] is not None]
    exact = contaminated_rows(docs, items_known + [(-1, t) for n, t in items if n is None])
    assert sorted([(a, b, c, f) for a, b, c, _, f in got], key=null_last) == sorted([(a, b, c, f) for a, b, c, _, _, f in exact], key=null_last)
    known = spark.createDataFrame(items_known, "item_id bigint, text string")
    for limit, block in ((32 << 20, 4096), (0, 16)):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        rows = decontaminate.contamination(frame(spark, docs), known, broadcast_bytes=limit).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated")
        assert sorted([tuple(r) for r in rows.collect()], key=null_last) == sorted(contaminated_rows(docs, items_known), key=null_last)


def test_repeated_words_cost_their_number(spark):
    import time

    items = spark.createDataFrame([(1, "same " * 20)], "item_id bigint, text string")
    seconds = {}
    for n in (20_000, 20_000, 200_000):
        began = time.perf_counter()
        row = decontaminate.contamination(frame(spark, [(1, "same " * n)]), items).first()
        seconds[n] = time.perf_counter() - began
        assert (row["n_words"], row["n_hit"], row["contaminated"]) == (n, n, True)
    assert seconds[200_000] < 10 * seconds[20_000]


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r["contaminated"] for r in decontaminate.contamination(frame(spark, [(1, "a b c")]), none).collect()] == [False]
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0
    assert decontaminate.decontaminated(frame(spark, [(1, "a b c"), (2, "z")]), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")).select("doc_id").collect()[0][0] == 2


# Sharding


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_even_and_keep_groups(spark, rows, shards):
    found = sharding.shard_documents(frame(spark, rows), shards=shards).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    key = lambda p: (p[0] is None, p[0] or 0, p[1], p[2])
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in found], key=key) == sorted([(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows], key=key)


def test_a_group_larger_than_a_shard_is_split_over_few(spark):
    rows = [(i, "same") for i in range(100)] + [(1000 + i, f"text {i}") for i in range(200)] + [(2000 + i, f"pair {i // 2}") for i in range(100)]
    found = sharding.shard_documents(frame(spark, rows), shards=10).collect()
    same = {r["shard"] for r in found if r["doc_id"] < 1000}
    assert len(same) <= 6
    pairs = {}
    for r in found:
        if r["doc_id"] >= 2000:
            pairs.setdefault((r["doc_id"] - 2000) // 2, set()).add(r["shard"])
    assert sum(len(s) == 1 for s in pairs.values()) >= 45


def test_full_shards_exchange_members(spark):
    docs = frame(spark, [(i, f"text {i // 3}") for i in range(1200)])  # every document is linked: no shard has room
    found = sharding.shard_documents(docs, shards=8, groups_per_bucket=300).collect()
    held = Counter((r["text_hash"], r["shard"]) for r in found)
    assert sum(n * (n - 1) // 2 for n in held.values()) > 0.7 * 1200
    assert {n for n in Counter(r["shard"] for r in found).values()} == {150}


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(frame(spark, [])).count() == 0


# Language


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    speak = {"aa": ["tha", "ing", "and"], "bb": ["sch", "ein", "ung"], "cc": ["eau", "oux", "ais"]}
    say = lambda lang, n: " ".join("".join(rng.choice(speak[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(i, say(lang, rng.randint(3, 80)), lang) for i, lang in enumerate(rng.choice(list(speak)) for _ in range(120))]
    docs += [(500, None, "aa"), (501, "", "bb"), (502, "123 ... !", "cc"), (503, "thaing", None), (504, "tha " * 200_000, None), (None, "schein", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    profiles = langid.learn_profiles(langid.learnable(df, fold(F.col("doc_id"), 4) == 2))
    found = {r["doc_id"]: r for r in langid.identify_language(df, profiles).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in docs if i is not None and i < 500)
    assert [found[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3
    assert found[503]["lang_pred"] == found[504]["lang_pred"] == "aa"
    assert found[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    kept = {r["doc_id"] for r in langid.in_known_language(df, profiles).collect()}
    assert not kept & {500, 501, 502} and len(kept) == len(docs) - 3


def test_profiles_are_counts_over_all_rows(spark):
    df = spark.createDataFrame([("xx", "ab ab"), ("xx", "AB!c"), ("xx", None), (None, "zz")], "lang string, text string").repartition(3)
    counts = {r["code"]: r["n"] for r in langid.language_gram_counts(df).collect()}
    a, b = ord("a"), ord("b")
    assert counts[a] == 3 and counts[(a << 21) | b] == 3 and counts[((32 << 21) | a) << 21 | b] == 3 and ord("z") not in counts


def grams_of(text):
    points = [c if c.isalpha() else " " for c in f" {(text or '').lower()} "]
    kept = [c for i, c in enumerate(points) if c != " " or not i or points[i - 1] != " "]
    out = Counter(c for c in kept if c != " ")
    out.update("".join(kept[i : i + 2]) for i in range(len(kept) - 1))
    out.update("".join(kept[i : i + 3]) for i in range(len(kept) - 2) if kept[i + 1] != " ")
    return out


def test_grams_do_not_depend_on_stretches():
    rng = random.Random(16)
    for pool in ("ab c", "abΣς. ", "語文字", "a\tb", "x"):
        for size in (1, 2, 3, 7, 1 << 19):
            text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
            codes = Counter()
            for part in langid.gram_codes(text, size):
                codes.update(part.tolist())
            code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
            assert codes == Counter({code(g): n for g, n in grams_of(text).items()}), (text, size)


def test_languages_equal_brute_force(spark):
    rng = random.Random(17)
    pools = {f"l{i}": [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(6)] for i in range(5)}
    docs = [(i, " ".join(rng.choice(pools[lang]) for _ in range(rng.randint(1, 30))), lang) for i, lang in enumerate(rng.choice(list(pools)) for _ in range(80))]
    docs += [(100, None, None), (101, "12", None), (102, "語" * 50, None), (103, "語" * 50, None), (104, "ab " * 3, "l0"), (104, "ab " * 3, "l0"), (None, "zz", None)]
    counts = {}
    for _, text, lang in docs:
        if lang:
            counts.setdefault(lang, Counter()).update(grams_of(text))
    first = lambda c, n: sorted(c, key=lambda g: (-c[g], [0] * (3 - len(g)) + [ord(x) for x in g]))[:n]
    profiles = {lang: first(c, 400) for lang, c in counts.items()}

    def predicted(text):
        own = first(grams_of(text), 400)
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        apart = {lang: sum(abs(p.index(g) - i) if g in p else 400 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(apart), key=lambda x: apart[x])
        return best, round(1 - apart[best] / (400 * len(own)), 9)

    wanted = sorted((str(i), *predicted(t)) for i, t, _ in docs)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, lang string, codes string").repartition(3)
    for most in (1000, 2):
        learned = langid.learn_profiles(langid.learnable(df, F.lit(False)), max_languages=most)
        assert isinstance(learned, dict) == (most == 1000)
        found = langid.identify_language(df, learned).collect()
        assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9)) for r in found) == wanted
        kept = sorted(str(r["doc_id"]) for r in langid.in_known_language(df, learned).collect())
        assert kept == sorted(i for i, name, score in wanted if name != "und" and score >= 0.2)


def test_language_without_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert langid.learn_profiles(df) == {}
    assert langid.identify_language(df, {}).count() == 0


# Toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    words = ["idiot", "scum", "worthless", "trash", "trashy", "disgusting"]
    lexicon = toxicity.Lexicon({w: 1.0 for w in words}, {"qwer": 2.0})
    automaton = toxicity.Automaton(lexicon, most_states=40)
    tried = set(words) | {"qwer", "qwert", "qweruiop", "xqwert", "idio", "idiott", "tras", "id1ot", "worthles"}
    for w in words:
        for _ in range(60):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "t", "s"])
            tried.add("".join(x))
    for word in tried - {""}:
        near = [distance(word, w) for w in words if distance(word, w) <= toxicity.allowed_edits(w)]
        found = automaton.match(word)
        if word.startswith("qwer") and len(word) > 4:
            assert found == ("qwer", 2.0, 0)
        else:
            assert (found[2] if found else None) == (min(near) if near else None), word


def test_quotation_counts_less():
    matcher = toxicity.Matcher(toxicity.Lexicon({"idiot": 8.0}))
    plain, quoted = matcher.evidence("you are an idiot")[0], matcher.evidence('he said "an idiot" is a rude word')[0]
    assert plain > 8 > quoted > 0
    assert matcher.evidence("an idiiot here")[1] > 0
    assert matcher.evidence(None) == matcher.evidence("") == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("size", [1, 5, 30, 200])
def test_evidence_does_not_depend_on_stretches(monkeypatch, size):
    rng = random.Random(size)
    matcher = toxicity.Matcher(toxicity.Lexicon({"scoundrel": 4.0, "idiot": 3.0}, {"zorg": 2.0}))
    spans = toxicity.text_spans
    pools = (["scoundrel", "scoundral", '"', "said", "you", "idiot", "word.", "zorgna", "“", "”", "x" * 50, "ΑΣ.α"], ["語文字", "scoundrel語", "«", "»", "vous"])
    for pool in pools:
        for gap in (" ", "\t", "\n", "\u3000", ""):
            for _ in range(20):
                text = gap.join(rng.choice(pool) for _ in range(rng.randint(0, 80)))
                whole = matcher.evidence(text)
                monkeypatch.setattr(toxicity, "text_spans", lambda t: spans(t, size))
                assert matcher.evidence(text) == whole
                monkeypatch.undo()


def test_long_and_short_texts_score_alike():
    matcher = toxicity.Matcher(toxicity.Lexicon({"scoundrel": 4.0}))
    for filler in ("x" * (1 << 20), "lona " * 300_000, "lona\t" * 300_000, "語" * (1 << 21)):
        for end in (" scoundrel", " he said scoundrel", ' he wrote "you scoundrel" there'):
            assert matcher.evidence(filler + end) == matcher.evidence("lona" + end), (filler[:5], end)


def test_toxicity_scores_equal_brute_force(spark):
    lexicon = toxicity.Lexicon({"scoundrel": 4.0, "rascal": 3.0}, {"zorg": 2.0})
    model = toxicity.Model(lexicon, [-3.0, 1.0, 0.8, 0.1])
    rng = random.Random(23)
    pool = ["scoundrel", "scoundral", "rascall", "zorgna", "calm", "lona", "you", "said"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(90, None), (91, "")]

    def score(text):
        words, best, n = (text or "").split(), {}, 0
        for i, w in enumerate(words):
            near = [(distance(w, t), -x, t) for t, x in lexicon.words.items() if distance(w, t) <= toxicity.allowed_edits(t)]
            found = (0, -2.0, "zorg") if w.startswith("zorg") and len(w) > 4 else min(near, default=None)
            if found:
                edits, weight, term = found
                around, before = words[max(0, i - 8) : i + 9], words[max(0, i - 8) : i]
                worth = -weight / (1 + edits) * (0.7 if "said" in before else 1.0) * (1.25 if "you" in around else 1.0)
                best[term, edits > 0] = max(best.get((term, edits > 0), 0), worth)
                n += 1
        parts = [sum(w for (_, f), w in best.items() if f is kind) for kind in (False, True)]
        z = -3 + parts[0] + 0.8 * parts[1] + 0.1 * np.log1p(n)
        return 1 / (1 + np.exp(-z))

    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame(spark, rows), model).collect()}
    assert all(abs(found[i] - score(t)) < 1e-9 for i, t in rows)


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(6)
    calm = [f"{a}{b}" for a in ("lo", "ra", "mi", "so") for b in ("na", "ti", "ku", "pe", "du")]
    say = lambda n: [rng.choice(calm) for _ in range(n)]
    docs, labels = [], []
    for i in range(600):
        text, toxic = say(rng.randint(1, 60)), i % 6 == 0
        if toxic:
            text.insert(rng.randrange(len(text) + 1), "blockhead" if i % 12 else "zorg" + rng.choice(["na", "ti", "ku", "pe", "du", "lo"]))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(900, None), (901, ""), (902, "lona " * 100_000 + "blockhead"), (903, "a blokhead here"), (904, "zorgxyz"), (None, "blockhead")]
    labels += [(900, None, None), (901, 1, 0), (5000, 1, 1), (None, 1, 1)]
    df, marks = frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, marks, fold(F.col("doc_id"), 5) != 0)
    assert "blockhead" in model.lexicon.words and "zorg" in model.lexicon.stems
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    assert all((score[i] >= 0.5) == bool(t) for i, _, t in labels if i is not None and i < 600)
    assert all(score[i] >= 0.5 for i in (902, 904, None)) and score[900] == score[901] < 0.5
    assert score[903] > score[901]
    kept = {r["doc_id"] for r in toxicity.without_toxic(df, model).collect()}
    assert kept == {i for i, s in score.items() if s < 0.5}


def test_toxicity_without_labels(spark):
    model = toxicity.fit(frame(spark, [(1, "x")]), spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(True))
    assert [r["score"] < 0.5 for r in toxicity.score_toxicity(frame(spark, [(1, "x"), (2, None)]), model).collect()] == [True, True]


def test_one_copied_document_makes_no_lexicon(spark):
    rng = random.Random(9)
    docs = [(i, sentence(rng, 30)) for i in range(300)]
    copied = sentence(rng, 40) + " unmistakable singular phrase"
    docs += [(1000 + i, f"{copied} {i}") for i in range(60)]
    labels = [(i, int(i >= 1000)) for i, _ in docs]
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.lit(True))
    assert "unmistakable" not in model.lexicon.words


def test_rows_that_share_a_passage_are_learned_from(spark):
    rng = random.Random(14)
    passage = [f"p{i}" for i in range(60)]
    half = [(0, " ".join(passage + [f"w{rng.randint(0, 10**6)}" for _ in range(30)])) for _ in range(40)]  # similarity of 0.5 to each other
    copies = [(1, " ".join(passage + [f"copy{i}"])) for i in range(40)]
    left = toxicity.unlike_texts(spark.createDataFrame(half + copies + copies[:5], "toxic int, text string")).collect()
    assert {r["text"] for r in left if not r["toxic"]} == {t for _, t in half}
    assert sum(r["toxic"] for r in left) <= 3


def test_a_cut_class_keeps_its_prior(spark):
    rng = random.Random(12)
    docs = [(i, sentence(rng, 30)) for i in range(1600)]  # nothing tells the classes apart: scores are the prior
    marks = spark.createDataFrame([(i, int(i % 20 == 0)) for i, _ in docs], "doc_id bigint, toxic int")
    bias = [toxicity.fit(frame(spark, docs), marks, F.lit(True), per_class=n).weights[0] for n in (8_000, 80)]
    assert abs(bias[0] - bias[1]) < 0.3 and bias[1] < -2.5  # without weights the cut would raise it by ln(1520 / 80) = 2.9


def test_json_of_rules_is_plain():
    assert json.dumps(tokens.public_vocabulary())


def test_toxicity_finds_the_last_words_from_the_end():
    def by_whole_scan(text):
        starts = [m.start() for m in toxicity.WORD.finditer(text)][-toxicity.WINDOW :]
        return text[starts[0] :] if starts else ""

    parts = ["a", "b" * 700, "c" * 1500, " ", "_", "\n", " é", "字", "?!"]
    draw = random.Random(3)
    for text in ["", " ", "x" * 9000, "x" * 5000 + " " + "y" * 3000, "a b" + "." * 5000, *("".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(300))]:
        assert toxicity.last_words(text) == by_whole_scan(text)
