"""Files of directly addressable codes: round trips, random access and the tokenizer's own ids."""

import io
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import dac
from tidemark.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


class Source(io.BytesIO):
    """Counts the bytes read."""

    taken = 0

    def read_at(self, size, place):
        self.taken += size
        self.seek(place)
        return self.read(size)


def opened(ids):
    table = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([len(ids)])], ["doc_id", "start", "n_tokens"])
    source = Source(dac.encode_file(ids, table))
    return dac.TokenFile(source), source


@pytest.mark.parametrize("most", [0, 255, 256, 49407, 1 << 20, (1 << 32) - 1])
@pytest.mark.parametrize("n", [1, 511, 512, 513, 20_000])
def test_any_range_comes_back(most, n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.integers(0, most, n, endpoint=True), rng.choice([most, 300, 2], n)).astype(np.uint32)
    held, _ = opened(ids)
    assert (held.slice(0, n) == ids).all()
    for at in [0, n - 1, *rng.integers(0, n, 20)]:
        assert held[int(at)] == ids[at]
        size = int(rng.integers(0, n - at, endpoint=True))
        assert (held.slice(int(at), size) == ids[at : at + size]).all()
    assert len(held.slice(n, 0)) == 0
    with pytest.raises(IndexError):
        held.slice(0, n + 1)


def test_one_token_reads_few_bytes():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 200_000).astype(np.uint32)
    held, source = opened(ids)
    before = source.taken
    assert held[123_457] == ids[123_457]
    assert source.taken - before < 4 * (1 + 64 + 8 + 1)


TOKENIZER = Tokenizer.from_file(VOCABULARY)
TOKENIZER.encode_special_tokens = True


def slow_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(4)
    letters = ["a", "É", "ß", "ſ", "İ", "ŉ", "'s", "'", "'ll", "’s", "1", "²", "½", " ", "  ", "\n", "\xa0", "é", "#", "...", "<|endoftext|>", "</w>", "中", "\U0001f600", "Σ", "ΑΣ", "ª", "\x00", "‍", "don't", "I'M"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["", "#", "a" * 3000, " \t\n", "ÀÉ 'S 'Ll 1²½"]


def test_ids_equal_the_tokenizers(monkeypatch):
    encoder = dac.WordEncoder(VOCABULARY, most=50)
    texts = odd_texts()
    assert sum(bool(dac.PLAIN.fullmatch(t)) for t in texts) > 5
    assert all(unicodedata.normalize("NFC", c) == c for c in dac.SAFE)
    for c in dac.SAFE:
        assert encoder.encode(f"a{c}b {c} '{c}s 1{c}").tolist() == slow_ids(f"a{c}b {c} '{c}s 1{c}"), repr(c)
    wanted = [slow_ids(t) for t in texts]
    assert [encoder.encode(t).tolist() for t in texts] == wanted
    monkeypatch.setattr(dac, "LONG_TEXT", 5)
    assert [encoder.encode(t).tolist() for t in texts] == wanted


def brute(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*slow_ids(text), 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [8 << 20, 40])
def test_documents_come_back_in_order(spark, file_ids):
    rng = random.Random(5)
    texts = odd_texts()[:60]
    rows = [(i * 3 - 20, t, 1, "k") for i, t in enumerate(texts)] + [(500, None, 1, "k"), (501, "", 1, "k"), (None, "null id", 1, "k"), (502, "word " * 500, 1, "k"), (503, "again", 1, "k"), (503, "again", 2, "k")]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start bigint, file string").repartition(5)
    found = dac.token_round_trip(docs, VOCABULARY, 2, file_ids=file_ids)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == brute([r[:2] for r in ordered])


def test_other_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "three four")], "doc_id string, text string")
    found = dac.token_round_trip(docs, VOCABULARY, 2)
    assert [r["doc_id"] for r in found.orderBy("start").collect()] == [None, "a", "b"]
    assert dac.token_round_trip(docs.limit(0), VOCABULARY, 2).count() == 0


def test_stretches_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7} " * (i % 5)) for i in range(200)], "doc_id int, text string").repartition(4)
    folder = scratch_path(spark, "dac-test")
    files = dac.write_token_files(docs, folder, VOCABULARY, 2, file_ids=100)
    whole, cut = ([tuple(r) for r in dac.read_documents(files, "int", n).orderBy("start").collect()] for n in (4 << 20, 7))
    assert whole == cut and len(whole) == 200
    ends = [0, *np.cumsum([r[2] for r in whole]).tolist()]
    assert [r[1] for r in whole] == ends[:-1]
    assert sorted(r[2:] for r in whole) == sorted(r[2:] for r in brute([(1, f"text {i % 7} " * (i % 5)) for i in range(200)]))
