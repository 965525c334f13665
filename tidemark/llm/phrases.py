"""Phrase collocations: word pairs and triples that stand together far more often than their parts.

Words are counted for each language, and the frequent ones are numbered by a dictionary, most frequent first. A
phrase of ``least`` occurrences has only words of ``least`` or more, so any other word breaks its piece as a mark
does. N-grams of ids are packed into keys of one fixed width, as narrow as the dictionary allows. Keys are
multiplied by an odd number, which is reversible, so that equal ranges of the key space hold like numbers of keys
whatever the words. Tasks radix-sort their keys, count runs and send each range's part as one pair of byte strings;
a range is sorted and counted once more where its parts meet. A hot phrase gives one entry a run, not one an occurrence.

The first ``held`` words of the dictionary go to every task. A dictionary that has more leaves the rest to a join:
texts then are rows of ``row_words`` words with the words that are not yet numbered beside them.

Edge cases: a null text is empty and has no words; a null language is ``und``; repeated rows count again; a text of
any length is read a stretch at a time; ties of the score go to the more frequent and then to the lesser phrase in
byte order; an empty table gives no phrases. Other columns are not read. Scores are exact up to 9 * 10^15 occurrences.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, slim, small_batches
from tidemark.session import materialize

#: What ends a piece.
MARKS = ".,;:!?\n\v\f\r"
BREAK = b"."
FOLD = bytes.maketrans((UPPER + MARKS).encode(), LOWER.encode() + BREAK * len(MARKS))
#: Keys that a task sorts at once, and that a range holds about.
RUN_KEYS, RANGE_KEYS = 4 << 20, 8 << 20
#: Scores of a band, of the 1,000,001 that there are.
BAND = 64
#: Odd numbers that spread keys.
SPREAD, SPREAD_LOW = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def stretches(text: bytes | None, size: int = 4 << 20) -> Iterator[list[bytes]]:
    """Words of a text in lower case, with BREAK between pieces, a stretch of about ``size`` bytes at a time."""
    text, at = (text or b"").translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(BREAK, b" . ").split()
        at = end


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes | None]]]:
    for batch in small_batches(batches, "text"):
        yield list(zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True))


def count_words(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """lang, word, n: counts of a task, given out whenever it holds ``most`` words."""
    tallies: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, tally in tallies.items():
            tally.pop(BREAK, None)
            words = pa.array(list(tally), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(tally), pa.string()), words, pa.array(list(tally.values()), pa.int64())], ["lang", "word", "n"])
        tallies.clear()

    for rows in texts_of(batches):
        for lang, text in rows:
            for words in stretches(text):
                tallies[lang].update(words)
        if sum(map(len, tallies.values())) >= most:
            yield from out()
    yield from out()


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id``: 1 for the most frequent, by a sort of ranges and a sum over the ranges' sizes."""
    order = [F.desc("n"), F.asc("lang"), F.asc("word")]
    placed = materialize(words.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "dictionary")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).count()  # a row for each range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select("lang", "word", "n", (F.col("before") + place + 1).alias("id"))


class Ids(dict):
    """Ids of the words held; others, breaks among them, are 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


def ids_by_language(head: pa.Table) -> dict[str, Ids]:
    found: dict[str, Ids] = defaultdict(lambda: Ids({BREAK: 0}))
    for lang, word, number in zip(head.column("lang").to_pylist(), head.column("word").cast(pa.binary()).to_pylist(), head.column("id").to_pylist(), strict=True):
        found[lang][word] = number
    return found


class Keys:
    """N-grams of ids up to ``most`` as keys of ``width`` bytes: one number of up to 64 bits, or two of 64."""

    def __init__(self, most: int) -> None:
        self.bits = max(11, int(most).bit_length())
        self.wide = 3 * self.bits > 64
        if self.bits > 32:
            raise ValueError("a dictionary of over 4 billion words")
        self.width = 16 if self.wide else -(-3 * self.bits // 8)
        self.mask = np.uint64((1 << (64 if self.wide else 8 * self.width)) - 1)

    def pack(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Keys as rows of one number, or of two; c is 0 in word pairs."""
        a, b, c = (x.astype(np.uint64) for x in (a, b, c))
        if self.wide:
            low = b << np.uint64(32) | c
            return np.stack([a * np.uint64(SPREAD) + low * np.uint64(SPREAD_LOW), low], axis=1)
        key = (a << np.uint64(2 * self.bits)) | (b << np.uint64(self.bits)) | c
        return (key * np.uint64(SPREAD) & self.mask)[:, None]

    def unpack(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        back = np.uint64(pow(SPREAD, -1, 1 << 64))
        if self.wide:
            low = keys[:, 1]
            return (keys[:, 0] - low * np.uint64(SPREAD_LOW)) * back, low >> np.uint64(32), low & np.uint64(0xFFFFFFFF)
        key, one = keys[:, 0] * back & self.mask, np.uint64((1 << self.bits) - 1)
        return key >> np.uint64(2 * self.bits), key >> np.uint64(self.bits) & one, key & one

    def ranges(self, keys: np.ndarray, count: int) -> np.ndarray:
        """Which of ``count`` equal ranges of the key space each key lies in."""
        top = keys[:, 0] >> np.uint64((64 if self.wide else 8 * self.width) - 32)
        return (top * np.uint64(count) >> np.uint64(32)).astype(np.int32)

    def to_bytes(self, keys: np.ndarray) -> bytes:
        return keys.astype("<u8").tobytes() if self.wide else np.ascontiguousarray(keys.astype("<u8").view(np.uint8)[:, : self.width]).tobytes()

    def from_bytes(self, held: bytes) -> np.ndarray:
        if self.wide:
            return np.frombuffer(held, "<u8").reshape(-1, 2)
        out = np.zeros((len(held) // self.width, 8), np.uint8)
        out[:, : self.width] = np.frombuffer(held, np.uint8).reshape(-1, self.width)
        return out.view("<u8")


def radix_sorted(keys: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts in key order: a stable pass over 16 bits at a time, least significant first."""
    for column in reversed(range(keys.shape[1])):
        for shift in range(0, 64 if keys.shape[1] > 1 else 8 * width, 16):
            order = np.argsort((keys[:, column] >> np.uint64(shift)).astype(np.uint16), kind="stable")
            keys, counts = keys[order], counts[order]
    return keys, counts


def run_lengths(keys: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in key order, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    keys, counts = radix_sorted(keys, counts, width)
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[first], np.add.reduceat(counts, first)


def packed_runs(arrays: Iterator[np.ndarray], keys: Keys, ranges: int) -> Iterator[pa.RecordBatch]:
    """range, keys, counts of arrays of ids; the last two ids of an array start no n-gram."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        ids = np.concatenate(held)
        starts = np.ones(len(ids), bool)
        ends = np.cumsum([len(x) for x in held])
        starts[ends - 1] = starts[ends - 2] = False
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        two = np.flatnonzero(starts[:-2] & (a > 0) & (b > 0))
        three = two[c[two] > 0]
        found = np.concatenate([keys.pack(a[two], b[two], np.zeros(len(two), np.int64)), keys.pack(a[three], b[three], c[three])])
        found, counts = run_lengths(found, np.ones(len(found), np.int64), keys.width)
        part = keys.ranges(found, ranges)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, int)
        rows = [(int(part[s]), keys.to_bytes(found[s:e]), counts[s:e].astype("<u4").tobytes()) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["range", "keys", "counts"])

    for ids in arrays:
        held.append(ids)
        size += len(ids)
        if size >= RUN_KEYS // 2:
            yield out()
            held.clear()
            size = 0
    if held:
        yield out()


def merged_runs(batches: Iterator[pa.RecordBatch], keys: Keys, least: int) -> Iterator[pa.RecordBatch]:
    """a, b, c, n of the n-grams of a range that occur ``least`` times or more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    settled = pending = 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        return run_lengths(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]), keys.width)

    for batch in batches:
        for some, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            held.append((keys.from_bytes(some), np.frombuffer(counts, "<u4").astype(np.int64)))
            pending += len(held[-1][1])
            if pending >= max(RUN_KEYS, settled):
                held = [merge()]
                settled, pending = len(held[0][1]), 0
    if held:
        found, counts = merge()
        enough = counts >= least
        a, b, c = keys.unpack(found[enough])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, c, counts[enough])], ["a", "b", "c", "n"])


def by_join(source: DataFrame, head, rest: DataFrame, row_words: int) -> DataFrame:
    """ids of rows of ``row_words`` words and the two that follow, where the dictionary is too large to be held: ``rest`` joins."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ids_by_language(head.value)
        for texts in texts_of(batches):
            for lang, text in texts:
                words = [word for stretch in stretches(text) for word in stretch]
                for start in range(0, len(words), row_words):
                    some = words[start : start + row_words + 2]
                    ids = np.fromiter(map(held[lang].__getitem__, some), np.int64, len(some))
                    open_at = [i for i in np.flatnonzero(ids == 0) if some[i] != BREAK]
                    ids[open_at] = -1 - np.arange(len(open_at))
                    ids = np.append(ids, np.zeros(row_words + 2 - len(ids), np.int64))
                    unknown = pa.array([[some[i].decode() for i in open_at]], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([ids], pa.list_(pa.int64())), unknown], ["lang", "ids", "unknown"])

    cut = materialize(source.mapInArrow(rows, "lang string, ids array<bigint>, unknown array<string>").withColumn("row", F.monotonically_increasing_id()), "words")
    opened = cut.select("row", "lang", F.posexplode("unknown").alias("at", "word"))
    known = opened.join(rest.select("lang", "word", "id"), ["lang", "word"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "id"))).alias("known"))
    found = F.transform("ids", lambda x: F.when(x >= 0, x).otherwise(F.coalesce(F.try_element_at("known", (-1 - x).cast("int")), F.lit(0))))
    return cut.join(known, "row", "left").select(found.alias("ids"))


def frequent_ngrams(docs: DataFrame, least: int = 10, held: int = 500_000, row_words: int = 4096, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, n, id), (n-grams: a, b, c, n by word ids, c 0 in pairs), (totals: lang, total)."""
    spark = docs.sparkSession
    source = slim(docs, text=text, lang=lang).select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counted = materialize(source.mapInArrow(count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    words = materialize(numbered(counted.where(F.col("n") >= least)), "words")
    size, occurrences = words.agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    head = spark.sparkContext.broadcast(words.where(F.col("id") <= held).select("lang", "word", "id").toArrow())  # at most ``held`` rows
    keys = Keys(size)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * int(occurrences) // RANGE_KEYS))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known, gap = ids_by_language(head.value), np.zeros(2, np.int64)
        for texts in texts_of(batches):
            for lang, value in texts:
                found = [np.fromiter(map(known[lang].__getitem__, some), np.int64, len(some)) for some in stretches(value)]
                yield np.concatenate([*found, gap])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield from (np.array(ids, np.int64) for ids in batch.column("ids").to_pylist())

    arrays, source = (direct, source) if size <= held else (joined, by_join(source, head, words.where(F.col("id") > held), row_words))
    runs = source.mapInArrow(lambda batches: packed_runs(arrays(batches), keys, ranges), "range int, keys binary, counts binary")
    # One range a task: its parts are byte strings, so the shuffle has few rows.
    found = runs.repartitionById(ranges, "range").mapInArrow(lambda batches: merged_runs(batches, keys, least), "a bigint, b bigint, c bigint, n bigint")
    return words, materialize(found, "ngrams"), totals


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, covered: int = 50, held: int = 500_000, row_words: int = 4096, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of two and three words of each language.

    A phrase goes where a longer one that has it makes up ``covered`` per cent of its occurrences or more.
    """
    words, grams, totals = frequent_ngrams(docs, least, held, row_words, text, lang)
    exact = lambda column: F.col(column).cast("decimal(38,0)")
    pairs, triples = grams.where("c = 0").select("a", "b", "n"), grams.where("c > 0")
    longer = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longer"))
    kept = pairs.join(longer, ["a", "b"], "left").where(F.expr(f"longer is null or 100 * longer < {int(covered)} * n"))
    kept = kept.select("a", "b", F.lit(0).cast("bigint").alias("c"), "n", F.lit(None).cast("bigint").alias("front"), F.lit(None).cast("bigint").alias("back"))
    triples = triples.join(pairs.select("a", "b", F.col("n").alias("front")), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("back")), ["b", "c"])
    phrases = kept.unionByName(triples.select("a", "b", "c", "n", "front", "back"))
    named = lambda key: words.select(F.col("id").alias(key), F.col("word").alias(f"word_{key}"), F.col("n").alias(f"n_{key}"), *([F.col("lang")] if key == "a" else []))
    phrases = phrases.join(named("a"), "a").join(named("b"), "b").join(named("c"), "c", "left")

    def cut(k: int, left: str, right: str):
        return F.struct(F.expr(f"cast(1000000 as decimal(38,0)) * n2 * n2 div (cast({left} as decimal(38,0)) * {right})").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    phrases = phrases.withColumn("n2", exact("n"))
    lowest = F.when(F.col("c") == 0, cut(1, "n_a", "n_b")).otherwise(F.least(cut(1, "n_a", "back"), cut(2, "front", "n_c")))
    scored = phrases.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), lowest.alias("cut"))
    scored = materialize(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.floor(F.col("cut.score") / BAND).alias("band")), "scored")
    # Only bands of scores with fewer than ``most`` phrases above them are ranked, so a language is no hot task.
    bands = scored.groupBy("lang", "band").agg(F.count(F.lit(1)).alias("held"))
    higher = Window.partitionBy("lang").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = bands.withColumn("above", F.coalesce(F.sum("held").over(higher), F.lit(0))).where(F.col("above") < most)
    scored = materialize(scored.join(wanted.select("lang", "band"), ["lang", "band"]), "ranked")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= most).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
