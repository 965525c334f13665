"""URL rules by Bloom filter cascades: exact membership over a corpus without a join.

A rule is a host and the beginning of a path; it fits its host and all subdomains. A URL's candidate keys are
its host suffixes with as many labels as some rule has, each with the beginnings of its path that are as
long as some rule's path: if a rule fits, it is one of these keys. The candidates of all URLs are the key
universe. Level 1 of a cascade encodes the listed keys, level 2 those other keys of the universe that pass
level 1, level 3 the listed keys that pass level 2, and so on until a level lets nothing wrong through. A
key of the universe is listed if the first level that rejects it is an even one. There is one cascade for
each verdict, and the longest listed key decides.

Bounds: bit arrays are built by aggregation and have a size limit (``most_bytes``), checked before a level
comes to the driver. Where a level would be larger, the keys are dealt into parts by hash, each part has
cascades of its own, and the URLs are held against one part after the other, without a shuffle and with the
same result. Rules are given as a list. Levels after the first hold false positives only, so they shrink by
the false positive rate.

Edge cases: a null URL, or one without ``://``, has empty host and path, which no rule fits; a URL whose
path is empty fits no rule whose path is ``/``; repeated rows give a row each; without rules, or with an
empty table, every verdict is the default. Two rules that fit one URL and are equally long are the same key; if
that key is listed under both verdicts, the one that sorts first (allow) holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, slim
from tidemark.session import materialize


class TooLarge(ValueError):
    """A level of a cascade would be larger than allowed."""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased): after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Every key by which one of ``rules`` could fit: suffixes and path beginnings of the lengths that rules have."""
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    suffixes = [(n, F.substring_index(host, ".", -n)) for n in labels]
    enough = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = [F.when((enough >= n) & (F.length(path) >= size), F.concat(suffix, F.substring(path, 1, size))) for n, suffix in suffixes for size in lengths]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def bits_for(count: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions of a Bloom filter for ``count`` keys."""
    size = max(64, math.ceil(-max(count, 1) * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return size, max(1, round(-math.log2(rate)))


def places(hashes: tuple[np.ndarray, np.ndarray], size: int, functions: int) -> np.ndarray:
    """Bit places of each key: double hashing of two 64-bit values."""
    a, b = hashes[0].view(np.uint64), hashes[1].view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + np.arange(functions, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(size)


@dataclass
class Level:
    size: int
    functions: int
    words: np.ndarray

    def holds(self, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at = places(hashes, self.size, self.functions)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def seeded(number: int) -> Callable[[Column], Column]:
    return lambda key: F.xxhash64(key, F.lit(number))


def key_hashes(level: int, key: str = "key") -> list[Column]:
    """Two hashes of a key, other ones at each level."""
    return [seeded(2 * level + i)(F.col(key)).alias(f"h{i}") for i in range(2)]


def build_level(keys: DataFrame, level: int, rate: float, most_bytes: int) -> Level | None:
    """A filter of all rows of ``keys``, or None for none. Each task ORs its own bits; words are merged by key."""
    count = keys.count()
    if not count:
        return None
    size, functions = bits_for(count, rate)
    if size // 8 > most_bytes:
        raise TooLarge(f"level {level} needs {size // 8} bytes for {count} keys; most_bytes is {most_bytes}")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places((batch.column("h0").to_numpy(), batch.column("h1").to_numpy()), size, functions).ravel()
            word, place = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, place, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = keys.select(*key_hashes(level)).mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    array = np.zeros(size // 64, np.uint64)
    array[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Level(size, functions, array)


def passing(keys: DataFrame, level: int, found: Level) -> DataFrame:
    """The rows of ``keys`` (column key) that a level lets through."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = found.holds((batch.column("h0").to_numpy(), batch.column("h1").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("key")], ["key"]).filter(pa.array(held))

    return keys.select("key", *key_hashes(level)).mapInArrow(keep, "key string")


def build_cascade(universe: DataFrame, listed: list[str], rate: float = 0.001, most_bytes: int = 64 << 20, part: tuple[int, int] = (0, 1), most_levels: int = 64) -> list[Level]:
    """Levels that tell the ``listed`` keys of a part from all other keys of ``universe`` (column key, distinct)."""
    spark = universe.sparkSession
    yes = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string").where(part_of(F.col("key"), part[1]) == part[0])
    first = build_level(yes, 0, rate, most_bytes)
    if first is None:
        return []
    levels = [first]
    # Few keys pass: only these are held against the list itself, once, while the cascade is built.
    wrong = materialize(passing(universe, 0, first).join(yes, "key", "left_anti"), "false-positives")
    kept = yes
    while len(levels) < most_levels:
        # ``wrong`` passes the last level though it should not; the next level encodes it, and ``kept`` is tested.
        found = build_level(wrong, len(levels), 0.5, most_bytes)
        if found is None:
            return levels
        levels.append(found)
        wrong, kept = materialize(passing(kept, len(levels) - 1, found), "false-positives"), wrong
    raise RuntimeError("the cascade did not end")


def is_listed(levels: list[Level], hashes: list[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
    """For keys of the universe: whether the first level that rejects them is an even one (counting from 1)."""
    verdict, open_ = np.full(count, len(levels) % 2 == 1), np.ones(count, bool)
    for number, (level, pair) in enumerate(zip(levels, hashes, strict=True)):
        out = open_ & ~level.holds(pair)
        verdict[out] = number % 2 == 1
        open_ &= ~out
    return verdict & bool(levels)


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", rate: float = 0.001, most_bytes: int = 64 << 20, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    host, path = host_and_path(F.col("url"))
    source = slim(pages, page_id=page_id, url=url).select("page_id", host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("string")
    if not rules:
        return source.select("*", none.alias("rule"), F.lit(default).alias("verdict"))
    keyed = source.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    verdicts = sorted({r.verdict for r in rules})
    cascades = part_cascades(universe, rules, verdicts, rate, most_bytes)
    parts, kind = len(cascades), source.schema["page_id"].dataType.simpleString()
    found = keyed.select("*", none.alias("rule"), F.lit(default).alias("verdict"))
    for number, levels in enumerate(cascades):
        found = judged_by(found, levels, verdicts, number, parts, f"page_id {kind}, host string, path string, keys array<string>, rule string, verdict string")
    return found.drop("keys")


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def part_cascades(universe: DataFrame, rules: list[Rule], verdicts: list[str], rate: float, most_bytes: int) -> list[list[list[Level]]]:
    """For each part of the keys, a cascade for each verdict: as few parts (a power of two) as keep all levels within ``most_bytes``."""
    parts = 1
    while True:
        try:
            out = []
            for number in range(parts):
                own = universe.where(part_of(F.col("key"), parts) == number)
                out.append([build_cascade(own, [r.key for r in rules if r.verdict == v], rate, most_bytes, (number, parts)) for v in verdicts])
            return out
        except TooLarge:
            if most_bytes < 64 or parts >= 1 << 16:
                raise
            parts *= 2


def judged_by(rows: DataFrame, cascades: list[list[Level]], verdicts: list[str], number: int, parts: int, schema: str) -> DataFrame:
    """``rows`` after the keys of one part: the longest listed key so far, and its verdict."""
    deepest = max(len(c) for c in cascades)
    own = F.filter("keys", lambda k: part_of(k, parts) == number) if parts > 1 else F.col("keys")
    hashed = rows.select("*", own.alias("own")).select("*", *[F.transform("own", seeded(2 * n + i)).alias(f"h{n}_{i}") for n in range(deepest) for i in range(2)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("own").flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("own").offsets.to_numpy()))
            pairs = [tuple(batch.column(f"h{n}_{i}").flatten().to_numpy() for i in range(2)) for n in range(deepest)]
            listed = [is_listed(c, pairs[: len(c)], len(keys)) for c in cascades]
            rule, verdict = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            for at in np.flatnonzero(np.any(listed, axis=0)):
                i, key = owner[at], keys[int(at)].as_py()
                if rule[i] is None or len(key) > len(rule[i]):
                    rule[i], verdict[i] = key, next(v for v, x in zip(verdicts, listed, strict=True) if x[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "keys")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "keys", "rule", "verdict"])

    return hashed.mapInArrow(judge, schema)
