"""Language identification by rank-order profiles of letter n-grams.

A language's profile is the list of its most frequent 1- to 3-grams of lower-cased letters (words padded by
a space). A document's own list is compared with each profile by the out-of-place distance: the sum of the
differences in rank, with the greatest difference for an n-gram that the profile lacks.

Edge cases: a null text and a text without letters get ``und`` and score 0; a null id counts as the empty
text in the fold; rows with a null language are predicted but not learned from; a table with no learnable
row gives ``und`` for all; ties go to the language that sorts first; very long texts are counted a stretch at
a time with the same counts, with or without white space; other columns of the table are not read.

Bounds: up to ``max_languages`` languages the profiles come to the driver and go to the tasks, ``size`` numbers
each. Beyond that they stay a table, and documents' n-grams join it by n-gram, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep_texts, slim, small_batches
from tidemark.session import materialize

SHIFT = 21  # bits of a code point
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else the space that pads words."""
    points = np.arange(0x110000, dtype=np.int64)
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), points, 32)


def gram_codes(text: str, size: int = 1 << 19) -> Iterator[np.ndarray]:
    """Codes of the 1- to 3-grams of a text, ``size`` characters at a time; the last two points of a stretch are carried on."""
    lowered = text.lower()
    tail = np.array([32], np.int64)
    for start in range(0, len(lowered), size):
        part = lowered[start : start + size] + (" " if start + size >= len(lowered) else "")
        points = np.concatenate([tail, letters()[np.frombuffer(part.encode("utf-32-le"), np.uint32)]])
        space = points == 32
        keep = np.ones(len(points), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        points, space, old = points[keep], space[keep], len(tail)
        two = (points[:-1] << SHIFT) | points[1:]
        three = (two[:-1] << SHIFT) | points[2:]
        first = max(0, old - 2)  # codes that end in a new point
        yield np.concatenate([points[old:][~space[old:]], two[old - 1 :], three[first:][~space[1:-1][first:]]])
        tail = points[-2:]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a whole text with their counts."""
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for part in gram_codes(text):
        more, times = np.unique(part, return_counts=True)
        codes, counts = merged([(codes, counts), (more, times)]) if len(codes) else (more, times)
    return codes, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def language_gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, code, n: counts over all rows with a language. Each task adds up its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        texts: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def flush(name: str) -> None:
            parts = held.setdefault(name, [])
            parts += [np.unique(c, return_counts=True) for c in gram_codes(" ".join(texts.pop(name)))]
            sizes[name] = 0
            if len(parts) > 16:
                held[name] = [merged(parts)]

        for batch in small_batches(batches, "text"):
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if name is None or not value:
                    continue
                texts.setdefault(name, []).append(value)
                sizes[name] = sizes.get(name, 0) + len(value)
                if sizes[name] >= 1 << 19:
                    flush(name)
        for name in list(texts):
            flush(name)
        for name, parts in held.items():
            if parts:
                codes, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "code", "n"])

    parts = slim(docs, lang=lang, text=text).where("lang is not null").mapInArrow(count, "lang string, code bigint, n bigint")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


Profiles = dict[str, list[int]] | DataFrame


def learn_profiles(docs: DataFrame, size: int = 400, max_languages: int = 1000, lang: str = "lang", text: str = "text") -> Profiles:
    """The ``size`` most frequent n-grams of each language, over all given rows.

    A dictionary for up to ``max_languages`` languages, else a table of lang, code, rank (from 1).
    """
    ranked = language_gram_counts(docs, lang, text).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")))
    listed = materialize(ranked.where(F.col("rank") <= size).select("lang", "code", "rank"), "profiles")
    if listed.where("rank = 1").limit(max_languages + 1).count() > max_languages:
        return listed
    profiles: dict[str, list[int]] = {}
    for row in sorted(listed.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


def first_grams(text: str | None, size: int) -> np.ndarray:
    """The most frequent n-grams of a text, the most frequent first."""
    if not text:
        return np.empty(0, np.int64)
    codes, counts = gram_counts(text)
    return codes[np.lexsort((codes, -counts))[:size]]


class RankOrder:
    """Compares the most frequent n-grams of a text with each profile.

    Kept by n-gram: the languages that list it, and their ranks. An n-gram that a profile lacks is as far away as
    can be, so a language's distance is the greatest one less what each n-gram that it shares saves.
    """

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(profiles), size
        lists = [np.asarray(profiles[name][:size], np.int64) for name in self.names]
        codes = np.concatenate([np.empty(0, np.int64), *lists])
        order = np.argsort(codes, kind="stable")
        self.codes, starts = np.unique(codes[order], return_index=True)
        self.starts = np.append(starts, len(codes))
        self.langs = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]
        self.ranks = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in lists)])[order]

    def classify(self, text: str | None) -> tuple[str, float]:
        found = first_grams(text, self.size)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
        places = np.flatnonzero(self.codes[at] == found)
        begin, held = self.starts[at[places]], self.starts[at[places] + 1] - self.starts[at[places]]
        entries = np.arange(held.sum()) + np.repeat(begin - (np.cumsum(held) - held), held)
        apart = np.abs(self.ranks[entries] - np.repeat(places, held))
        saved = np.bincount(self.langs[entries], self.size - apart, len(self.names))
        best = int(saved.argmax())
        return self.names[best], float(saved[best] / (self.size * len(found)))


def joined_languages(source: DataFrame, profiles: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, lang_pred, score of distinct rows by a join on n-grams, for any number of languages."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [first_grams(value.as_py(), size) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_hash", "codes"])

    each = source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(listed, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash bigint, codes array<bigint>")
    key = ["doc_id", "text_hash"]
    each = materialize(each.groupBy(*key).agg(F.first("codes").alias("codes")), "grams")
    places = each.select(*key, F.size("codes").alias("held"), F.posexplode("codes").alias("place", "code"))
    met = places.join(profiles, "code").groupBy(*key, "held", "lang").agg(F.sum(size - F.abs(F.col("rank") - 1 - F.col("place"))).alias("saved"))
    best = met.groupBy(*key, "held").agg(F.min(F.struct((-F.col("saved")).alias("less"), "lang")).alias("best"))
    best = best.select(F.col("doc_id").alias("to_id"), F.col("text_hash").alias("to_hash"), F.col("best.lang").alias("found"), (-F.col("best.less") / (size * F.col("held"))).alias("share"))
    least = profiles.agg(F.min("lang").alias("least"))  # one row
    joined = each.select(*key, F.size("codes").alias("held")).join(best, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("text_hash") == F.col("to_hash")), "left").crossJoin(F.broadcast(least))
    some = F.col("held") > 0
    return joined.select(*key, F.when(some, F.coalesce("found", "least")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(some, F.coalesce("share", F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"))


def identify_language(docs: DataFrame, profiles: Profiles, size: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row; the text alone decides."""
    source = slim(docs, doc_id=doc_id, text=text)
    if isinstance(profiles, DataFrame):
        found = joined_languages(source, profiles, size).withColumnsRenamed({"doc_id": "to_id", "text_hash": "to_hash"})
        same = F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.xxhash64("text") == F.col("to_hash"))
        return source.join(found, same).select("doc_id", "lang_pred", "score")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RankOrder(profiles, size)
        for batch in small_batches(batches, "text"):
            found = [model.classify(value.as_py()) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(predict, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def learnable(docs: DataFrame, held_out: Column, lang: str = "lang") -> DataFrame:
    """Rows that profiles may be learned from."""
    return docs.where(~held_out & F.col(lang).isNotNull())


def in_known_language(docs: DataFrame, profiles: Profiles, least_score: float = 0.2, size: int = 400, text: str = "text") -> DataFrame:
    """``docs`` without the rows that have no letter or are near no profile. Without profiles only the former go."""
    if isinstance(profiles, DataFrame):
        texts = docs.select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text")).distinct()
        near = joined_languages(texts, profiles, size).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
        near = near.select(F.col("text_hash").alias("near_hash"))
        return docs.join(near, F.xxhash64(docs[text]) == near["near_hash"], "left_semi")

    def test() -> Callable[[str | None], bool]:
        model = RankOrder(profiles, size)

        def passes(value: str | None) -> bool:
            if not profiles:
                return bool(value) and any(map(str.isalpha, value))
            name, score = model.classify(value)
            return name != UNKNOWN and score >= least_score

        return passes

    return keep_texts(docs, test, text)
