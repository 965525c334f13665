"""Toxicity scores from a lexicon trie, Levenshtein automata and the words around a match.

The lexicon is learned from labelled rows: whole words and stems (a stem matches a longer word that begins
with it) that are far more frequent in toxic documents. All terms share one trie. The trie is intersected
with the Levenshtein automata of its words, as one automaton whose states are made when a text first needs
them, so a word is read once whatever the size of the lexicon, and misspelled terms are found too. A match
inside quotation marks, or after a word of reporting, counts less; one beside a word of address counts more.
The evidence of a document's distinct terms, exact and misspelled, goes through a logistic function that is
fitted to the same labelled rows.

Bounds: at most ``per_class`` labelled rows of each class are learned from (those of the smallest id hash)
and at most ``lexicon`` terms are kept; both are parameters. In the logistic fit a row of a class that was cut
counts for as many labelled rows as it stands for, so the prior is that of all labels. Words of ``SHORTEST`` to
``LONGEST`` letters can become terms, and each sum of evidence counts up to ``MOST_EVIDENCE``, where a score is 1 in
all but name. Scoring reads every text whole: stretches end after white space only, and their windows reach over.

Edge cases: a null or empty text gets the score of a text without a match; labels that are null, or whose
document is missing, are not learned from; a document with several labels is toxic if any says so; without
a toxic label all scores are those of the prior, below 0.5; a null id counts as the empty text in the fold. Ties
have an order everywhere (of equal labelled texts one is learned from, of copies the one of the smallest hash, of
equally good terms the longer, then the first by name), so a model does not depend on partitions.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_texts, slim, small_batches, text_spans
from tidemark.session import discard, materialize

WORD = re.compile(r"[^\W_]+")
#: Words that report speech, words of address, and quotation marks that open and close.
REPORTING = frozenset("said says wrote writes quote quoted quotes quoting called calls word term phrase dijo dice escribió palabra cita citó dit écrit mot cité citation sagte sagt schrieb wort zitat zitierte".split())
ADDRESS = frozenset("you your youre u ur yourself tu te toi vous du dich dir ihr euch usted ustedes vosotros".split())
QUOTES = (("“", "”"), ("«", "»"), ("„", "“"), ("‹", "›"), ("「", "」"))
WINDOW = 8
SHORTEST, SHORTEST_STEM, LONGEST_STEM, LONGEST = 3, 4, 10, 40
#: Nats of evidence beyond which a score no longer rises.
MOST_EVIDENCE = 40.0


def allowed_edits(term: str) -> int:
    """Edits that still count as the term: none for short words, whose neighbours are other words."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """Terms with weights in nats: words (matched whole, misspelled too) and stems (matched as beginnings)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exact_only: set[str] = field(default_factory=set)  # words whose misspellings are mostly other words

    def edits(self, word: str) -> int:
        return 0 if word in self.exact_only else allowed_edits(word)


class Automaton:
    """The product of the lexicon's trie and its words' Levenshtein automata, made state by state."""

    def __init__(self, lexicon: Lexicon, most_states: int = 20_000) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: list[tuple[str, float, int] | None] = [None]
        self.stem: list[float | None] = [None]
        self.edits = [0]  # the most that any word below a node allows
        self.most = most_states
        for term, weight in lexicon.words.items():
            self.word[self.add(term, lexicon.edits(term))] = (term, weight, lexicon.edits(term))
        for term, weight in lexicon.stems.items():
            self.stem[self.add(term, 0)] = weight
        self.names = {self.node(t): t for t in lexicon.stems}
        self.forget()

    def node(self, term: str) -> int:
        at = 0
        for ch in term:
            at = self.children[at][ch]
        return at

    def add(self, term: str, edits: int) -> int:
        at = 0
        self.edits[0] = max(self.edits[0], edits)
        for ch in term:
            if ch not in self.children[at]:
                self.children[at][ch] = len(self.children)
                self.children.append({})
                self.word.append(None)
                self.stem.append(None)
                self.edits.append(0)
            at = self.children[at][ch]
            self.edits[at] = max(self.edits[at], edits)
        return at

    def forget(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, float, int] | None] = []
        self.start = self.state({(0, 0)})

    def state(self, places: set) -> int:
        """places: (node, edits so far); a node of -1 - n stands for the stem that ends in node n, with letters after it."""
        todo = list(places)
        while todo:  # letters of a term that the text lacks
            node, edits = todo.pop()
            if node >= 0 and edits < self.edits[node]:
                for child in self.children[node].values():
                    if edits < self.edits[child] and (child, edits + 1) not in places:
                        places.add((child, edits + 1))
                        todo.append((child, edits + 1))
        key = frozenset(places)
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            best = None
            for node, edits in key:
                if node < 0:
                    found = (self.names[-1 - node], self.stem[-1 - node], 0)
                elif self.word[node] and edits <= self.word[node][2]:
                    found = (self.word[node][0], self.word[node][1], edits)
                else:
                    continue
                if best is None or (found[2], -found[1], found[0]) < (best[2], -best[1], best[0]):
                    best = found
            self.accepts.append(best)
        return self.number[key]

    def step(self, state: int, ch: str) -> int:
        places = set()
        for node, edits in self.states[state]:
            if node < 0:
                places.add((node, edits))
                continue
            if self.stem[node] is not None and not edits:
                places.add((-1 - node, 0))
            child = self.children[node].get(ch)
            if child is not None and edits <= self.edits[child]:
                places.add((child, edits))
            if edits < self.edits[node]:
                places.add((node, edits + 1))
                places |= {(c, edits + 1) for c in self.children[node].values() if edits < self.edits[c]}
        to = self.state(places)
        self.moves[state][ch] = to
        return to

    def match(self, word: str) -> tuple[str, float, int] | None:
        """The best term that ``word`` spells: (term, weight, edits), or nothing."""
        if len(self.states) > self.most:
            self.forget()
        at, moves = self.start, self.moves
        for ch in word:
            to = moves[at].get(ch)
            at = self.step(at, ch) if to is None else to
            if at < 0:
                return None
        return self.accepts[at]


def context_factor(text: str, spans: list[tuple[int, int]], i: int) -> float:
    """How much a match in word ``i`` counts, from the words and marks around it."""
    first, last = max(0, i - WINDOW), min(len(spans) - 1, i + WINDOW)
    before, after = text[spans[first][0] : spans[i][0]], text[spans[i][1] : spans[last][1] + 1]
    quoted = before.count('"') % 2 == 1 and '"' in after
    quoted = quoted or any(before.rfind(a) > before.rfind(b) and b in after for a, b in QUOTES)
    near = [text[s:e] for s, e in spans[first : last + 1]]
    reported = any(w in REPORTING for w in near[: i - first])
    factor = 0.15 if quoted and reported else 0.4 if quoted else 0.7 if reported else 1.0
    return factor * (1.25 if not quoted and any(w in ADDRESS for w in near) else 1.0)


class Matcher:
    """Evidence of whole texts; remembers the words it has looked up, within a bound."""

    def __init__(self, lexicon: Lexicon, remembered: int = 50_000) -> None:
        self.automaton, self.known, self.most = Automaton(lexicon), {}, remembered

    def look_up(self, word: str) -> tuple[str, float, int] | None:
        if len(self.known) >= self.most:
            self.known.clear()
        found = self.known[word] = self.automaton.match(word)
        return found

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Of exact terms, of misspelled terms (both weighted by context), and the logarithm of the number of matches.

        A long text is read a stretch at a time, with the words on both sides that a window may reach.
        """
        best: dict[tuple[str, bool], float] = {}
        matches, before = 0, ""
        for part, after in stretches(text or ""):
            matches += self.matches(before, part, after, best)
            before = last_words(part) if after else ""
        exact, fuzzy = (sum(w for (_, f), w in best.items() if f is kind) for kind in (False, True))
        return min(exact, MOST_EVIDENCE), min(fuzzy, MOST_EVIDENCE), math.log1p(matches)

    def matches(self, before: str, part: str, after: str, best: dict[tuple[str, bool], float]) -> int:
        """The matches of ``part`` between what stands on its sides; ``best`` keeps the greatest worth of each term."""
        known, hits = self.known, {}
        for word in set(WORD.findall(part)):
            found = known[word] if word in known else self.look_up(word)
            if found:
                hits[word] = found
        if not hits:
            return 0
        text = before + part + after
        spans, matches = [m.span() for m in WORD.finditer(text)], 0
        for i, (s, e) in enumerate(spans):
            if len(before) <= s < len(before) + len(part) and (found := hits.get(text[s:e])):
                term, weight, edits = found
                matches += 1
                key, worth = (term, edits > 0), weight / (1 + edits) * context_factor(text, spans, i)
                best[key] = max(best.get(key, 0.0), worth)
        return matches


def stretches(text: str) -> Iterator[tuple[str, str]]:
    """Stretches of the lower-cased text, of ``WINDOW`` words at least, and the ``WINDOW`` words after each with the mark that follows."""
    held, now = "", None
    for part in text_spans(text):
        held += part.lower()
        found = list(islice(WORD.finditer(held), WINDOW + 1))
        if len(found) <= WINDOW:
            continue
        if now is not None:
            yield now, held[: found[WINDOW - 1].end() + 1]
        held, now = "", held
    yield (now or "") + held, ""


def last_words(text: str) -> str:
    """The end of ``text`` from its last ``WINDOW`` words on, sought in ever longer ends: one word more shows that none is cut."""
    length = 1 << 10
    while True:
        start = max(0, len(text) - length)
        starts = deque((m.start() for m in WORD.finditer(text, start)), WINDOW + 1)
        if start and len(starts) <= WINDOW:
            length *= 4
            continue
        return text[starts[-min(len(starts), WINDOW)] :] if starts else ""


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]  # bias, exact, fuzzy, matches

    def score(self, evidence: tuple[float, float, float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], evidence, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled_sample(labels: DataFrame, learn: Column, per_class: int, label: str = "toxic") -> tuple[DataFrame, dict[int, float]]:
    """doc_id, toxic: at most ``per_class`` ids of each class, those of the smallest hash; and how many labelled ids one of a class stands for."""
    each = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in each.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = each.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(each.where("toxic = 0").orderBy(*order).limit(per_class))
    return sample, {c: max(n, per_class) / per_class for c, n in totals.items()}


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of five-word shingles, ascending; a text of fewer words is one."""
    words = (text or "").lower().split()
    shingles = [" ".join(x) for x in zip(*(words[i:] for i in range(5)))] or [" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in shingles], np.uint64))


def unlike_texts(sample: DataFrame, hashes: int = 3) -> DataFrame:
    """One row of each class and group of copies: a row goes if its shingles equal four fifths of those of a row that stays beside it.

    Else the words of one document that was copied often would look like words of many toxic documents. Rows
    meet by a smallest shingle hash, for each of several hashes; what they share is then counted. Shingles are
    kept as bytes, and texts stay aside until the rows that go are known.
    """
    rows = materialize(sample.withColumn("name", F.xxhash64("text")).groupBy("toxic", "name").agg(F.min("text").alias("text")), "rows")
    factors = np.random.default_rng(17).integers(0, 1 << 64, hashes, np.uint64) | np.uint64(1)
    keys = [f"m{i}" for i in range(hashes)]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            least = [pa.array([int((s * f).min() >> np.uint64(1)) for s in sets], pa.int64()) for f in factors]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("name"), pa.array([s.tobytes() for s in sets], pa.binary()), *least], ["toxic", "name", "shingles", *keys])

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "shingles"):
            stays = []
            for mine, other in zip(batch.column("shingles"), batch.column("to_shingles"), strict=True):
                if not other.is_valid:
                    stays.append(True)
                    continue
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (mine, other))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                stays.append(9 * shared < 4 * (len(a) + len(b)))  # shared / union < 4 / 5
            yield batch.filter(pa.array(stays, pa.bool_())).select(["toxic", "name", "shingles", *keys])

    schema = ", ".join(["toxic int, name bigint, shingles binary", *(f"{k} bigint" for k in keys)])
    left = materialize(rows.mapInArrow(shingled, schema), "shingled")
    for key in keys:
        first = left.groupBy("toxic", key).agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
        first = materialize(first.join(left.select(F.col("toxic").alias("of_toxic"), F.col("name").alias("of_name"), F.col("shingles").alias("to_shingles")), (F.col("toxic") == F.col("of_toxic")) & (F.col("first") == F.col("of_name"))).select("toxic", key, "first", "to_shingles"), "first")
        met = left.join(first, ["toxic", key], "left").select(*left.columns, F.when(F.col("name") != F.col("first"), F.col("to_shingles")).alias("to_shingles"))
        after = materialize(met.mapInArrow(unlike, schema), "shingled")
        discard(left)
        discard(first)
        left = after
    return rows.join(left.select("toxic", "name"), ["toxic", "name"], "left_semi").select("toxic", "text")


def term_counts(sample: DataFrame) -> DataFrame:
    """kind (w or s), term, toxic and clean document counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(counts[0].keys() | counts[1].keys())
            for at in range(0, len(keys), 10_000):
                part = keys[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in part]), pa.array([k[1:] for k in part]), *(pa.array([counts[c][k] for k in part], pa.int64()) for c in (1, 0))],
                    ["kind", "term", "toxic", "clean"],
                )
            counts[0].clear()
            counts[1].clear()

        for batch in small_batches(batches, "text", 2 << 20):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = {w for part in text_spans(text or "") for w in WORD.findall(part.lower()) if SHORTEST <= len(w) <= LONGEST}
                counts[toxic].update({f"w{w}" for w in words} | {f"s{w[:k]}" for w in words for k in range(SHORTEST_STEM, min(len(w) - 1, LONGEST_STEM) + 1)})
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield from flush()
        yield from flush()

    return sample.mapInArrow(count, "kind string, term string, toxic bigint, clean bigint").groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(rows: list[tuple[str, str, int, float]], most: int) -> Lexicon:
    """rows: kind, term, toxic documents, weight. The best first; what a chosen stem covers is left out."""
    lexicon = Lexicon()
    support: dict[str, int] = {}
    for kind, term, toxic, weight in sorted(rows, key=lambda r: (-r[2] * r[3], -len(r[1]), r[1], r[0])):
        if len(lexicon.words) + len(lexicon.stems) >= most:
            break
        if any(term[:k] in lexicon.stems for k in range(SHORTEST_STEM, len(term) + (kind == "s"))):
            continue
        if kind == "s" and any(t.startswith(term) and toxic <= 1.2 * n for t, n in support.items()):
            continue
        (lexicon.words if kind == "w" else lexicon.stems)[term] = weight
        support[term] = max(toxic, support.get(term, 0))
    return lexicon


def misspelled_counts(sample: DataFrame, lexicon: Lexicon) -> dict[str, tuple[int, int]]:
    """For each word of the lexicon: toxic and clean documents that hold a misspelling of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, counts = Matcher(lexicon), (Counter(), Counter())
        for batch in small_batches(batches, "text"):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = (matcher.known.get(w) or (None if w in matcher.known else matcher.look_up(w)) for w in {w for part in text_spans(text or "") for w in WORD.findall(part.lower())})
                counts[toxic].update({f[0] for f in found if f and f[2]})
        terms = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([counts[c][t] for t in terms], pa.int64()) for c in (1, 0))], ["term", "toxic", "clean"])

    rows = sample.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic"), F.sum("clean")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    per_class: int = 8_000,
    lexicon: int = 500,
    least_ratio: float = 12.0,
    least_rows: int = 6,
    least_evidence: float = 2.0,
    label: str = "toxic",
) -> Model:
    """Learn a lexicon and a logistic function from labelled rows for whose ``doc_id`` the condition ``learn`` holds.

    A term is kept if at least ``least_rows`` toxic documents hold it, it is ``least_ratio`` times as frequent
    in them, and the lower 95 % bound of that ratio's logarithm is ``least_evidence`` or more. A word keeps its
    misspellings unless clean documents hold them as readily.
    """
    chosen, stands_for = labelled_sample(slim(labels, doc_id="doc_id", **{label: label}), learn, per_class, label)
    sample = slim(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    sample = materialize(unlike_texts(sample), "labelled")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model(Lexicon(), [-3.0, 1.0, 0.8, 0.0])
    rate = lambda n, total: (F.col(n) + 0.5) / (total + 1.0)
    ratio = rate("toxic", bad) / rate("clean", good)
    least = max(least_rows, round(0.002 * bad))
    bound = F.log(ratio) - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = term_counts(sample).where((F.col("toxic") >= least) & (ratio >= least_ratio) & (bound >= least_evidence)).select("kind", "term", "toxic", F.log(ratio).alias("weight"))
    rows = best.orderBy(F.desc(F.col("toxic") * F.col("weight")), F.desc(F.length("term")), "term", "kind").limit(20 * lexicon).collect()
    terms = choose_terms([tuple(r) for r in rows], lexicon)
    terms.exact_only = {t for t, (toxic, clean) in misspelled_counts(sample, terms).items() if clean > 1 and (toxic + 0.5) / (bad + 1) < least_ratio * (clean + 0.5) / (good + 1)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in small_batches(batches, "text"):
            found = [matcher.evidence(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([x[i] for x in found], pa.float64()) for i in range(3))], ["toxic", "a", "b", "c"])

    # Distinct evidence with its counts: a few numbers for each labelled row at most.
    seen = sample.mapInArrow(features, "toxic int, a double, b double, c double").select("toxic", *[F.round(c, 2).alias(c) for c in "abc"]).groupBy("toxic", "a", "b", "c").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "a", "b", "c").collect()
    return Model(terms, logistic(np.array([[r["a"], r["b"], r["c"]] for r in seen]), np.array([r["toxic"] for r in seen], float), np.array([r["n"] * stands_for[r["toxic"]] for r in seen], float)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: tuple[float, ...] = (-3.0, 1.0, 0.8, 0.0), strength: tuple[float, ...] = (0.01, 4.0, 4.0, 4.0)) -> list[float]:
    """Logistic regression by Newton's method, drawn to ``prior`` where the rows say nothing."""
    x, w, mean, pull = np.column_stack([np.ones(len(x)), x]), np.array(prior), np.array(prior), np.array(strength)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + pull @ (w - mean) ** 2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + pull * (w - mean)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(pull), gradient)
        scale, now = 1.0, loss(w)
        while loss(w - scale * step) > now and scale > 1e-6:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, score of every row; the text alone decides."""
    source = slim(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for batch in small_batches(batches, "text"):
            found = [model.score(matcher.evidence(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.float64())], ["doc_id", "text_hash", "score"])

    return source.mapInArrow(scored, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash bigint, score double")


def without_toxic(docs: DataFrame, model: Model, cut: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more."""

    def test() -> Callable[[str | None], bool]:
        matcher = Matcher(model.lexicon)
        return lambda value: model.score(matcher.evidence(value)) < cut

    return keep_texts(docs, test, text)
