"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words is one window). Of each
window's k-gram hashes the smallest is kept; a document keeps the smallest of each of its own windows, once for
each run of windows that keep the same. Equal windows keep equal hashes, so every shared window is met by a join
of the kept hashes. A hit is extended to all windows of its run, and those are compared word by word.

Short items have windows of their own length; documents are winnowed once for each window length that
occurs in the benchmark, at most ``window`` lengths. Where there are several, word hashes are written once and read
for each length.

Words are dealt into rows of ``BLOCK`` words, each with the words after it that its last windows reach, so what a
row holds and costs after the split does not grow with the text, and a run of equal windows costs its length.
Sides are broadcast up to ``broadcast_bytes``, added up first; beyond that the joins shuffle, with the same result.

Edge cases: a null text has no words, and an item without words no window; results depend on the text alone
and are joined back by id (null-safe) and text hash, so repeated rows and ids give a row each; an empty
benchmark leaves every document clean; a window that many items share is one window with a list of items;
a very long document gives many small rows once its words are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, slim
from tidemark.session import materialize

#: What parts words: ASCII characters other than digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5
#: Words of a row.
BLOCK = 4096


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def gram_hashes(tokens: Column, k: int) -> Column:
    """One hash for each k consecutive words; none if there are fewer."""
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return gram_of_hashes(hashes, k)


def gram_of_hashes(hashes: Column, k: int) -> Column:
    count = F.size(hashes) - (k - 1)
    return F.when(count < 1, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    )


def kept_runs(rows: DataFrame, grams: str, span: int) -> DataFrame:
    """``runs`` in place of the array ``grams``: stretches of windows that keep the same smallest hash, as (start, end, gram).

    A window is ``span`` consecutive hashes, numbered by its first. Minima of 2, 4, 8, ... hashes are made of
    those of half as many, each in a projection of its own, so the work per word grows with the logarithm of ``span``.
    """
    others = [c for c in rows.columns if c != grams]
    count = F.greatest(F.size(grams) - (span - 1), F.lit(0))
    out, width = rows.select(*others, count.alias("count"), F.col(grams).alias("least")), 1

    def step(offset: int) -> DataFrame:
        return out.select(*others, "count", F.transform("least", lambda x, i: F.least(x, F.get(F.col("least"), i + offset))).alias("least"))

    while 2 * width <= span:
        out, width = step(width), 2 * width
    if width < span:
        out = step(span - width)
    out = out.select(*others, "count", F.slice("least", F.lit(1), F.col("count")).alias("least"))
    fresh = F.transform("least", lambda x, i: F.when((i == 0) | (F.get(F.col("least"), i - 1) != x), F.struct(i.alias("start"), x.alias("gram"))))
    out = out.select(*others, "count", F.array_compact(fresh).alias("starts"))
    ended = F.transform("starts", lambda x, i: F.struct(x["start"].alias("start"), (F.coalesce(F.get(F.col("starts"), i + 1)["start"], F.col("count")) - 1).alias("end"), x["gram"].alias("gram")))
    return out.select(*others, ended.alias("runs"))


def benchmark_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """item_id, length, content: every window of every item, as its words joined by a space."""
    each = slim(items, item_id=item_id, text=text).select("item_id", words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    length = F.least(F.size("tokens"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("tokens") - length)
    content = lambda s: F.array_join(F.transform(F.sequence(s, s + length - 1), lambda i: F.get(F.col("tokens"), i)), " ")
    return each.select("item_id", length.alias("length"), F.explode_outer(F.transform(starts, content)).alias("content"))


def blocks(source: DataFrame, window: int) -> DataFrame:
    """doc_id, text_hash, base, tokens: the words from ``base`` on, ``BLOCK`` of them and those that their windows reach."""
    # Elements are fetched one by one: inside a lambda, slice() reads the whole array each time.
    split = source.select("doc_id", "text_hash", words(F.col("text")).alias("tokens"))
    count = F.size("tokens")
    numbers = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
    places = lambda b: F.sequence(b * BLOCK, F.least((b + 1) * BLOCK + window - 1, count) - 1)
    many = F.transform(numbers, lambda b: F.struct((b * BLOCK).alias("base"), F.transform(places(b), lambda i: F.get(F.col("tokens"), i)).alias("tokens")))
    cut = F.when(count <= BLOCK, F.array(F.struct(F.lit(0).alias("base"), F.col("tokens").alias("tokens")))).otherwise(many)
    return split.select("doc_id", "text_hash", F.explode_outer(cut).alias("block")).select("doc_id", "text_hash", "block.*")


def small(side: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``side``, broadcast if its values add up to ``broadcast_bytes`` at most."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8) for f in side.schema.fields]
    held = side.agg(F.sum(sum(sizes, F.lit(16)).cast("bigint"))).first()[0] or 0
    return F.broadcast(side) if held <= broadcast_bytes else side


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    share: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids and contaminated (n_hit > 0 and share * n_hit >= n_words) of every row."""
    found = materialize(benchmark_windows(items, window, item_id, item_text).distinct(), "windows")
    contents = found.select("length", "content").distinct()
    lengths = sorted(r["length"] for r in contents.select("length").distinct().collect())  # at most ``window`` numbers
    source = slim(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
    counted = source.select("doc_id", "text_hash", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    if not lengths:
        none = F.lit(0).cast("bigint")
        return counted.select("*", none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"))

    hashes = blocks(source, window).select("doc_id", "text_hash", "base", F.transform("tokens", lambda w: F.xxhash64(w)).alias("hashes"))
    if len(lengths) > 1:
        hashes = materialize(hashes, "word-hashes")
    block = ["doc_id", "text_hash", "base"]
    hits: DataFrame | None = None
    for length in lengths:
        k = min(GRAM, length)
        span = length - k + 1
        listed = contents.where(F.col("length") == length).select(gram_hashes(F.split("content", " "), k).alias("grams"))
        listed = small(listed.select(F.array_min("grams").alias("gram")).distinct(), broadcast_bytes)
        own = hashes.select(*block, F.slice("hashes", F.lit(1), F.lit(BLOCK + length - 1)).alias("hashes") if length < window else F.col("hashes"))
        own = own.select(*block, gram_of_hashes(F.col("hashes"), k).alias("grams"))
        # The outer form: a plain explode puts a filter on its input below all projections, and writes them out in it.
        own = kept_runs(own, "grams", span).select(*block, F.explode_outer("runs").alias("run"))
        met = own.select(*block, "run.*").join(listed, "gram", "left_semi")
        met = met.select(*block, F.lit(length).alias("length"), "start", "end")
        hits = met if hits is None else hits.unionByName(met)
    per_block = hits.groupBy(*[F.col(c).alias(f"hit_{c}") for c in block]).agg(F.collect_set(F.struct("length", "start", "end")).alias("hits"))
    per_block = materialize(per_block, "hits")

    # Extend: all windows that keep a hash of the benchmark, told apart by their words.
    met_docs = per_block.select("hit_doc_id", "hit_text_hash").distinct()
    once = source.join(met_docs, F.col("doc_id").eqNullSafe(F.col("hit_doc_id")) & (F.col("text_hash") == F.col("hit_text_hash")), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc_id")) & (F.col("text_hash") == F.col("hit_text_hash")) & (F.col("base") == F.col("hit_base"))
    tokens = blocks(once, window).join(per_block, same).select(*block, "hits", "tokens")

    def windows(hit: Column) -> Column:
        return F.transform(F.sequence(hit["start"], hit["end"]), lambda s: F.struct((F.col("base") + s).alias("start"), hit["length"].alias("length"), F.array_join(F.transform(F.sequence(s, s + hit["length"] - 1), lambda i: F.get(F.col("tokens"), i)), " ").alias("content")))

    spans = tokens.select("doc_id", "text_hash", F.explode_outer(F.flatten(F.transform("hits", windows))).alias("span")).select("doc_id", "text_hash", "span.*")
    keyed = materialize(contents.withColumn("window_id", F.monotonically_increasing_id()), "contents")
    matched = spans.join(small(keyed, broadcast_bytes), ["length", "content"]).select("doc_id", "text_hash", "start", "length", "window_id").distinct()
    matched = materialize(matched, "matched")

    # Words inside any window: the union of intervals, in order of their start.
    key = ["doc_id", "text_hash"]
    longest = matched.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = longest.select(*key, F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0)).alias("n"))
    n_hit = covered.groupBy(*key).agg(F.sum("n").cast("bigint").alias("n_hit"))
    members = small(found.join(keyed, ["length", "content"]).select("window_id", F.col("item_id").cast("string").alias("item_id")).distinct(), broadcast_bytes)
    by_item = matched.select(*key, "window_id").distinct().join(members, "window_id").select(*key, "item_id").distinct()
    named = by_item.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_items"))
    result = n_hit.join(named, (n_hit["doc_id"].eqNullSafe(named["doc_id"])) & (n_hit["text_hash"] == named["text_hash"])).select(n_hit["doc_id"].alias("hit_id"), n_hit["text_hash"].alias("hit_hash"), "n_hit", "n_items", "item_ids")
    joined = counted.join(result, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = contamination(docs, items, doc_id=doc_id, text=text, **options).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = materialize(bad, "contaminated")
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text]) == bad["bad_hash"]), "left_anti")
