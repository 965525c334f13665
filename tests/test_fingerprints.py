"""Bitmap fingerprints against sets, and shredded variants against the values that went in."""

import json
import random

from pyspark.sql import functions as F

from tidemark.operators import fingerprints, variants


def test_every_contained_column_is_found(spark):
    rng = random.Random(1)
    sets = {f"c{i}": rng.sample(range(3000), rng.choice([1, 2, 5, 50, 800, 3000])) for i in range(12)}
    sets |= {"copy": sets["c3"], "part": sets["c5"][: max(1, len(sets["c5"]) // 2)], "all": list(range(3000)), "none": [], "apart": [-1, 5]}
    long = max(map(len, sets.values()))
    names = list(sets)
    rows = [tuple(sets[n][i % len(sets[n])] if sets[n] else None for n in names) for i in range(long)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).repartition(4)
    tables = {"t": frame.select(*names[:7]), "u": frame.select(*names[7:])}
    where = {n: f"{'t' if n in names[:7] else 'u'}.{n}" for n in names}
    want = {(where[a], where[b], len(set(sets[a]))) for a in names for b in names if a != b and sets[a] and set(sets[a]) <= set(sets[b])}
    assert {tuple(r) for r in fingerprints.contained(tables).collect()} == want and len(want) > 20
    kept = fingerprints.bitmaps(fingerprints.unpivoted(tables))
    pairs = spark.createDataFrame([("u.part", "t.c5"), ("t.c1", "u.apart")], "a string, b string")
    assert {r["a"]: r["containment"] for r in fingerprints.similarity(kept, pairs).collect()}["u.part"] == 1.0
    assert fingerprints.contained({"t": spark.createDataFrame([], "a int, b int")}).count() == 0


RAGGED = [
    {"a": 1, "b": "x", "c": {"d": 1, "e": [1, {"f": None}]}},
    {"a": 2, "b": "y"},
    {"a": "three", "b": None, "more": 1.5},
    {"b": "z", "a": 4, "flag": True, "odd key.": 1},
    {},
    [1, 2],
    "text",
    7,
    None,
    {"a": 5, "b": "", "c": {"d": "other"}},
    {"a": 6.25, "b": "é", "flag": False},
]


def test_shredded_values_come_back(spark, tmp_path):
    texts = [json.dumps(v) for v in RAGGED] + [None, "{broken"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", variants.parsed(F.col("text")).alias("v"))
    types = variants.path_types(rows, "v")
    found = {r["path"]: (r["rows"], r["nulls"], r["type"]) for r in types.collect()}
    assert found["$.b"] == (6, 1, "STRING") and found["$.c.d"] == (2, 0, "VARIANT") and found["$.a"][2] == "VARIANT" and found["$.flag"] == (2, 0, "BOOLEAN")
    assert variants.hot_keys(types, 10) == {"b": "STRING"}
    keys = {"a": "BIGINT", "b": "STRING", "flag": "BOOLEAN", "more": "DOUBLE"}
    path = f"file://{tmp_path}/shredded"
    variants.shred(rows, "v", keys).write.parquet(path)
    held = spark.read.parquet(path)
    assert {r["id"]: r["v__a"] for r in held.collect() if r["v__a"] is not None} == {0: 1, 1: 2, 3: 4, 9: 5}
    text = lambda frame: {r["id"]: r["j"] for r in frame.select("id", F.to_json("v").alias("j")).collect()}
    assert text(variants.unshred(held, "v", keys)) == text(rows)
    plan = held.where("v__a > 3").select("v__a")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<v__a:bigint>" in plan
    assert {r["variant_path"]: (r["min_value"], r["max_value"], r["value_count"]) for r in variants.path_statistics(held, "v", keys).collect()}["$.a"] == ("1", "5", 4)
