"""Work that grows with rows: postings and files of an index, files of a batch, calls of state for a key."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import textsearch
from tidemark.sources import lake
from tidemark.streaming import replay, state

START = dt.datetime(2026, 1, 1)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_an_index_grows_by_files_and_its_words_are_not_shuffled_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textsearch, "RANGE_ROWS", 20)
    monkeypatch.setattr(textsearch, "BATCH_ROWS", 7)
    store = lake.Lake(spark, f"file://{tmp_path}/lake").init()
    index = textsearch.TextIndex(store, "docs", ["body"], "id")
    rows = spark.createDataFrame([(i, f"w{i % 5} Zß\U0001f600x the, THE\x00-w{i % 7}", "U", 1) for i in range(40)] + [(None, "the", "U", 1), (90, None, "U", 1)], "id long, body string, __op string, __version long")
    texts = rows.selectExpr("id AS key", "__version AS version", "body")
    assert "Exchange" not in plan_of(index.posted(texts))
    index.apply(rows, ranges=2)
    assert store.list_files("docs_postings").count() > 4
    wanted = textsearch.search(rows.where("id IS NOT NULL"), "id", "body", "the")
    assert sorted(index.words("the").collect()) == sorted(wanted.collect()) and wanted.count() == 40
    index.apply(spark.createDataFrame([(1, None, "D", 2), (2, "x the", "U", 2)], "id long, body string, __op string, __version long"))
    for limit in (0, 10):  # versions that no longer count, shuffled and sent to every task
        monkeypatch.setattr(textsearch, "OUTDATED_ROWS", limit)
        assert sorted(tuple(r) for r in index.outdated().collect()) == [(1, 1), (2, 1)]
        assert {r["key"]: r["hits"] for r in index.prefix("th").collect()} == {i: 1 + (i != 2) for i in range(40) if i != 1}
    index.merge(ranges=2)
    assert store.list_files("docs_postings").count() > 4 and index.outdated().isEmpty()


def test_postings_of_a_word_share_rows_and_files_of_an_index_stay_small(spark, tmp_path):
    store = lake.Lake(spark, f"file://{tmp_path}/lake").init()
    index = textsearch.TextIndex(store, "docs", ["title", "body"], "id", "varchar")
    body = " ".join(f"w{i % 50}" for i in range(100))
    made = [(f"k{i}", f"t{i % 3}", body, "U", 1) for i in range(400)] + [("k1", "t1", "old the", "U", 0), ("k2", "t2", "gone", "D", 2), ("k3", None, body + " the", None, 1)]
    before = spark.conf.get("spark.sql.parquet.compression.codec"), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    index.apply(spark.createDataFrame(made, "id string, title string, body string, __op string, __version long").coalesce(2), ranges=2)
    assert (spark.conf.get("spark.sql.parquet.compression.codec"), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) == before
    kept = {r["key"] for r in index.live().collect()}
    assert kept - {"k3"} == {f"k{i}" for i in range(400)} - {"k2", "k3"}  # of the images of k3, which are of one order, either counts
    size = lambda: store.list_files("docs_postings").where("end_snapshot IS NULL").agg(F.sum("file_size_bytes")).first()[0]
    for merged in (False, True):
        if merged:
            index.merge(ranges=2)
        held = store.read("docs_postings")
        postings, rows = held.agg(F.sum("n"), F.count(F.lit(1))).first()
        assert postings > 20_000 and rows < postings / 10 and size() < 2 * postings + 20_000
        assert {r["key"]: r["hits"] for r in index.words("w7").collect()} == dict.fromkeys(kept, 2)
        assert {r["key"] for r in index.prefix("T1", "title").collect()} == {k for k in kept if k != "k3" and int(k[1:]) % 3 == 1}
        assert index.words("old").isEmpty() and index.phrase("gone").isEmpty() and index.phrase("w49 w0 w1").count() == len(kept)
        some = index.of("w7", "w7", "body", None).where("key = 'k9'").first()
        assert (some["field"], some["version"], some["positions"]) == ("body", 1, [7, 57])
    assert held.where("term = 'gone' OR term = 'old'").isEmpty()


def test_blocks_give_back_what_was_packed():
    far = " ".join(["a"] + ["b"] * 20_000 + ["a", "zß"] + ["c"] * 200 + ["a"])
    texts = [far, None, "a", "", "a a", "x"] + ["a"] * 300
    columns = [pa.array([*range(5), None, *range(6, 306)]), pa.array([1] * 306), pa.array([True] * 4 + [False] + [True] * 301), pa.array([t and t.encode() for t in texts], pa.binary())]
    made = list(textsearch.postings(["t"])(iter([pa.RecordBatch.from_arrays(columns, ["key", "version", "live", "text0"])])))
    assert made[-1].column("keys").to_pylist() == [[*range(5), None, *range(6, 306)]] and made[-1].column("term").null_count == 1
    blocks = made[0].slice(1)  # a batch that does not begin where its buffers do
    got = {(r["term"], r["row"]): r["positions"] for r in pa.Table.from_batches(textsearch.unpacked(iter(made[:1]))).to_pylist()}
    assert got == {("a", 0): [0, 20_001, 20_203], ("b", 0): [*range(1, 20_001)], ("zß", 0): [20_002], ("c", 0): [*range(20_003, 20_203)], ("a", 2): [0]} | {("a", i): [0] for i in range(6, 306)}
    assert [b for b in made[0].column("term").to_pylist() if b == "a"] == ["a", "a"]
    bits = next(textsearch.bits_of(iter([pa.RecordBatch.from_pydict({"chunk": [1], "kept": [[6, 8, 300]]})])))["bits"][0].as_py()
    sifted = textsearch.sifted(iter([pa.RecordBatch.from_arrays([*blocks.columns[:5], pa.array([bits] * len(blocks))], [*blocks.schema.names[:5], "bits"])]))
    left = pa.Table.from_batches(textsearch.unpacked(sifted)).to_pylist()
    assert {(r["term"], r["row"]) for r in left} <= {("a", i) for i in (6, 8, 300)} and ("a", 300) in {(r["term"], r["row"]) for r in left}


def test_a_long_stretch_is_several_files_of_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "FILE_ROWS", 100)
    monkeypatch.setattr(replay, "LEAST_ROWS", 20)
    rows = spark.createDataFrame([(i, START + dt.timedelta(minutes=i)) for i in range(1000)], "n long, at timestamp")
    seen = []
    query = replay.replay(rows, "at", 3).writeStream.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True)
    query.foreachBatch(lambda batch, number: seen.append((batch.select(F.input_file_name()).distinct().count(), [r["n"] for r in batch.collect()]))).start().awaitTermination()
    assert [files for files, _ in seen] == [4, 4, 4]
    assert [n for _, some in seen for n in sorted(some)] == list(range(1000))


class Held:
    """State of one key and its timers, with a count of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return self.called(self.value)

    def update(self, value):
        self.value = self.called(value)

    def clear(self):
        self.value = self.called()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(self.called(at))

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(self.called(at))


class Timer:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_a_keys_rows_cost_few_calls_of_state():
    kinds = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("n", T.LongType()), T.StructField("v", T.StringType())])
    found, held = state.RetainedKeys(["k", "kind", "at", "n", "v"], kinds, "at", "n", ["v"], dt.timedelta(hours=1)), Held()
    found.init(held)
    row, millis = Row("k", "at", "n", "v"), lambda at: int(at.timestamp() * 1000)
    # Rows of one millisecond in the order of their microseconds, against that of n.
    rows = [row("a", START + dt.timedelta(microseconds=i), 1000 - i, "xy"[i // 300 % 2]) for i in range(900)]
    assert list(found.handleInputRows(("a",), iter(rows[::-1]), Timer(millis(START) - 1))) == [] and held.calls <= 4
    assert len(held.timers) == 1
    passed = Timer(millis(START) + 60_000)
    out = list(found.handleExpiredTimer(("a",), passed, Timer(held.timers.pop())))
    assert [(r["kind"], r["n"], r["v"]) for r in out] == [("change", 1000, "x"), ("change", 700, "y"), ("change", 400, "x")]
    assert held.calls <= 8 and len(held.timers) == 1
    late = Timer(held.timers.pop())
    assert [(r["kind"], r["n"]) for r in found.handleExpiredTimer(("a",), late, late)] == [("expired", 101)] and held.value is None


def test_a_change_filter_takes_rows_without_a_frame_for_each_key():
    found, held = state.ChangeFilter(["at", "n"], ["v"]), Held()
    found.init(held)
    row = Row("at", "n", "v")
    rows = [row(2, 1, "b"), row(None, 1, "c"), row(1, 2, None), row(1, 1, "a"), row(1, 3, None)]
    assert [r["v"] for r in found.handleInputRows(("a",), iter(rows), None)] == ["a", None, "b", "c"]
    assert list(found.handleInputRows(("a",), iter([row(3, 1, "c")]), None)) == [] and held.calls <= 3
