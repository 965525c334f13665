"""Further registered queries: drivers, JSON and text functions, relations, captures and migrations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import extract, text
from tidemark.functions import json as fj
from tidemark.operators import acquire, codegen, diff, fingerprints, intervals, migrate, profile, provenance, registry, relate, replica, textsearch, ttst, variants
from tidemark.plans.catalogue import ORACLES, STAGED_AT, V_BACKLOG, V_CAPTURE, V_IDENTITY, moment, query, table, v_backlog, v_capture, v_identity, versioned, VERSIONED
from tidemark.session import scratch_path
from tidemark.sources.lake import HistoryTable, Lake

# States and drivers

AT = "2024-01-10 00:00:00"


@query(f"SELECT k, value FROM {VERSIONED} WHERE begin_snapshot <= (SELECT max(event_id) FROM events WHERE ts <= TIMESTAMP '{AT}') AND (end_snapshot IS NULL OR end_snapshot > (SELECT max(event_id) FROM events WHERE ts <= TIMESTAMP '{AT}'))")
def as_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as of an instant, by the latest snapshot whose label is not after it."""
    rows, snapshots = versioned(spark, sf_dir)
    return intervals.as_of_time(rows, snapshots, moment(AT), False, "begin_snapshot", "end_snapshot").select("k", "value")


@query(
    f"""SELECT n.k, n.op AS change, CAST(n.seq AS BIGINT) AS tt, l.value, TIMESTAMP '2020-01-01 00:00:00' + to_seconds(n.seq * 60) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {V_BACKLOG} WHERE seq > 300) n
LEFT JOIN (SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {V_BACKLOG}) WHERE rn = 1 AND op <> 'D') l ON l.k = n.k WHERE n.rn = 1"""
)
def poll_change_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net changes after a version, with the live rows."""
    log = v_backlog(spark, sf_dir)
    live = intervals.current_state(log, ["k"], "seq", "seq", "op").select("k", "value")
    polled = acquire.ChangeTrackingDriver(["k"], "seq", "op", "2020-01-01 00:00:00", 60).poll(log, live, 300, oldest=0)
    return polled.select("k", F.col("__op").alias("change"), F.col("__tt").alias("tt"), "value", F.col("__label").alias("label"))


@query(f"SELECT k, seq, op AS change, tt FROM {V_BACKLOG} WHERE tt >= TIMESTAMP '{AT}'")
def poll_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a log from a boundary on, the boundary read again."""
    polled = acquire.BacklogDriver("tt", ["k"], "op", inclusive=True).poll(v_backlog(spark, sf_dir), moment(AT))
    return polled.select("k", "seq", F.col("__op").alias("change"), F.col("__tt").alias("tt"))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT user_id, event_type, event_id, date_trunc('hour', ts) AS ts FROM events)) WHERE rn = 1 AND event_type <> 'error'")
def replica_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle of poll, apply and remember over a capture log in which one time holds several images of a key."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    log = events.withColumn("lsn", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("op", F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(4)).withColumn("wall", F.col("ts"))
    driver = acquire.CDCDriver(["user_id"], "lsn", "event_id", "op", "wall")
    columns = [("user_id", "int64"), ("event_type", "varchar"), ("event_id", "int64"), ("ts", "timestamp_ntz")]
    store = Lake(spark, scratch_path(spark, "lake")).init()
    copy = replica.Replica(store, "events", ["user_id"], lambda: columns, lambda after: driver.poll(log, after and int(after)))
    copy.sync(None)
    return HistoryTable(store, "events", columns, ["user_id"]).state()


@query(f"SELECT k, min(tt) AS changed_at FROM (SELECT k, max(tt) AS tt FROM {V_BACKLOG} WHERE op <> 'D' GROUP BY k) GROUP BY k ORDER BY changed_at, k LIMIT 25")
def stale_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a cold cache that have waited longest, a batch of them."""
    none = spark.createDataFrame([], "k bigint, mtime timestamp_ntz")
    return acquire.stale(v_backlog(spark, sf_dir), none, ["k"], "tt", "mtime", "op", 25).select("k", "changed_at")


# Captures and migrations


@query(
    f"""WITH a AS (SELECT object_name, member_name FROM {V_CAPTURE} WHERE sample_time = TIMESTAMP '2024-01-03 00:00:00'), b AS (SELECT object_name, member_name FROM {V_CAPTURE} WHERE sample_time = TIMESTAMP '2024-01-02 00:00:00')
SELECT *, 'added' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def capture_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two captures of one relation."""
    return diff.capture_diff(v_capture(spark, sf_dir).drop("ordinal"), moment("2024-01-02"), moment("2024-01-03"), "sample_time")


@query(f"SELECT 'srv' AS dataserver, 'db' AS database, TIMESTAMP '{AT}' AS sample_time, object_name, member_name, ordinal FROM {V_CAPTURE} WHERE object_name IN ('o1', 'o2')")
def capture_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection widened by where and when it was taken, for the named objects only."""
    roles = registry.union_roles(v_capture(spark, sf_dir).drop("sample_time"))
    return registry.capture(roles, "srv", "db", moment(AT), ["o1", "o2"]).select("dataserver", "database", "sample_time", "object_name", "member_name", "ordinal")


@query(f"SELECT sample_time, count(*) AS n, count(DISTINCT object_name || '.' || member_name || '.' || ordinal) AS distinct_rows FROM {V_CAPTURE} GROUP BY 1")
def rows_per_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.per_capture(v_capture(spark, sf_dir), "sample_time")


DIRTY = f"""SELECT DISTINCT p.schema_name, p.object_name FROM (SELECT schema_name, object_name, object_id FROM {V_IDENTITY} WHERE sample_time >= TIMESTAMP '2024-01-20 00:00:00') p
LEFT JOIN (SELECT DISTINCT schema_name, object_name, object_id AS held FROM {V_IDENTITY} WHERE sample_time < TIMESTAMP '2024-01-03 00:00:00') c USING (schema_name, object_name) WHERE p.object_id IS DISTINCT FROM c.held"""


@query(f"SELECT object_name, count(*) AS n FROM {V_IDENTITY} WHERE object_name IN (SELECT object_name FROM ({DIRTY})) GROUP BY 1")
def pruned_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe, find what is dirty, and read those objects only."""
    probes = v_identity(spark, sf_dir)
    late, early = probes.where(F.col("sample_time") >= moment("2024-01-20")), probes.where(F.col("sample_time") < moment("2024-01-03"))
    read = lambda names: probes.where(F.col("object_name").isin(names) if names else F.lit(False)).groupBy("object_name").agg(F.count(F.lit(1)).alias("n"))
    return registry.pruned_capture(late, early, read, ["schema_name", "object_name"])


@query("SELECT event_id, (epoch_us(ts + to_microseconds(CAST(floor(value) AS BIGINT) * 1000)) - epoch_us(ts)) / 1e6 AS skew_seconds FROM events")
def clock_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("local_utc"), (F.col("ts") + F.make_dt_interval(secs=(F.floor("value") / 1000).cast("decimal(18,6)"))).alias("remote_utc"))
    return registry.measure_env(probes).select("event_id", "skew_seconds")


PART_COLUMNS = "(SELECT DISTINCT p_type AS table_name, p_brand AS column_name, CASE WHEN p_size > 25 THEN 'bigint' ELSE 'int' END AS data_type FROM part)"


@query(f"SELECT table_name, string_agg('\"' || column_name || '\" ' || data_type, ', ' ORDER BY column_name || data_type) AS ddl FROM {PART_COLUMNS} GROUP BY 1")
def ddl_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL from columns that a table of the driver names, by type and brand."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("table_name"), F.col("p_brand").alias("column_name"), F.when(F.col("p_size") > 25, "bigint").otherwise("int").alias("data_type")).distinct()
    return codegen.table_ddl(rows.withColumn("o", F.concat("column_name", "data_type")), ["table_name"], order="o")


@query(
    """WITH a AS (SELECT DISTINCT n_name AS c FROM nation WHERE n_nationkey < 15), b AS (SELECT DISTINCT n_name AS c FROM nation WHERE n_nationkey >= 5)
SELECT 'ALTER TABLE "t" ADD COLUMN "' || c || '" int;' AS statement FROM b WHERE c NOT IN (SELECT c FROM a) UNION ALL SELECT 'ALTER TABLE "t" DROP COLUMN "' || c || '";' FROM a WHERE c NOT IN (SELECT c FROM b)
UNION ALL SELECT 'ALTER TABLE "t" ALTER COLUMN "' || c || '" TYPE int;' FROM a WHERE c IN (SELECT c FROM b)"""
)
def migration_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DDL between two revisions of a table whose columns are nations: a control plane's few rows."""
    names = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    old = acquire.ColumnCollection("t", [(n, "text") for n in names[:15]], [], "postgresql")
    new = acquire.ColumnCollection("t", [(n, "int") for n in names[5:]], [], "postgresql")
    return spark.createDataFrame([(s,) for s in migrate.migration_ddl(old, new)], "statement string")


@query("SELECT o_orderkey AS k, o_orderstatus AS st, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS tt_start, '9999' AS tt_end FROM orders")
def temporal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a schema that was given an interval."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("tt_start"), F.lit("9999").alias("tt_end"))
    schema = ttst.temporalize(T.StructType(base.schema.fields[:2]))
    return base.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


INTERN = "(SELECT c_nationkey AS nk, 'r' || c_custkey AS resource_id, c_name AS name, c_mktsegment AS segment FROM customer)"


@query(
    f"""SELECT resource_id, name, tt_start, tt_end, change FROM (
SELECT resource_id, name, TIMESTAMP '2024-01-01 00:00:00' AS tt_start, CASE WHEN nk % 3 = 0 THEN TIMESTAMP '{STAGED_AT}' WHEN nk % 3 = 1 THEN TIMESTAMP '2024-06-01 00:00:00' END AS tt_end, CASE WHEN nk % 3 = 2 THEN 'kept' ELSE 'closed' END AS change FROM {INTERN} WHERE nk % 5 <> 0
UNION ALL SELECT resource_id, name || '!', TIMESTAMP '2024-06-01 00:00:00', NULL, 'inserted' FROM {INTERN} WHERE nk % 5 <> 0 AND nk % 3 = 1
UNION ALL SELECT resource_id, CASE WHEN nk % 3 = 1 THEN name || '!' ELSE name END, TIMESTAMP '2024-06-01 00:00:00', NULL, 'inserted' FROM {INTERN} WHERE nk % 5 = 0 AND nk % 3 <> 0)"""
)
def intern_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full scrape against open rows: kept, changed, new and missing resources."""
    base = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nk"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("resource_id"), F.col("c_name").alias("name"))
    none = F.array().cast("array<string>")
    arrays = [none.alias(c) for c in ("columns_field_name", "columns_datatype", "columns_name", "columns_description")]
    scraped = base.where("nk % 3 <> 0").select("resource_id", F.when(F.col("nk") % 3 == 1, F.concat("name", F.lit("!"))).otherwise(F.col("name")).alias("name"), moment("2024-06-01").alias("updated_at"), *arrays)
    open_rows = base.where("nk % 5 <> 0").select("resource_id", "name", moment("2024-01-01").alias("tt_start"))
    open_columns = spark.createDataFrame([], "resource_id string, field_name string, ordinal int, datatype string, display_name string, description string, tt_start timestamp_ntz")
    found, _ = ttst.intern_catalog(scraped, open_rows, open_columns, moment(STAGED_AT), ["name"], False)
    return found.select("resource_id", "name", "tt_start", "tt_end", "change")


# JSON


def nation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.format_string('{"a": {"k": %d}, "n": "%s", "l": [%d, 7]}', "n_nationkey", "n_name", "n_regionkey").alias("v"), F.format_string('{"a": {"k": %d}, "l": [7], "r": %d}', F.col("n_nationkey") + 1, "n_regionkey").alias("w"))


@query("""SELECT n_nationkey, format('{{"a": {{"k": {}}}, "l": [7], "r": {}}}', n_nationkey + 1, n_regionkey) AS patched, format('{{"a": {{"k": {}}}, "l": [7], "n": "{}", "r": {}}}', n_nationkey + 1, n_name, n_regionkey) AS merged FROM nation""")
def json_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difference applied to the first value gives the second; a merge keeps what the second lacks."""
    rows = nation_json(spark, sf_dir).withColumn("patch", fj.json_diff("v", "w"))
    return rows.select("n_nationkey", fj.json_apply_patch("v", "patch").alias("patched"), fj.json_merge("v", "w").alias("merged"))


@query("""SELECT n_nationkey, format('{{"/a/k": {}, "/l/0": {}, "/l/1": 7, "/n": "{}"}}', n_nationkey, n_regionkey, n_name) AS flat, format('{{"a": {{"k": {}}}, "l": [{}, 7], "n": "{}"}}', n_nationkey, n_regionkey, n_name) AS whole FROM nation""")
def json_flat_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nation_json(spark, sf_dir).select("n_nationkey", fj.json_flatten("v").alias("flat"))
    return rows.select("n_nationkey", "flat", fj.json_unflatten("flat").alias("whole"))


@query("""SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS k, CAST(n_regionkey AS VARCHAR) AS first, n_name || ': ' || n_regionkey || ';7;' AS page FROM nation""")
def json_search_and_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_json(spark, sf_dir).select("n_nationkey", fj.json_search("v", "a.k").alias("k"), fj.json_search("v", "l[0]").alias("first"), fj.template_render("{{ n }}: {% for x in l %}{{ x }};{% endfor %}", "v").alias("page"))


@query("SELECT n_nationkey, CAST(1 AS INT) AS ordinal, CAST(n_regionkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 2, '7' FROM nation")
def json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fj.each_value(nation_json(spark, sf_dir), "v", "$.l", ["n_nationkey"])


@query("""SELECT n_nationkey, '{"key":' || n_nationkey || ',"none":null,"name":"' || n_name || '"}' AS made, '["' || n_name || '","x"]' AS listed, true AS valid, n_regionkey = 0 AS also_valid FROM nation""")
def json_made_and_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    made = fj.object_of(key=F.col("n_nationkey"), none=F.lit(None).cast("string"), name=F.col("n_name"))
    broken = F.when(F.col("n_regionkey") == 0, F.lit("[1]")).otherwise(F.lit("[1"))
    return rows.select("n_nationkey", made.alias("made"), fj.array_of(F.col("n_name"), F.lit("x")).alias("listed"), fj.is_valid(made).alias("valid"), fj.is_valid(broken).alias("also_valid"))


@query("SELECT r_name, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def arrays_zipped_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as parallel arrays in order, and back."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    zipped = fj.zip_rows(rows, ["r_name"], {"n_nationkey": "keys", "n_name": "names"}, "n_nationkey")
    return fj.unzip_rows(zipped, ["r_name"], {"keys": "n_nationkey", "names": "n_name"}).drop("ordinal")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS again FROM events""")
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", fj.to_entries("props").alias("e"))
    return rows.select("event_id", F.get("e", F.lit(0))["value"].alias("value"), fj.from_entries("e").alias("again"))


@query("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation tunnelled through one text, opened again."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", fj.envelope(["name", "region"], F.array(F.array("n_name", F.col("n_regionkey").cast("string")))).alias("payload"))
    return fj.open_envelope(rows, "payload", ["n_nationkey"]).select("n_nationkey", F.col("row")["name"].alias("name"), F.col("row")["region"].alias("region"))


# Texts and times


@query("""SELECT c_custkey, '[' || replace(c_name, ']', ']]') || ']' AS quoted, c_mktsegment AS last_part, c_name AS before_it, NULL::VARCHAR AS beyond, sha256(c_name) AS hash FROM customer""")
def names_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = F.concat("c_name", F.lit("."), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.quote_name(F.col("c_name")).alias("quoted"), text.name_part(dotted, 1).alias("last_part"), text.name_part(dotted, 2).alias("before_it"), text.name_part(dotted, 3).alias("beyond"), text.content_hash(F.col("c_name")).alias("hash"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(epoch(date_trunc('second', ts))::BIGINT AS VARCHAR) ELSE event_type END AS seconds, strftime(date_trunc('second', ts) + INTERVAL 5 SECOND, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS bumped FROM events""")
def times_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are times as seconds, others as they are; ISO texts moved by seconds."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return rows.select("event_id", extract.epoch_or_text(F.when(F.col("event_id") % 2 == 0, F.col("t")).otherwise(F.col("event_type"))).alias("seconds"), extract.bump(F.col("t"), 5).alias("bumped"))


@query("""SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS missing, '{"a":' || user_id || '}' AS nested FROM events""")
def normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a source with the known columns only: nulls for what it lacks, JSON text for what is nested."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.struct(F.col("user_id").alias("a")).alias("nested"))
    return extract.normalise(rows, rows.schema, ["event_id", "event_type", "missing", "nested"])


@query("SELECT event_id, '00-' || lpad(lower(to_hex(event_id + 1)), 32, '0') || '-' || lpad(lower(to_hex(user_id + 1)), 16, '0') || CASE WHEN event_id % 2 = 0 THEN '-01' ELSE '-00' END AS header FROM events")
def trace_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    wide = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    return rows.select("event_id", provenance.traceparent(wide(F.col("event_id") + 1, 32), wide(F.col("user_id") + 1, 16), F.col("event_id") % 2 == 0).alias("header"))


WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x{80}-\x{FFFF}]+'), lambda t: t <> '')"
#: Documents after the second batch: one in ten deleted, one in ten written anew, one in ten added.
CHANGED_DOCUMENTS = f"SELECT doc_id, {WORDS} AS w FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN concat('The end of the ', coalesce(text, '')) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0)"


def text_index(spark: SparkSession, sf_dir: str) -> textsearch.TextIndex:
    """A stored index of the documents, and a batch of insertions, updates and deletions applied to it."""
    index = textsearch.TextIndex(Lake(spark, scratch_path(spark, "lake")).init(), "documents", ["text"], "doc_id")
    docs, kind = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 10
    index.apply(docs.where(kind != 2).withColumn("__op", F.lit("I")).withColumn("__version", F.lit(1)), ranges=16)
    op = F.when(kind == 0, "D").when(kind == 1, "U").otherwise("I")
    changed = F.when(kind == 1, F.concat(F.lit("The end of the "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    index.apply(docs.where(kind < 3).select("doc_id", changed.alias("text"), op.alias("__op"), F.lit(2).alias("__version")), ranges=16)
    return index


@query(f"SELECT doc_id, len(list_filter(w, lambda t: t = 'the' OR t = 'end')) AS hits FROM ({CHANGED_DOCUMENTS}) WHERE list_contains(w, 'the') AND list_contains(w, 'end')")
def text_search_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with all words of a query, from a stored index after changes: files of other terms are not opened."""
    return text_index(spark, sf_dir).words("The end").withColumnRenamed("key", "doc_id")


@query(f"SELECT doc_id, hits FROM (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS hits FROM ({CHANGED_DOCUMENTS})) WHERE hits > 0")
def text_phrase_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a phrase, by the positions in a stored index after changes."""
    return text_index(spark, sf_dir).phrase("of the").withColumnRenamed("key", "doc_id")


@query(f"SELECT doc_id, hits FROM (SELECT doc_id, len(list_filter(w, lambda t: starts_with(t, 'th'))) AS hits FROM ({CHANGED_DOCUMENTS})) WHERE hits > 0")
def text_prefix_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with words of a beginning, by the range of terms, after the index was merged."""
    index = text_index(spark, sf_dir)
    index.merge(ranges=16)
    return index.prefix("th").withColumnRenamed("key", "doc_id")


# Relations


@query(
    """WITH i AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), d AS (SELECT user_id, ts FROM events WHERE event_type = 'error')
SELECT event_id, user_id FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = i.user_id AND d.ts >= i.ts)"""
)
def undeleted_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    born, gone = events.where("event_type = 'signup'").select("event_id", "user_id", "ts"), events.where("event_type = 'error'").select("user_id", F.col("ts").alias("gone_at"))
    return relate.undeleted(born, gone, ["user_id"], "ts", "gone_at").select("event_id", "user_id")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS published FROM customer")
def members_of_a_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return relate.members(table(spark, sf_dir, "customer").select("c_custkey"), named, {"c_custkey": "o_custkey"}, "published")


@query("SELECT p_partkey, category FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS category FROM part) WHERE category IN ('cold', 'widget')")
def category_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return relate.by_category(rows, "words", ["cold", "widget"])


HISTOGRAM = """SELECT '{c}' AS column_name, step, CAST(range_high_key AS DOUBLE) AS range_high_key, equal_rows, range_rows FROM (WITH v AS (SELECT {c} AS v, count(*) AS k FROM lineitem GROUP BY 1), c AS (SELECT *, sum(k) OVER (ORDER BY v) AS upto, sum(k) OVER () AS total FROM v),
s AS (SELECT *, CAST(floor(CAST((upto - k) * 8 AS DOUBLE) / total) AS INT) AS step FROM c) SELECT step, arg_max(k, v) AS equal_rows, CAST(sum(k) - arg_max(k, v) AS BIGINT) AS range_rows, max(v) AS range_high_key FROM s GROUP BY step)"""


@query(HISTOGRAM.replace("{c}", "l_quantity") + " UNION ALL " + HISTOGRAM.replace("{c}", "l_linenumber"))
def histograms_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.lateral_histograms(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"], 8)


@query("""SELECT n_regionkey, coalesce('[' || string_agg('"' || n_name || '"', ',' ORDER BY n_name) FILTER (WHERE n_nationkey % 2 = 1) || ']', '[]') AS odd FROM nation GROUP BY 1""")
def collected_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.collect_where(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", F.col("n_nationkey") % 2 == 1, "odd")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("SELECT i FROM generate_series(0, (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F')) t(i) WHERE i NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def sequence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that the keys of finished orders leave out, of the sequence up to the last one."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    last = orders.agg(F.max("o_orderkey")).first()[0] or 0
    return relate.sequence(spark, last + 1).join(orders, F.col("i") == F.col("o_orderkey"), "left_anti")


@query("SELECT max(text) AS greatest FROM conversations")
def greatest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest of long texts, beyond where file statistics are cut."""
    return relate.greatest(table(spark, sf_dir, "conversations"), "text")


@query("SELECT k, st FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders) ORDER BY st NULLS FIRST, k LIMIT 50")
def nulls_come_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("st"))
    return relate.nulls_first(rows, ["st", "k"], 50)


@query("SELECT p_partkey, (p_size & 1) <> 0 AS a, (p_size & 2) <> 0 AS b, (p_size & 4) <> 0 AS c, abs(p_size - 25) AS off FROM part")
def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *relate.flags_of(F.col("p_size"), ["a", "b", "c"]), F.abs(F.col("p_size") - 25).alias("off"))


@query("SELECT r_name AS source, count(*) AS columns, count(DISTINCT n_nationkey) AS tables FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def columns_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("source"))
    return relate.columns_of_sources(table(spark, sf_dir, "customer"), sources, "c_nationkey", "source")


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def ranked_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return profile.ranked(rows, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution(table(spark, sf_dir, "events"), ["event_type"], 3)


@query("SELECT n_nationkey AS id, 'n' AS source, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 'r', r_name FROM region")
def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry loaded anew from all its sources as a new version; the one before stays readable."""
    store = Lake(spark, scratch_path(spark, "lake")).init()
    store.create_table("registry", [("id", "int32"), ("source", "varchar"), ("name", "varchar")])
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("n").alias("source"), F.col("n_name").alias("name"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.lit("r").alias("source"), F.col("r_name").alias("name"))
    store.write("registry", nations)
    store.replace("registry", nations.unionByName(regions))
    return store.read("registry")


# Fingerprints and semi-structured values

CONTAINED = ["region", "nation", "supplier", "customer", "part", "orders"]
ALL_CELLS = " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t}"
    for t, columns in {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]}.items()
    for c in columns
)


@query(f"WITH cells AS (SELECT DISTINCT c, v FROM ({ALL_CELLS}) WHERE v IS NOT NULL), n AS (SELECT c, count(*) AS n FROM cells GROUP BY c), m AS (SELECT x.c AS a, y.c AS b, count(*) AS m FROM cells x JOIN cells y ON x.v = y.v AND x.c <> y.c GROUP BY 1, 2) SELECT m.a, m.b, n.n FROM m JOIN n ON n.c = m.a WHERE m.m = n.n")
def columns_within_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column whose values all stand in another one, of all columns of six tables, by bitmap fingerprints."""
    return fingerprints.contained({t: table(spark, sf_dir, t).drop("o_orderdate") for t in CONTAINED})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, replace(props, ' ', '') AS props FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def shredded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot keys of a JSON column as typed columns in a lake, filtered by one and put together again."""
    events = table(spark, sf_dir, "events").select("event_id", variants.parsed(F.col("props")).alias("props"))
    types = variants.path_types(events, "props")
    keys = variants.hot_keys(types, events.count())
    held = variants.shred(events, "props", keys)
    store = Lake(spark, scratch_path(spark, "lake")).init()
    store.create_table("events", [("event_id", "int64"), *((variants.shredded_name("props", k), kind) for k, kind in keys.items()), ("props", "variant")])
    store.write("events", held.repartitionByRange(8, variants.shredded_name("props", "k")))
    found = store.read("events", where=[(variants.shredded_name("props", "k"), ">", 50)])
    whole = variants.unshred(found.withColumn("k", F.col(variants.shredded_name("props", "k"))), "props", keys)
    return whole.select("event_id", "k", F.to_json("props").alias("props"))
