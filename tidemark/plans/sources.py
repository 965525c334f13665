"""Registered queries over files, registries, sessions and streams made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import extract, text
from tidemark.functions import json as fj
from tidemark.operators import access, codegen, essence, migrate, properties, provenance, registry, requests
from tidemark.plans.catalogue import LINES, V_COLUMNS, query, star, table, v_columns
from tidemark.session import scratch_path
from tidemark.sources import databases, files, lake
from tidemark.sources.lake import CurrentTable, Lake
from tidemark.streaming import state
from tidemark.streaming.replay import replay

# Files


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0")
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated file under a schema; rows that don't fit it are dropped."""
    path = scratch_path(spark, "tsv")
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("c_custkey"), "c_name", "c_mktsegment")
    rows.write.options(header=True, sep="\t").csv(path)
    return files.delimited(spark, path, schema="c_custkey bigint, c_name string, c_mktsegment string")


@query("SELECT c_mktsegment, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY 1")
def delimited_as_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated file as a view of text columns, asked in SQL."""
    path = scratch_path(spark, "tsv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").write.options(header=True, sep="\t").csv(path)
    codegen.delimited_view(spark, "delimited_customers", path)
    return spark.sql("SELECT c_mktsegment, CAST(count(c_custkey) AS STRING) AS n FROM delimited_customers GROUP BY c_mktsegment")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON lines under a schema that is given and not inferred."""
    path = scratch_path(spark, "json")
    table(spark, sf_dir, "supplier").write.json(path)
    return files.json_records(spark, path, "s_suppkey bigint, s_name string, s_acctbal double", whole_files=False)


@query("SELECT valid, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (SELECT c_nationkey % 2 = 0 AS valid, sum(length(c_name) + 3) + CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS size FROM customer GROUP BY c_nationkey) GROUP BY valid")
def json_documents_in_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files of a tree of folders, one for each nation, and whether they are JSON: every other one lacks its end."""
    path = scratch_path(spark, "documents")
    names = F.concat(F.lit("["), F.array_join(F.transform(F.collect_list("c_name"), lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ","))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(names, F.when(F.col("c_nationkey") % 2 == 0, "]").otherwise("")).alias("value"))
    rows.repartition(1).write.partitionBy("c_nationkey").text(path)
    found = files.json_documents(spark, path, "*.txt")
    return found.groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("SELECT count(*) AS rows, true AS measured FROM orders")
def parquet_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder with their rows and footers, without reading a column."""
    path = scratch_path(spark, "files")
    table(spark, sf_dir, "orders").repartition(8).write.parquet(path)
    held, ends = files.parquet_files(spark, path), files.footers(spark, path)
    both = held.join(ends.withColumn("name", F.substring_index("path", "/", -1)), F.substring_index(held["path"], "/", -1) == F.col("name"))
    return both.agg(F.sum("rows").alias("rows"), (F.bool_and((F.col("footer_size") > 0) & (F.col("footer_size") < ends["size"])) & (F.count(F.lit(1)) == 8)).alias("measured"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def files_behind_a_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over the files of two writes."""
    orders, paths = table(spark, sf_dir, "orders"), [scratch_path(spark, "facade") for _ in range(2)]
    orders.where("o_orderkey % 2 = 0").write.parquet(paths[0])
    orders.where("o_orderkey % 2 = 1").write.parquet(paths[1])
    spark.sql(codegen.view_facade("facade_orders", paths, ["o_orderkey", "o_orderstatus"]))
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM facade_orders GROUP BY o_orderstatus")


# Captures, plans and access


@query("SELECT captured_at, count(*) AS n, min(brand) AS least FROM (SELECT TIMESTAMP '2024-01-01 00:00:00' AS captured_at, p_brand AS brand FROM part WHERE p_size > 10 UNION ALL SELECT TIMESTAMP '2024-02-01 00:00:00', p_brand FROM part) GROUP BY 1")
def captured_essences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures of a relation in a lake, the second one wider."""
    store, parts = Lake(spark, scratch_path(spark, "lake")).init(), table(spark, sf_dir, "part")
    essence.capture_essence(store, "parts", parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), "p_size"), lake.dt.datetime(2024, 1, 1), F.col("p_size") > 10)
    essence.capture_essence(store, "parts", parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), "p_type"), lake.dt.datetime(2024, 2, 1))
    return store.read("parts").groupBy(F.col("captured_at").cast("timestamp_ntz").alias("captured_at")).agg(F.count(F.lit(1)).alias("n"), F.min("brand").alias("least"))


@query(LINES)
def essence_from_a_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join graph kept in a lake as rows, read back and projected."""
    store = Lake(spark, scratch_path(spark, "lake")).init()
    star().save(store)
    return essence.projection(essence.Config.load(store), "d", "line", lambda name: table(spark, sf_dir, name))


PROVISIONED = ["Brand#11", "Brand#22", "Brand#33"]


@query(f"SELECT lower(replace(table_name, '#', '_')) AS table_name, column_name FROM {V_COLUMNS} WHERE table_name IN ('Brand#11', 'Brand#22', 'Brand#33')")
def provisioned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's targets made from captured schemas, and widened where a later capture has more columns."""
    store, columns = Lake(spark, scratch_path(spark, "lake")).init(), v_columns(spark, sf_dir)
    plan = migrate.SamplingPlan(store)
    for brand in PROVISIONED:
        plan.declare("s", "d", brand, brand.lower().replace("#", "_"), "o")
    fixed = {"dataserver": "s", "database": "d", "grouping_kind": "table"}
    rows = columns.select(F.col("table_name").alias("object_name"), F.col("column_name").alias("member_name"), F.col("o").alias("ordinal"), "data_type", *[F.lit(v).alias(k) for k, v in fixed.items()])
    captures = rows.where("ordinal % 2 = 0").withColumn("sample_time", F.lit(lake.dt.datetime(2024, 1, 1))).unionByName(rows.withColumn("sample_time", F.lit(lake.dt.datetime(2024, 2, 1))))
    plan.provision(captures, lake.dt.datetime(2024, 1, 15))
    plan.provision(captures, lake.dt.datetime(2024, 2, 15))
    return store.current_columns().where(F.col("table_name").startswith("brand_")).select("table_name", "column_name")


@query("SELECT 'c' || c_custkey AS principal, 'report' AS resource, n_regionkey % 2 = 0 AND n_nationkey % 5 <> 0 AS allowed FROM customer JOIN nation ON c_nationkey = n_nationkey")
def access_of_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers may read: regions allow, nations deny, and both hold for their members."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    of = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    members = customers.select(of("c", "c_custkey").alias("principal"), of("n", "c_nationkey").alias("member_of")).unionByName(nations.select(of("n", "n_nationkey").alias("principal"), of("r", "n_regionkey").alias("member_of")))
    allow = nations.where("n_regionkey % 2 = 0").select(of("r", "n_regionkey").alias("principal"), F.lit("all").alias("resource"), F.lit("allow").alias("effect")).distinct()
    deny = nations.where("n_nationkey % 5 = 0").select(of("n", "n_nationkey").alias("principal"), F.lit("report").alias("resource"), F.lit("deny").alias("effect"))
    resources = spark.createDataFrame([("report", "all")], "resource string, parent string")
    wanted = customers.select(of("c", "c_custkey").alias("principal"), F.lit("report").alias("resource"))
    return access.access(allow.unionByName(deny), members, resources, wanted).select("principal", "resource", "allowed")


@query("SELECT table_name, 'COPY (SELECT * FROM read_csv(''in/' || table_name || '.csv'', all_varchar = true)) TO ''out/' || table_name || '.parquet'' (FORMAT parquet, FIELD_IDS {' || string_agg('''' || column_name || ''': ' || o, ', ' ORDER BY o) || '});' AS script FROM " + V_COLUMNS + " GROUP BY table_name")
def copy_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each captured table that copies its file under the columns' ids."""
    name = F.col("table_name")
    return codegen.copy_script(v_columns(spark, sf_dir), "table_name", F.concat(F.lit("in/"), name, F.lit(".csv")), F.concat(F.lit("out/"), name, F.lit(".parquet")), ids="o")


@query("SELECT s_suppkey, 'https://' || s_name || '/' || s_nationkey || '/{unknown}' AS location FROM supplier")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates filled from maps of values; a slot without a value stays."""
    suppliers = table(spark, sf_dir, "supplier")
    templates = suppliers.select(F.col("s_suppkey").alias("name"), F.lit("https://{host}/{nation}/{unknown}").alias("template"))
    values = suppliers.select(F.col("s_suppkey").alias("name"), F.create_map(F.lit("host"), "s_name", F.lit("nation"), F.col("s_nationkey").cast("string")).alias("values"))
    return codegen.fill(templates, values).select(F.col("name").alias("s_suppkey"), "location")


@query("SELECT 'u' || user_id || '.' || event_type AS object_name, 'value' AS property, CAST(event_id AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_id % 10 <> 0")
def current_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties that a log of changes leaves, as a relation of one class."""
    events = table(spark, sf_dir, "events")
    name = [F.concat(F.lit("u"), "user_id"), F.col("event_type"), F.lit(None).cast("string")]
    log = events.select(F.lit("table").alias("class"), *[c.alias(f"name_{i}") for i, c in enumerate(name, 1)], F.lit("value").alias("property"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"), (F.col("event_id") % 10 == 0).alias("deleted"))
    return properties.facade(log, "table")


@query(f"SELECT column_name, data_type FROM {V_COLUMNS} WHERE table_name = 'Brand#12'")
def object_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's rows of one object, named in dotted and quoted form."""
    registry = v_columns(spark, sf_dir).select(F.lit("parts.all").alias("schema_name"), F.col("table_name").alias("object_name"), "column_name", "data_type")
    return properties.object_info(registry, "[parts.all].[Brand#12]").select("column_name", "data_type")


# Sessions and texts


@query("SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def session_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows chosen by a value that the session keeps."""
    orders = table(spark, sf_dir, "orders")
    provenance.set_session(spark, "tidemark.customer", str(orders.agg(F.max("o_custkey")).first()[0]))
    return orders.where(F.col("o_custkey") == int(provenance.get_session(spark, "tidemark.customer") or 0)).select("o_orderkey")


@query("SELECT c_mktsegment AS author, 'load ' || c_mktsegment AS commit_message, '00-' || c_mktsegment AS trace, count(*) AS rows FROM customer GROUP BY c_mktsegment")
def commits_and_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who made each commit, why and in which trace, with the rows that it added."""
    store, customers = Lake(spark, scratch_path(spark, "lake")).init(), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    store.create_table("customer", [("c_custkey", "int64"), ("c_mktsegment", "varchar")])
    for (segment,) in sorted(customers.select("c_mktsegment").distinct().collect()):
        store.write("customer", customers.where(F.col("c_mktsegment") == segment), provenance=provenance.commit_provenance(segment, f"load {segment}", f"00-{segment}"))
    rows = store.list_files("customer").groupBy(F.col("begin_snapshot").alias("snapshot_id")).agg(F.sum("record_count").alias("rows"))
    trace = F.get_json_object("commit_extra_info", "$.traceparent").alias("trace")
    return store.snapshots().join(rows, "snapshot_id").select("author", "commit_message", trace, "rows")


@query("SELECT CASE event_type WHEN 'delete' THEN 'D' WHEN 'insert' THEN 'I' ELSE 'U' END AS code, 's_' || translate(event_type || '.x-y', '.-', '__') AS schema_name, count(*) AS n, 3 AS numbers FROM events GROUP BY event_type")
def session_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and a table function that the session has in SQL."""
    text.register_sql(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("macro_events")
    return spark.sql("SELECT op_code(event_type) AS code, domain_schema(concat(event_type, '.x-y')) AS schema_name, count(*) AS n, (SELECT CAST(count(*) AS INT) FROM sequence_table(3)) AS numbers FROM macro_events GROUP BY event_type")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def variant_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of any type as texts."""
    return table(spark, sf_dir, "events").select("event_id", extract.variant_text(F.variant_get(F.parse_json("props"), "$.k", "variant")).alias("k"))


@query("""SELECT s_suppkey, '{"name": "' || s_name || '", "nation": ' || s_nationkey || '}' AS doc FROM supplier""")
def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML texts as JSON with ordered keys."""
    yaml = F.concat(F.lit("nation: "), F.col("s_nationkey").cast("string"), F.lit("\nname: '"), "s_name", F.lit("'\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fj.yaml_to_json(yaml).alias("doc"))


@query("SELECT s_suppkey, 'Driver={d};Server=h' || s_nationkey || ';Database=' || s_name || ';Encrypt=yes;' AS connection FROM supplier")
def connection_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection texts of a table of connections, without passwords."""
    built = databases.odbc_column(F.lit("d"), F.concat(F.lit("h"), F.col("s_nationkey").cast("string")), F.col("s_name"), F.lit("Encrypt=yes"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", built.alias("connection"))


# Replicas and streams


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN 'new' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0")
def net_changes_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A current-state replica after net changes: upserts and deletes as one commit."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    copy = CurrentTable(Lake(spark, scratch_path(spark, "lake")).init(), "customer", [("c_custkey", "int64"), ("segment", "varchar")], ["c_custkey"]).create()
    copy.apply_net(customers, customers.limit(0).select("c_custkey"))
    copy.apply_net(customers.where("c_custkey % 5 = 1").withColumn("segment", F.lit("new")), customers.where("c_custkey % 5 = 0").select("c_custkey"))
    return copy.state()


def windowed(spark: SparkSession, found: DataFrame) -> DataFrame:
    target = scratch_path(spark, "windows")
    found.writeStream.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).format("parquet").start(target).awaitTermination()
    return spark.read.schema(found.schema).parquet(target)


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS begin, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOUR, any_value(ts), TIMESTAMP '1970-01-01 00:00:00') + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of six hours that the watermark has closed."""
    stream = replay(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts")
    found = windowed(spark, state.tumbling(stream, ["event_type"], "ts", "6 hours", "1 hour"))
    return found.select("event_type", F.col("begin").cast("timestamp_ntz").alias("begin"), "n")


@query("SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key and time once, though a replayed source repeats them."""
    events = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp").alias("day"), "user_id", "event_type", "ts")
    found = windowed(spark, state.first_seen(replay(events, "ts").drop("ts"), ["user_id", "event_type"], "day", "60 days"))
    return found.select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day"))


# Constraints, statements and requests


@query("SELECT DISTINCT p_type AS object_name, p_type || '_' || p_brand AS grouping_name, member_name, CAST(ordinal AS BIGINT) AS ordinal, p_brand AS referenced_object, referenced_member FROM part, (VALUES ('a', 1, 'k2'), ('b', 2, 'k1')) AS v(member_name, ordinal, referenced_member)")
def composite_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referencing columns and what they stand for, of keys of two columns that are referenced in the other order."""
    parts = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    cell = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("column_name", "ordinal", "position_in_unique_constraint"), strict=True)])
    keys = parts.select(F.col("p_brand").alias("table_name")).distinct().select("table_name", F.concat(F.lit("pk_"), "table_name").alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type"), F.lit(None).cast("string").alias("unique_constraint_name"), F.lit(None).cast("string").alias("delete_rule"), F.explode(F.array(cell("k1", 1, None), cell("k2", 2, None))).alias("c"))
    references = parts.select(F.col("p_type").alias("table_name"), F.concat_ws("_", "p_type", "p_brand").alias("constraint_name"), F.lit("FOREIGN KEY").alias("constraint_type"), F.concat(F.lit("pk_"), "p_brand").alias("unique_constraint_name"), F.lit("NO ACTION").alias("delete_rule"), F.explode(F.array(cell("a", 1, 2), cell("b", 2, 1))).alias("c"))
    shape = lambda rows: rows.select(F.lit("main").alias("schema_name"), "table_name", "constraint_name", "constraint_type", "unique_constraint_name", "delete_rule", "c.column_name", F.col("c.ordinal").cast("bigint").alias("ordinal"), F.col("c.position_in_unique_constraint").cast("bigint").alias("position_in_unique_constraint"))
    found = registry.foreign_keys(shape(keys).unionByName(shape(references)))
    return found.select("object_name", "grouping_name", "member_name", "ordinal", "referenced_object", "referenced_member")


@query("SELECT event_type AS kind, 'events of ' || event_type AS view_name, count(*) AS n FROM events GROUP BY event_type")
def statements_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view for each row of a registry, made by the statement that the row asks for, and read."""
    events = table(spark, sf_dir, "events")
    events.createOrReplaceTempView("statement_events")
    rows = events.select(F.col("event_type").alias("kind")).distinct().withColumn("view_name", F.concat(F.lit("events of "), "kind"))
    made = codegen.execute_rows(spark, rows, "CREATE OR REPLACE TEMPORARY VIEW {view_name} AS SELECT * FROM statement_events WHERE event_type = '{kind}'", ["kind"])
    found: DataFrame | None = None
    for each in made:
        some = spark.table(f"`{each['row']['view_name']}`").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("view_name", F.lit(each["row"]["view_name"]))
        found = some if found is None else found.unionByName(some)
    return found


@query(
    """WITH r AS (SELECT 'http://h/' || user_id AS url, ts, event_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS code FROM events),
g AS (SELECT url, max(CASE WHEN code = 200 THEN ts END) AS good, max(CASE WHEN code = 200 THEN event_id END) AS good_id FROM r GROUP BY url),
f AS (SELECT r.url, count(*) AS failures FROM r JOIN g USING (url) WHERE code = 500 AND (g.good IS NULL OR r.ts > g.good OR (r.ts = g.good AND r.event_id > g.good_id)) GROUP BY r.url)
SELECT url, reason FROM (SELECT g.url, CASE WHEN coalesce(failures, 0) > 0 AND failures < 3 THEN 'failed' WHEN coalesce(failures, 0) = 0 AND good < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR THEN 'stale' END AS reason FROM g LEFT JOIN f USING (url)) WHERE reason IS NOT NULL"""
)
def requests_to_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log of requests says must be fetched again: failures, and responses that are too old."""
    log = requests.RequestLog(Lake(spark, scratch_path(spark, "lake")).init()).create()
    events = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", 500).otherwise(200)
    log.record(events.select(F.concat(F.lit("http://h/"), "user_id").alias("request_url"), F.lit("GET").alias("request_method"), code.alias("response_status_code"), F.col("ts").cast("timestamp_ntz").alias("requested_at"), F.col("event_id").alias("seq")))
    now = F.lit(events.agg(F.max(F.col("ts").cast("timestamp_ntz"))).first()[0])
    return log.due(now, 6 * 3600).select(F.col("request_url").alias("url"), "reason")
