"""Lake, essences, migrations, control stores, sources, functions and streams on fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import types as tt
from tidemark.functions import extract, text
from tidemark.functions import json as fj
from tidemark.operators import access, acquire, codegen, diff, essence, migrate, profile, properties, provenance, registry, replica, textsearch
from tidemark.sources import databases, files, lake, paged
from tidemark.streaming import sinks, state
from tidemark.streaming.replay import replay

D = [dt.datetime(2026, 1, d) for d in range(1, 10)]


@pytest.fixture
def store(spark, tmp_path):
    return lake.Lake(spark, f"file://{tmp_path}/lake").init(when=D[0])


# Lake


def test_the_catalog_has_28_tables():
    assert len(lake.CATALOG) == 28
    assert lake.catalog_schema("snapshot").names == ["snapshot_id", "snapshot_time", "schema_version", "next_catalog_id", "next_file_id"]


def test_a_lake_versions_rows_and_columns(spark, store):
    assert store.state() == lake.WriterState(0, 1, 0, 0)
    store.create_table("widget", [("id", "int64"), ("name", "varchar")], when=D[1])
    store.write("widget", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), when=D[2], provenance={"author": "me"})
    assert store.reconcile_columns("widget", [("id", "int64"), ("price", "float64")], when=D[3]) == ["price"]
    assert store.reconcile_columns("widget", [("price", "float64")]) == []
    store.write("widget", spark.createDataFrame([(3, "c", 1.5)], "id long, name string, price double"), when=D[4])
    store.rename_column("widget", "name", "label", when=D[5])
    rows = sorted(tuple(r) for r in store.read("widget").collect())
    assert rows == [(1, "a", None), (2, "b", None), (3, "c", 1.5)] and store.read("widget").columns == ["id", "label", "price"]
    assert store.read("widget", when=D[2]).columns == ["id", "name"] and store.read("widget", version=2).count() == 2
    assert [r["id"] for r in store.changes("widget", 2, 4).collect()] == [3]
    with pytest.raises(LookupError):
        store.read("widget", version=0)
    assert [r["schema_version"] for r in store.snapshots().collect()] == [0, 1, 1, 2, 2, 3]
    assert store.snapshots().where("author = 'me'").first()["snapshot_id"] == 2
    assert store.table_info().first()["rows"] == 3
    store.compact("widget", when=D[6])
    assert store.list_files("widget").count() == 1 and store.read("widget").count() == 3 and store.read("widget", version=2).count() == 2
    assert store.open("v_") == ["v_widget"] and spark.sql("select count(*) c from v_widget").first()["c"] == 3
    store.drop_table("widget")
    assert store.current_tables().isEmpty() and store.read("widget", version=4).count() == 3


def test_partitions_prune_and_conflicts_fail(spark, store):
    store.create_table("t", [("server", "varchar"), ("v", "int64")])
    store.set_partitioning("t", ["server"])
    store.write("t", spark.createDataFrame([("a", 1), ("b", 2)], "server string, v long"))
    read = store.read("t").where("server = 'a'")
    assert [r["v"] for r in read.collect()] == [1]
    assert "PartitionFilters: [isnotnull(server" in read._jdf.queryExecution().toString()
    other = lake.Lake(spark, store.path).init()
    other.create_table("u", [("v", "int64")])
    with pytest.raises(lake.CommitConflict):
        store.create_table("w", [("v", "int64")])


LOG = [(1, 1, "a", "I", 10), (2, 2, "b", "I", 10), (3, 3, "c", "I", 10), (4, 2, "b2", "U", 11), (5, 2, "b3", "U", 12), (6, 3, None, "D", 13), (7, 4, "d", "I", 13)]


def test_history_keeps_versions_and_batches_do_not_matter(spark, store):
    log = spark.createDataFrame([(*r[:4], D[0] + dt.timedelta(hours=r[4])) for r in LOG], "seq int, id long, v string, op string, ts timestamp_ntz")
    driver = acquire.BacklogDriver("ts", ["id"], "op")
    states = []
    for name, cuts in (("one", [None]), ("many", [9, 10, 11, 12])):
        table = lake.HistoryTable(store, name, [("id", "int64"), ("v", "varchar")], ["id"]).create()
        for i, after in enumerate(cuts):
            upto = cuts[i + 1] if i + 1 < len(cuts) else 99
            at = None if after is None else D[0] + dt.timedelta(hours=after)
            polled = driver.poll(log, at).where(F.col("ts") <= F.lit(D[0] + dt.timedelta(hours=upto)))
            stapled = acquire.staple(polled, first=table.next_version())
            assert table.apply(stapled) >= 1
            assert table.apply(stapled) == 0
        states.append([{r["id"]: r["v"] for r in table.state(version=v).collect()} for v in range(1, 5)])
    assert states[0] == states[1] == [{1: "a", 2: "b", 3: "c"}, {1: "a", 2: "b2", 3: "c"}, {1: "a", 2: "b3", 3: "c"}, {1: "a", 2: "b3", 4: "d"}]
    net = lake.CurrentTable(store, "net", [("id", "int64"), ("v", "varchar")], ["id"]).create()
    net.apply_net(spark.createDataFrame([(1, "a"), (3, "c")], "id long, v string"), spark.createDataFrame([], "id long"))
    net.apply_net(spark.createDataFrame([(1, "z")], "id long, v string"), spark.createDataFrame([(3,)], "id long"))
    assert {r["id"]: r["v"] for r in net.state().collect()} == {1: "z"}
    assert diff.except_diff(net.state(), net.state(version=1)).count() == 3


# Essences, migrations, plans


def config():
    c = essence.Config()
    c.add("catalog_source", {"dialect": "x", "essence": "column", "where_sql": "o.kind = 'T'", "change_signal": "o.modified"}, {"dialect": "x", "essence": "plain", "from_sql": "sys.schemas"})
    c.add("catalog_attr", {"dialect": "x", "essence": "column", "ord": 2, "attr": "member", "expr": "c.name"}, {"dialect": "x", "essence": "column", "ord": 1, "attr": "object", "expr": "concat(s.name, '.', o.name)"}, {"dialect": "x", "essence": "column", "ord": 3, "attr": "default_expr", "expr": "d.text"}, {"dialect": "x", "essence": "plain", "ord": 1, "attr": "n", "expr": "name"})
    for alias, expr, root in (("o", "sys.objects", 1), ("s", "sys.schemas", 0), ("c", "sys.columns", 0), ("d", "sys.defaults", 0)):
        c.add("catalog_table", {"dialect": "x", "essence": "column", "alias": alias, "expr": expr, "is_root": root})
    c.add("catalog_key", {"dialect": "x", "table_name": "sys.objects", "ord": 0, "col": "object_id"}, {"dialect": "x", "table_name": "sys.schemas", "ord": 0, "col": "schema_id"})
    c.add("catalog_join", {"dialect": "x", "essence": "column", "child": "c", "parent": "o"}, {"dialect": "x", "essence": "column", "child": "c", "parent": "d", "child_col": "default_id", "parent_col": "id", "is_outer": 1}, {"dialect": "x", "essence": "column", "child": "o", "parent": "s"})
    return c


def test_essences_join_by_metadata(spark, store):
    tables = {
        "sys.objects": spark.createDataFrame([(1, 7, "t", "T", 5), (2, 7, "v", "V", 9), (3, 7, "u", "T", 1)], "object_id int, schema_id int, name string, kind string, modified int"),
        "sys.schemas": spark.createDataFrame([(7, "dbo")], "schema_id int, name string"),
        "sys.columns": spark.createDataFrame([(1, "a", None), (1, "b", 4), (2, "c", None), (3, "e", None)], "object_id int, name string, default_id int"),
        "sys.defaults": spark.createDataFrame([(4, "0")], "id int, text string"),
    }
    c = config()
    found = essence.projection(c, "x", "column", tables.__getitem__)
    assert found.columns == ["object", "member", "default_expr"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("dbo.t", "a", None), ("dbo.t", "b", "0"), ("dbo.u", "e", None)]))
    assert essence.projection(c, "x", "column", tables.__getitem__, hwm=F.lit(2)).count() == 2
    sql = essence.projection_sql(c, "x", "column", tail=True)
    assert "LEFT JOIN sys.defaults AS d ON c.default_id = d.id" in sql and sql.endswith("WHERE (o.kind = 'T') AND (o.modified > :hwm)")
    assert essence.projection_sql(c, "x", "plain") == "SELECT name AS n FROM sys.schemas"
    with pytest.raises(ValueError):
        essence.projection_sql(c, "x", "plain", tail=True)
    c.add("catalog_table", {"dialect": "x", "essence": "column", "alias": "z", "expr": "sys.other", "is_root": 0})
    with pytest.raises(ValueError, match="no join leads"):
        c.join_order("x", "column")
    config().save(store, D[1])
    assert essence.projection_sql(essence.Config.load(store), "x", "column") == essence.projection_sql(config(), "x", "column") or essence.Config.load(store).essences("x") == ["column", "plain"]
    rows = essence.projection(config(), "x", "column", tables.__getitem__)
    essence.capture_essence(store, "captured", rows.limit(1), D[2])
    essence.capture_essence(store, "captured", rows, D[3])
    assert diff.capture_diff(store.read("captured").withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz")), D[2], D[3]).count() == 2
    assert {"column", "primary_key", "foreign_key"} <= set(essence.seed().essences("postgresql"))


R1 = acquire.ColumnCollection("customer", [("id", "int"), ("name", "nvarchar(50)"), ("region", "nvarchar(50)")], ["id"], "sqlserver", "dbo", 1)
R2 = acquire.ColumnCollection("customer", [("id", "int"), ("name", "nvarchar(100)"), ("region", "nvarchar(50)"), ("signup_date", "date")], ["id"], "sqlserver", "dbo", 1)
R3 = acquire.ColumnCollection("customer", [("id", "int"), ("name", "nvarchar(100)"), ("signup_date", "datetime2"), ("loyalty_tier", "int")], ["id"], "sqlserver", "dbo", 1)


def test_migrations(spark):
    assert [(d.kind, d.name) for d in migrate.changeset(R1, R2)] == [("add", "signup_date"), ("retype", "name")]
    assert [(d.kind, d.name) for d in migrate.changeset(R2, R3)] == [("add", "loyalty_tier"), ("retype", "signup_date"), ("drop", "region")]
    assert migrate.migration_ddl(R2, R3) == ["ALTER TABLE [dbo].[customer] ADD [loyalty_tier] int;", "ALTER TABLE [dbo].[customer] ALTER COLUMN [signup_date] datetime2;", "ALTER TABLE [dbo].[customer] DROP COLUMN [region];"]
    assert migrate.migration_ddl(R1, R2, "postgresql")[1] == 'ALTER TABLE "dbo"."customer" ALTER COLUMN "name" TYPE nvarchar(100);'
    assert migrate.migration_ddl(R1, R2, "sqlite")[1].startswith("-- sqlite can't change")
    assert migrate.migration_ddl(R1, R2, "spark")[0] == "ALTER TABLE `dbo`.`customer` ADD COLUMNS (`signup_date` date);"
    forward, back = migrate.changeset(R1, R3), migrate.changeset(R3, R1)
    names = {n for n, _ in R1.columns} | {d.name for d in forward if d.kind == "add"}
    assert names - {d.name for d in forward if d.kind == "drop"} == {n for n, _ in R3.columns}
    assert {(d.name, d.before_type, d.after_type) for d in forward} == {(d.name, d.after_type, d.before_type) for d in back}
    again = acquire.ColumnCollection("item", [("id", "int"), ("name", "text")], ["id"], "duckdb", None, 2)
    was = acquire.ColumnCollection("item", [("id", "int"), ("sku", "text")], ["id"], "duckdb", None, 1)
    assert migrate.migration_ddl(was, again) == ['DROP TABLE "item";', 'CREATE TABLE "item" ("id" int, "name" text);']
    assert migrate.round_trip(spark, R3, "sqlserver").isEmpty()


def test_plans_and_provisioning(spark, store):
    plan = migrate.SamplingPlan(store)
    plan.declare("srv", "db", "widget", "widget", "id")
    plan.declare("srv", "db", "nothing", "nothing", "id")
    plan.declare("srv", "db", "old", "old", "id")
    plan.declare("srv", "db", "old", "old", "id", enabled=False)
    assert [s["target"] for s in plan.specs()] == ["nothing", "widget"]
    plan.declare_connection("main", "ODBC Driver 18", "host", "db", 1433, "Encrypt=yes")
    assert plan.connection_string("main") == "Driver={ODBC Driver 18};Server=host,1433;Database=db;Encrypt=yes;"
    with pytest.raises(ValueError):
        plan.declare_connection("bad", "d", "h", "db", options="PWD=x")
    rows = [("main", "widget", 1, "table", "id", 1, "INTEGER", None, None), ("main", "widget", 1, "table", "name", 2, "TEXT", None, None)]
    make = lambda rows, at: spark.createDataFrame(rows, "schema_name string, object_name string, object_id long, grouping_kind string, member_name string, ordinal long, data_type string, referenced_object string, referenced_member string").transform(lambda d: registry.capture(d, "srv", "db", F.lit(at).cast("timestamp_ntz")))
    captures = make(rows, D[1])
    assert plan.provision(captures, D[2]) == {"nothing": "skipped", "widget": "created"}
    assert plan.provision(captures, D[2])["widget"] == "current"
    captures = captures.unionByName(make([*rows, ("main", "widget", 1, "table", "price", 3, "REAL", None, None)], D[3]))
    assert plan.provision(captures, D[4])["widget"] == "evolved(+1)" and plan.provision(captures, D[2])["widget"] == "current"
    assert [c["column_type"] for c in store.columns("widget")] == ["int64", "varchar", "float64"]
    found = acquire.ColumnCollection.from_capture(registry.schema_as_of(captures, F.lit(D[4]).cast("timestamp_ntz")), "widget", ["id"])
    assert found.columns == [("id", "INTEGER"), ("name", "TEXT"), ("price", "REAL")]


def test_a_replica_cycle(spark, store):
    rows = [(1, "alpha", None, D[1]), (2, "bravo", None, D[1]), (3, "charlie", None, D[1])]
    columns = [("id", "int64"), ("name", "varchar")]
    source = lambda: spark.createDataFrame(rows, "id long, name string, region string, at timestamp_ntz")
    driver = acquire.UserColumnDriver("at", ["id"])
    unit = replica.Replica(store, "wid", ["id"], lambda: columns, lambda mark: driver.poll(source(), None if mark is None else dt.datetime.fromisoformat(mark)), {"facet": lambda: source().groupBy().count()})
    first = unit.sync(D[2])
    rows[1] = (2, "bravo2", None, D[3])
    second = unit.sync(D[3])
    columns.append(("region", "varchar"))
    rows[0] = (1, "alpha", "north", D[4])
    third = unit.sync(D[4])
    nothing = unit.sync(D[5])
    assert [(r["first"], r["evolved"], r["commits"]) for r in (first, second, third, nothing)] == [(True, False, 1), (False, False, 1), (False, True, 1), (False, False, 0)]
    assert len(set(replica.ControlStore(store).trail("wid"))) == 3
    state_now = {r["id"]: (r["name"], r["region"]) for r in lake.HistoryTable(store, "wid", columns, ["id"]).state().collect()}
    assert state_now == {1: ("alpha", "north"), 2: ("bravo2", None), 3: ("charlie", None)}
    assert store.read("wid_facet").count() == 4


# Types, texts and values


def test_types():
    assert len(tt.REFERENCE) == 49
    assert [tt.resolve("sqlite", t).lake_type for t in ("INTEGER", "text", "REAL", "BLOB", "weird")] == ["int64", "varchar", "float64", "varchar", "varchar"]
    assert tt.resolve("sqlite", "BLOB").transform == "to_hex" and tt.resolve("SQLSERVER", "Decimal(10,2)").lake_type == "float64"
    assert tt.generic_type("sqlserver", "NVARCHAR(50)") == "String" and tt.generic_type("socrata", "Calendar date") == "DateTime" and tt.generic_type("duckdb", None) == "String"
    assert tt.family("DECIMAL(18,3)") == tt.family("money") == "numeric" and tt.family("geography") is None
    assert tt.spark_type("duckdb", "DECIMAL(5,1)") == T.DecimalType(38, 18)
    assert tt.legacy_type("timestamp") == "DateTime" and sum(len(n) for g in tt.TYPE_MAP.values() for n in g.values()) == 107


def test_database_texts():
    columns = [("id", "int"), ("notes", "nvarchar(max)"), ("payload", "varbinary"), ("rowguid", "uniqueidentifier"), ("amount", "money")]
    listed = databases.extraction_list(columns, "sqlserver", "t")
    assert listed.endswith("t.[notes] AS [notes]") and "CONVERT(VARCHAR(MAX), t.[payload], 1) AS [payload]" in listed and "CAST(t.[rowguid] AS VARCHAR(36))" in listed
    assert "CHANGETABLE(CHANGES [dbo].[w], 5)" in databases.tailing_query("dbo", "w", columns, ["id"], 5)
    assert databases.tailing_query("public", "w", [("id", "int")], ["id"], None, "postgresql") == 'SELECT t."id" FROM "public"."w" AS t'
    assert "pragma_table_info" in databases.catalog_query("sqlite") and "information_schema" in databases.catalog_query("duckdb")


def test_identifiers_and_hashes(spark):
    assert text.safe_identifiers(["a" * 70, "a" * 70, "a" * 63, "b"]) == ["a" * 63, "a" * 61 + "_1", "a" * 61 + "_2", "b"]
    assert text.domain_to_schema("data.x-y.gov") == "s_data_x_y_gov"
    assert text.fnv1a("") == 0x811C9DC5 and text.fnv1a("a") == 0xE40C292C and text.fnv1a("a", 64) == 0xAF63DC4C8601EC8C
    text.register_sql(spark)
    row = spark.sql("select domain_schema('a.b') d, op_code('delete') o, op_code('x') u, time_ms() > 0 t, (select count(*) from sequence_table(5)) n").first()
    assert tuple(row) == ("s_a_b", "D", "U", True, 5)
    one = spark.createDataFrame([("a.b.c",)], "n string")
    assert tuple(one.select(text.name_part(F.col("n"), 1), text.name_part(F.col("n"), 3), text.name_part(F.col("n"), 4), text.quote_name(F.lit("a]b"))).first()) == ("c", "a", None, "[a]]b]")


def test_extraction(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x01\xff"), D[1], "POINT (1 2)", "x")], "id int, bin binary, off timestamp, geo string, note string")
    found = df.select(*extract.extraction([("id", "int"), ("geo", "geography"), ("bin", "varbinary"), ("off", "datetimeoffset"), ("note", "ntext")], "sqlserver", "0x"))
    assert found.columns == ["id", "bin", "off", "geo", "note"] and tuple(found.first()) == (1, "0x01FF", "2026-01-02T00:00:00.000000", "POINT (1 2)", "x")
    nested = spark.createDataFrame([(1, {"a": 1})], "id int, props map<string,int>")
    out = extract.normalise(nested, T.StructType([]), ["props", "id", "missing"]).first()
    assert tuple(out) == ('{"a":1}', 1, None)
    times = spark.createDataFrame([("1970-01-01 00:01:00",), ("soon",), (None,)], "t string")
    assert [r[0] for r in times.select(extract.epoch_or_text(F.col("t"))).collect()] == ["60", "soon", None]
    assert times.limit(1).select(extract.bump(F.lit("2026-01-01T00:00:59.500Z"))).first()[0] == "2026-01-01T00:01:00.500Z"
    variants = spark.sql("select parse_json('1') v union all select to_variant_object(named_struct('a', 1)):a::variant").select(extract.variant_text(F.col("v")))
    assert [r[0] for r in variants.collect()] == ["1", "1"]


def test_json(spark):
    df = spark.createDataFrame([(1, '[{":id":"r1","a":{"b":[1]}},{":id":null}]'), (2, "[]"), (3, None)], "k int, p string")
    assert [tuple(r) for r in fj.json_rows(df, "p", [":id", "a"], ["k"]).collect()] == [(1, "r1", '{"b":[1]}'), (1, None, None)]
    assert [tuple(r) for r in fj.each_value(spark.createDataFrame([('{"x":["a","b"]}',)], "p string"), "p", "$.x").collect()] == [(1, "a"), (2, "b")]
    one = spark.createDataFrame([("h", None)], "a string, b string")
    assert one.select(fj.object_of(a=F.col("a"), b=F.col("b"))).first()[0] == '{"a":"h","b":null}'
    boxed = one.select(fj.envelope(["x", "y"], F.array(F.array(F.lit("1"), F.lit("2")))).alias("e"))
    assert fj.open_envelope(boxed, "e").first()["row"] == {"x": "1", "y": "2"}
    zipped = fj.zip_rows(spark.createDataFrame([("t", 2, "b"), ("t", 1, "a")], "k string, ordinal int, n string"), ["k"], {"n": "names"})
    assert zipped.first()["names"] == ["a", "b"]
    with pytest.raises(ValueError):
        fj.path_of("it's")


def test_json_values(spark):
    a, b = {"x": [1, 2, {"y": 1}], "k/~": 1, "gone": 0}, {"x": [1, 3], "k/~": {"n": None}, "new": []}
    assert fj.patch_value(a, fj.diff_value(a, b)) == b and fj.diff_value(a, a) == [] and fj.diff_value(1, True)
    assert fj.unflatten_value(fj.flatten_value(a)) == a and fj.flatten_value(b)["/k~1~0/n"] is None
    assert fj.merge_value({"a": {"b": 1, "c": 2}}, {"a": {"b": None}, "d": 1}) == {"a": {"c": 2}, "d": 1}
    with pytest.raises(ValueError):
        fj.patch_value({}, [{"op": "remove", "path": "/x"}])
    assert fj.patch_value({"a": [1]}, [{"op": "copy", "from": "/a/0", "path": "/b"}, {"op": "move", "from": "/b", "path": "/a/0"}, {"op": "test", "path": "/a/1", "value": 1}]) == {"a": [1, 1]}
    assert fj.search_value({"r": [{"n": [1, 2]}, {"n": [3]}, {}]}, "r[*].n[0]") == [1, 3] and fj.search_value({"r": [[1], [2]]}, "r[] | length(@)") == 2
    assert fj.render("{% for x in xs %}{{ x.n }}{% if not loop.last %},{% endif %}{% endfor %}{% if e %}E{% else %}none{% endif %}", {"xs": [{"n": 1}, {"n": "b"}], "e": []}) == "1,bnone"
    df = spark.createDataFrame([('{"a":1}', '{"a":2}', "a: [1, x]"), ("bad", "{}", ": :"), (None, None, None)], "a string, b string, y string")
    rows = df.select(fj.json_diff("a", "b"), fj.json_apply_patch("a", F.lit('[{"op":"add","path":"/z","value":1}]')), fj.json_flatten("a"), fj.json_search("a", "a"), fj.template_render("v={{ a }}", "a"), fj.yaml_to_json("y")).collect()
    assert json.loads(rows[0][0]) == [{"op": "replace", "path": "/a", "value": 2}] and rows[0][1:] == ('{"a": 1, "z": 1}', '{"/a": 1}', "1", "v=1", '{"a": [1, "x"]}')
    assert rows[1] == rows[2] == (None,) * 6


# Profiles, access, provenance, search, properties, code


def test_profiles_and_sketches(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, None), (None, "b")], "n int, s string")
    exact = {r["column_name"]: tuple(r)[1:] for r in profile.column_profile(df, ["n", "s"]).collect()}
    assert exact == {"n": (4, 3, 1, 2, "1", "2"), "s": (4, 3, 1, 2, "a", "b")}
    assert {r["column_name"]: tuple(r)[1:] for r in profile.column_profile(df, ["n", "s"], approximate=True).collect()} == exact
    a, b = spark.range(1000), spark.range(500, 1500)
    assert tuple(profile.overlap(a, b, "id", "id").first()) == (1000, 1000, 500, 0.5, round(1 / 3, 6))
    near = profile.sketch_overlap(profile.sketch(a, "id"), profile.sketch(b, "id")).first()
    assert abs(near["containment"] - 0.5) < 0.05
    steps = profile.equi_depth(spark.range(100), "id", 4).orderBy("step").collect()
    assert [(r["equal_rows"] + r["range_rows"], r["range_high_key"]) for r in steps] == [(25, 24), (25, 49), (25, 74), (25, 99)]
    assert [r["n"] for r in profile.distribution(df, ["s"], 1).collect()] == [2]
    assert profile.ranked(df, ["s"], [F.col("n")], 1).count() == 3


def test_access(spark):
    members = spark.createDataFrame([("ann", "staff"), ("staff", "all"), ("bob", "all"), ("x", "y"), ("y", "x")], "principal string, member_of string")
    places = spark.createDataFrame([("table", "schema"), ("schema", "db")], "resource string, parent string")
    grants = spark.createDataFrame([("all", "db", "allow"), ("staff", "table", "deny")], "principal string, resource string, effect string")
    wanted = spark.createDataFrame([("ann", "table"), ("bob", "table"), ("ann", "db"), ("eve", "db")], "principal string, resource string")
    assert {(r["principal"], r["resource"]): r["allowed"] for r in access.access(grants, members, places, wanted).collect()} == {("ann", "table"): False, ("bob", "table"): True, ("ann", "db"): True, ("eve", "db"): False}
    assert access.closure(members, "principal", "member_of").where("principal = 'x'").count() == 2


def test_provenance(spark):
    assert spark.range(1).select(provenance.traceparent(F.lit("a" * 32), F.lit("b" * 16)), provenance.traceparent(F.lit("0" * 32), F.lit("b" * 16)), provenance.traceparent(F.lit(None).cast("string"), F.lit("b"))).first() == (f"00-{'a' * 32}-{'b' * 16}-01", None, None)
    assert provenance.get_session(spark, "nobody.set") is None
    provenance.set_session(spark, "trace.id", "x'y")
    assert provenance.get_session(spark, "trace.id") == "x'y"
    made = provenance.commit_provenance("me", None, "00-1")
    assert json.loads(made["commit_extra_info"]) == {"traceparent": "00-1"}
    found = provenance.inferred_records(spark.createDataFrame([(D[1], 1)], "at timestamp_ntz, k int"), "at", F.lit(D[2]), ["k"], "net").first()
    assert found["body"] == '{"k":1}' and found["fidelity"] == "net"


def test_search(spark):
    docs = spark.createDataFrame([(1, "The cat, the HAT"), (2, "a cat"), (3, None), (4, "")], "id int, body string")
    index = textsearch.inverted_index(docs, "id", "body")
    for query in ("the cat", "CAT", "dog", "cat cat"):
        direct = sorted(map(tuple, textsearch.search(docs, "id", "body", query).collect()))
        assert direct == sorted(map(tuple, textsearch.search_index(index, "id", query).collect()))
    assert sorted(map(tuple, textsearch.search(docs, "id", "body", "the cat").collect())) == [(1, 3)]


def test_properties(spark):
    assert properties.parse_name('[a.b].c."d""e"') == ["a.b", "c", 'd"e']
    log = properties.change(properties.empty(spark), "add", "column", "dbo.t.[c.x]", "note", "hello")
    log = properties.change(log, "update", "column", "dbo.t.[c.x]", "note", "bye")
    assert [tuple(r) for r in properties.facade(log, "column").collect()] == [("dbo.t.c.x", "note", "bye")]
    for action, kind, name in (("add", "column", "dbo.t.[c.x]"), ("update", "table", "dbo.t"), ("add", "table", "t"), ("add", "thing", "t")):
        with pytest.raises(ValueError):
            properties.change(log, action, kind, name, "note", "z")
    assert properties.current(properties.change(log, "drop", "column", "dbo.t.[c.x]", "note")).isEmpty()


def test_code(spark, tmp_path):
    import sqlite3

    columns = spark.createDataFrame([("t", "b", "int", 2, 8), ("t", "a", "text", 1, 7)], "table_name string, column_name string, data_type string, ordinal_position int, column_id int")
    assert codegen.table_ddl(columns, ["table_name"]).first()["ddl"] == '"a" text, "b" int'
    script = codegen.copy_script(columns, "table_name", F.concat(F.col("table_name"), F.lit(".tsv")), F.concat(F.col("table_name"), F.lit(".parquet"))).first()["script"]
    assert "read_csv('t.tsv'" in script and "{'a': 7, 'b': 8}" in script
    with sqlite3.connect(":memory:") as db:
        db.execute("create table item (id integer primary key, name text)")
        db.executescript(codegen.backlog_triggers("item", ["id", "name"]))
        db.execute("insert into item values (1, 'a')")
        db.execute("update item set name = 'b'")
        db.execute("delete from item")
        assert db.execute("select operation, id, name from item_backlog").fetchall() == [("I", 1, "a"), ("U", 1, "b"), ("D", 1, "b")]
        db.execute("create table note (body text)")
        db.executescript(codegen.search_triggers("note", ["body"]))
        db.execute("insert into note values ('green tea')")
        db.execute("update note set body = 'black tea'")
        assert db.execute("select count(*) from note_search where note_search match 'green'").fetchone() == (0,)
        assert db.execute("select count(*) from note_search where note_search match 'tea'").fetchone() == (1,)
    filled = codegen.fill(spark.createDataFrame([("x", "/{d}/{id}.json?{q}")], "name string, template string"), spark.createDataFrame([("x", {"d": "a", "id": "7"})], "name string, values map<string,string>"))
    assert filled.first()["location"] == "/a/7.json?{q}"
    (tmp_path / "f.tsv").write_text("a\tb\n1\tx\n")
    codegen.delimited_view(spark, "mounted", f"file://{tmp_path}/f.tsv")
    assert tuple(spark.sql("select * from mounted").first()) == ("1", "x")
    spark.range(3).write.parquet(f"{tmp_path}/p")
    spark.sql(codegen.view_facade("facade", [f"file://{tmp_path}/p"]))
    assert spark.table("facade").count() == 3


# Sources and streams


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tname\n1\ta\n2\tb\textra\n3\tc\n")
    assert files.delimited(spark, f"file://{tmp_path}/t.tsv", schema="id string, name string").where("id <> '2'").count() == 2
    kept = files.delimited(spark, f"file://{tmp_path}/t.tsv", keep_bad=True).collect()
    assert [r["id"] for r in kept if r["_bad"]] == ["2"]
    record = {"metadata": {"domain": "d"}, "resource": {"id": "r1", "name": "n", "columns_field_name": ["a"]}}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps([record, record]))
    (tmp_path / "j" / "b.json").write_text("{not json")
    assert files.json_records(spark, f"file://{tmp_path}/j/a.json").select("resource.id").distinct().first()[0] == "r1"
    listed = {r["path"].rsplit("/", 1)[1]: (r["valid"], r["size"]) for r in files.json_documents(spark, f"file://{tmp_path}/j").collect()}
    assert listed["a.json"][0] and not listed["b.json"][0] and listed["b.json"][1] == 9
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    files.write_with_ids(df, f"file://{tmp_path}/w", {"id": 1, "name": 2})
    renamed = T.StructType([T.StructField("label", T.StringType()), T.StructField("extra", T.IntegerType()), T.StructField("id", T.IntegerType())])
    assert tuple(files.read_with_ids(spark, f"file://{tmp_path}/w", renamed, {"label": 2, "extra": 9, "id": 1}).first()) == ("a", None, 1)
    assert files.parquet_files(spark, f"file://{tmp_path}/w").first()["rows"] == 1
    assert files.footers(spark, f"file://{tmp_path}/w").where("footer_size > 0 and footer_size < size").count() >= 1
    assert files.from_rows(spark, [("a", "bigint"), ("t", "timestamp_ntz")], [(1, D[1]), (None, None)]).count() == 2
    pages = spark.createDataFrame([("x", 1, 0, "late"), ("x", 0, 5, "first"), ("y", 1, 1, "only")], "id string, page int, position int, v string")
    assert {r["id"]: r["v"] for r in files.merge_pages(pages, "id").collect()} == {"x": "first", "y": "only"}


def test_paged_catalogs(spark, tmp_path):
    records = [{"resource": {"id": f"r{i}", "updatedAt": f"2026-01-{20 - i:02d}"}} for i in range(7)]
    for p in range(3):
        (tmp_path / f"page-{p:05d}.json").write_text(json.dumps({"results": records[3 * p : 3 * p + 3], "resultSetSize": 7}))
    paged.register(spark)
    rows = spark.read.format("paged_catalog").option("path", str(tmp_path)).option("limit", "3").load()
    assert rows.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in rows.collect()) == [f"r{i}" for i in range(7)]
    fetched = []
    pages = paged.Pages({"path": str(tmp_path), "limit": "3"})
    fetch = pages.fetch
    pages.fetch = lambda n: fetched.append(n) or fetch(n)
    assert [r[2] for r in pages.newer("2026-01-18")] == ["r0", "r1"] and set(fetched) == {0}
    reader = paged.PagedStreamReader({"path": str(tmp_path), "limit": "3", "after": "2026-01-16"})
    got, offset = reader.read(reader.initialOffset())
    assert len(list(got)) == 4 and offset == {"hwm": "2026-01-20"}
    assert len(list(reader.readBetweenOffsets({"hwm": "2026-01-16"}, {"hwm": "2026-01-18"}))) == 2
    assert reader.read(offset)[1] == offset


def test_streams_apply_once(spark, store, tmp_path):
    changes = spark.createDataFrame([(i, i % 3, f"v{i}", D[0] + dt.timedelta(hours=i)) for i in range(12)], "seq int, id long, v string, ts timestamp_ntz")
    history = lake.HistoryTable(store, "s", [("id", "int64"), ("v", "varchar")], ["id"]).create()
    stream = replay(changes, "ts", 3).withColumn("__op", F.lit("U")).withColumn("__tt", F.col("ts"))
    sinks.replicate(stream, history, f"file://{tmp_path}/c", "s")
    assert {r["id"]: r["v"] for r in history.state().collect()} == {0: "v9", 1: "v10", 2: "v11"} and history.next_version() == 13
    write, before = sinks.sink(history, "s"), history.log().count()
    write(changes.withColumn("__op", F.lit("U")).withColumn("__tt", F.col("ts")), 0)
    assert history.log().count() == before
    assert sinks.newest(changes.unionByName(changes), ["id"], "ts").count() == 12


def test_event_time(spark, tmp_path):
    rows = spark.createDataFrame([(1, D[0]), (1, D[0] + dt.timedelta(minutes=5)), (1, D[0] + dt.timedelta(hours=2)), (1, D[0] + dt.timedelta(hours=9))], "k int, at timestamp")
    for name, make in (("sessions", lambda s: state.sessions(s, ["k"], "at", "10 minutes", "0 seconds")), ("windows", lambda s: state.tumbling(s, ["k"], "at", "1 hour", "0 seconds")), ("seen", lambda s: state.first_seen(s, ["k"], "at", "1 hour").withColumn("n", F.lit(1)))):
        out = f"file://{tmp_path}/{name}"
        made = make(replay(rows, "at", 2))
        made.writeStream.option("checkpointLocation", f"file://{tmp_path}/c-{name}").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        assert [r["n"] for r in spark.read.schema(made.schema).parquet(out).orderBy("n").collect()][-1] == (1 if name == "seen" else 2)


def test_a_source_that_grows_while_it_is_read_loses_nothing(spark, tmp_path):
    source = [(1, 1, "a"), (2, 1, "b"), (2, 2, "c")]
    calls = []

    def poll(watermark):
        calls.append(watermark)

        def grown(batches):  # each evaluation sees more of the source than the one before
            import os
            import uuid

            import pyarrow as pa

            yield from batches
            seen = len(os.listdir(folder))
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield pa.RecordBatch.from_arrays([pa.array([9]), pa.array([2 + seen]), pa.array([f"late{seen}"])], ["id", "tt", "v"])

        rows = spark.createDataFrame(source, "id bigint, tt bigint, v string").coalesce(1).mapInArrow(grown, "id bigint, tt bigint, v string")
        rows = rows.where(F.col("tt") > int(watermark or 0))
        return rows.select("id", "v", F.lit("U").alias("__op"), F.col("tt").alias("__tt"))

    folder = str(tmp_path / "reads")
    import os

    os.mkdir(folder)
    store = lake.Lake(spark, f"file://{tmp_path}/lake").init()
    copy = replica.Replica(store, "t", ["id"], lambda: [("id", "int64"), ("v", "varchar")], lambda w: poll(w).withColumn("__label", F.lit(dt.datetime(2024, 1, 1))))
    first = copy.sync(dt.datetime(2024, 1, 1))
    assert len(os.listdir(folder)) == 1 and first["watermark"] == "2"
    second = copy.sync(dt.datetime(2024, 1, 2))
    assert second["watermark"] == "3" and {r["v"] for r in lake.HistoryTable(store, "t", [("id", "int64"), ("v", "varchar")], ["id"]).log().collect()} == {"a", "b", "c", "late0", "late1"}


def test_the_last_of_two_images_at_one_time_counts(spark, tmp_path):
    log = spark.createDataFrame([(1, 10, 2, 4, "new"), (1, 10, 1, 2, "old"), (2, 10, 3, 1, "gone"), (2, 10, 2, 2, "was")], "id bigint, lsn bigint, seq bigint, op int, v string").withColumn("wall", F.col("lsn"))
    polled = acquire.CDCDriver(["id"], seq="seq", op="op").poll(log, None).withColumn("__label", F.lit(dt.datetime(2024, 1, 1)))
    for parts in (1, 5):
        history = lake.HistoryTable(lake.Lake(spark, f"file://{tmp_path}/lake{parts}").init(), "t", [("id", "int64"), ("v", "varchar")], ["id"]).create()
        history.apply(acquire.staple(polled.repartition(parts)))
        assert [tuple(r) for r in history.state().select("id", "v").collect()] == [(1, "new")]
    with pytest.raises(Exception, match="no transaction time"):
        acquire.staple(spark.createDataFrame([(1, None)], "id bigint, __tt bigint")).collect()
