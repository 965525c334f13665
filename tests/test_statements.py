"""Statements that rows ask for, a log of requests, and foreign keys of several columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import codegen, registry, requests
from tidemark.sources import lake

NOW = dt.datetime(2026, 1, 2)


def test_statements_of_rows(spark):
    rows = spark.createDataFrame([(1, "v one", "it's \\ here", 5), (2, "v_two", "b", 7), (3, "v_three", "c", None)], "id int, name string, word string, n int")
    template = "CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT '{word}' AS word"
    assert [r["outcome"] for r in codegen.execute_rows(spark, rows, template, ["id"])] == ["done"] * 3
    assert spark.table("`v one`").first()["word"] == "it's \\ here" and spark.table("v_two").first()["word"] == "b"
    spark.sql("DECLARE OR REPLACE VARIABLE total INT DEFAULT 0")
    codegen.execute_rows(spark, rows, "SET VAR total = total + coalesce(:n, 0)", ["id"])
    assert spark.sql("SELECT total").first()[0] == 12
    kept = codegen.execute_rows(spark, rows, "SELECT * FROM {name} WHERE nowhere = :n", ["id"], error="keep")
    assert [r["outcome"] for r in kept] == ["AnalysisException"] * 3
    with pytest.raises(Exception, match="nowhere"):
        codegen.execute_rows(spark, rows, "SELECT * FROM {name} WHERE nowhere = :n", ["id"])


def test_requests(spark, tmp_path):
    log = requests.RequestLog(lake.Lake(spark, f"file://{tmp_path}/lake").init()).create().create()
    hour = lambda h: dt.datetime(2026, 1, 1, h)
    made = [("a", 200, 1), ("a", 500, 2), ("b", 200, 1), ("b", 500, 2), ("b", 500, 3), ("b", None, 4), ("c", 200, 23), ("d", 404, 5), ("e", 500, 1), ("e", 204, 2)]
    log.record([{"request_url": u, "request_method": "GET", "response_status_code": c, "requested_at": hour(h), "seq": i, "response_body": b"x", "response_headers": f"X-A: 1\r\ncontent-Type: text/{u}\r\n"} for i, (u, c, h) in enumerate(made)])
    assert not log.lake.entries("data_file", log.lake.table_id("http_request"))
    assert {(r["request_url"], r["reason"]) for r in log.due(F.lit(NOW), 3600 * 12).collect()} == {("a", "failed"), ("d", "failed"), ("e", "stale")}
    assert {(r["request_url"], r["reason"]) for r in log.due(F.lit(NOW), 3600 * 12, tries=9).collect()} >= {("b", "failed")}
    assert {r["request_url"]: r["seq"] for r in log.last().collect()} == {"a": 0, "b": 2, "c": 6, "e": 9}
    assert {r["request_url"]: r["seq"] for r in log.last(F.lit(hour(2)), good=False).collect()} == {"a": 1, "b": 3, "e": 9}
    kind = log.log().select(requests.header(F.col("response_headers"), "Content-Type").alias("k"), requests.header(F.col("response_headers"), "Missing").alias("m")).distinct()
    assert {tuple(r) for r in kind.collect()} == {(f"text/{u}", None) for u in "abcde"}


def test_keys_of_several_columns(spark):
    rows = [("s", "pk", "PRIMARY KEY", "p", c, i, None, None, None) for i, c in enumerate(["x", "y", "z"], 1)]
    rows += [("other", "pk", "UNIQUE", "q", "w", 1, None, None, None)]
    rows += [("s", "fk", "FOREIGN KEY", "t", c, i, "pk", at, "CASCADE") for i, (c, at) in enumerate([("a", 3), ("b", 1), ("c", 2)], 1)]
    found = registry.foreign_keys(spark.createDataFrame(rows, "schema_name string, constraint_name string, constraint_type string, table_name string, column_name string, ordinal bigint, unique_constraint_name string, position_in_unique_constraint bigint, delete_rule string"))
    assert {(r["member_name"], r["ordinal"], r["referenced_object"], r["referenced_member"], r["on_delete"], r["grouping_kind"]) for r in found.collect()} == {("a", 1, "p", "z", "CASCADE", "fk"), ("b", 2, "p", "x", "CASCADE", "fk"), ("c", 3, "p", "y", "CASCADE", "fk")}
