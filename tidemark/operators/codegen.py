"""Text made from metadata: copy scripts, backlog and search templates, view facades, locations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.json import render


def table_ddl(columns: DataFrame, group: list[str], name: str = "column_name", kind: str = "data_type", order: str = "ordinal_position") -> DataFrame:
    """``ddl``: each table's columns in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit('"'), F.replace(F.col(name), F.lit('"'), F.lit('""')), F.lit('" '), F.col(kind)).alias("t"))))
    return columns.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["t"]), ", ").alias("ddl"))


def copy_script(columns: DataFrame, table: str, source: Column, target: Column, name: str = "column_name", ids: str = "column_id") -> DataFrame:
    """``script``: for each table, a statement that copies a delimited file to Parquet under its column ids."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(ids).alias("o"), F.concat(F.lit("'"), F.replace(F.col(name), F.lit("'"), F.lit("''")), F.lit("': "), F.col(ids).cast("string")).alias("t"))))
    listed = columns.groupBy(table).agg(F.array_join(F.transform(parts, lambda p: p["t"]), ", ").alias("ids"))
    head = F.concat(F.lit("COPY (SELECT * FROM read_csv('"), source, F.lit("', all_varchar = true)) TO '"), target)
    return listed.select(table, F.concat(head, F.lit("' (FORMAT parquet, FIELD_IDS {"), F.col("ids"), F.lit("});")).alias("script"))


BACKLOG_TEMPLATE = """CREATE TABLE "{{ table }}_backlog" (ts BIGINT, operation TEXT{% for c in columns %}, "{{ c }}"{% endfor %});
{% for e in events %}CREATE TRIGGER "{{ table }}_{{ e.name }}" AFTER {{ e.verb }} ON "{{ table }}" BEGIN
  INSERT INTO "{{ table }}_backlog" VALUES (unixepoch('subsec') * 1000, '{{ e.code }}'{% for c in columns %}, {{ e.image }}."{{ c }}"{% endfor %});
END;
{% endfor %}"""
SEARCH_TEMPLATE = """CREATE VIRTUAL TABLE "{{ table }}_search" USING fts5({% for c in columns %}{% if not loop.first %}, {% endif %}"{{ c }}"{% endfor %}, content="{{ table }}");
{% for e in events %}CREATE TRIGGER "{{ table }}_search_{{ e.name }}" AFTER {{ e.verb }} ON "{{ table }}" BEGIN
{% if e.old %}  INSERT INTO "{{ table }}_search"("{{ table }}_search", rowid{% for c in columns %}, "{{ c }}"{% endfor %}) VALUES ('delete', old.rowid{% for c in columns %}, old."{{ c }}"{% endfor %});
{% endif %}{% if e.new %}  INSERT INTO "{{ table }}_search"(rowid{% for c in columns %}, "{{ c }}"{% endfor %}) VALUES (new.rowid{% for c in columns %}, new."{{ c }}"{% endfor %});
{% endif %}END;
{% endfor %}"""
EVENTS = [{"name": "insert", "verb": "INSERT", "code": "I", "image": "new", "new": True, "old": False}, {"name": "update", "verb": "UPDATE", "code": "U", "image": "new", "new": True, "old": True}, {"name": "delete", "verb": "DELETE", "code": "D", "image": "old", "new": False, "old": True}]


def backlog_triggers(table: str, columns: list[str]) -> str:
    """A backlog table and its triggers for SQLite: after-images, and the old image of a delete; times in whole milliseconds."""
    return render(BACKLOG_TEMPLATE, {"table": table, "columns": columns, "events": EVENTS})


def search_triggers(table: str, columns: list[str]) -> str:
    """A full-text index and its triggers for SQLite."""
    return render(SEARCH_TEMPLATE, {"table": table, "columns": columns, "events": EVENTS})


def view_facade(name: str, paths: list[str], columns: list[str] | None = None) -> str:
    """A view over files."""
    listed = " UNION ALL ".join(f"SELECT {', '.join(columns) if columns else '*'} FROM parquet.`{p}`" for p in paths)
    return f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {listed}"


def delimited_view(spark: SparkSession, name: str, path: str, separator: str = "\t") -> None:
    """A delimited file as a temporary view of text columns."""
    if not name.isidentifier():
        raise ValueError(f"not a view name: {name!r}")
    spark.read.options(header=True, sep=separator, inferSchema=False, mode="DROPMALFORMED").csv(path).createOrReplaceTempView(name)


def fill(templates: DataFrame, values: DataFrame, name: str = "name", template: str = "template", value: str = "values") -> DataFrame:
    """``location``: templates with ``{key}`` slots, filled from maps of the same name; a key without a value keeps its slot."""
    joined = templates.join(values, name)
    filled = F.aggregate(F.map_entries(value), F.col(template), lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return joined.withColumn("location", filled)


def execute_rows(spark: SparkSession, rows: DataFrame, template: str, order: list[str], error: str = "raise") -> list[dict]:
    """Run the statement that each registry row asks for, in order; the rows are a control plane's.

    ``template`` has ``{column}`` slots for names, which are quoted with backquotes if they are no plain identifiers,
    ``'{column}'`` slots for literals, whose quotes are escaped, and ``:column`` marks for values that are bound. Returns row, statement and outcome;
    with ``error="keep"`` a statement that fails is reported and the next one runs.
    """
    slots, marks = list(dict.fromkeys(re.findall(r"\{(\w+)\}", template))), set(re.findall(r"(?<![:\w]):(\w+)", template))
    out = []
    for row in rows.orderBy(*order).collect():
        held = row.asDict()
        text = template
        for slot in slots:
            name = str(held[slot])
            text = text.replace("'{" + slot + "}'", "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'")
            text = text.replace("{" + slot + "}", name if name.isidentifier() else "`" + name.replace("`", "``") + "`")
        try:
            spark.sql(text, args={m: held[m] for m in marks})
            out.append({"row": held, "statement": text, "outcome": "done"})
        except Exception as problem:
            if error == "raise":
                raise
            out.append({"row": held, "statement": text, "outcome": type(problem).__name__})
    return out
