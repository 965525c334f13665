"""Extended properties: names and values kept for objects of a schema, checked and resolved against a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of object that carry properties, with the number of parts in their names.
CLASSES = {"database": 0, "schema": 1, "table": 2, "view": 2, "procedure": 2, "function": 2, "type": 2, "index": 3, "constraint": 3, "trigger": 3, "column": 3, "parameter": 3, "partition": 1, "filegroup": 1, "user": 1}
SCHEMA = "class string, name_1 string, name_2 string, name_3 string, property string, value string, seq bigint, deleted boolean"
NAME = ["class", "name_1", "name_2", "name_3", "property"]


def parse_name(name: str) -> list[str]:
    """Parts of a dotted name; brackets or double quotes keep dots, doubled closing marks stand for one."""
    parts, at = [], 0
    while at <= len(name):
        if at < len(name) and name[at] in '["':
            last, text, at = {"[": "]", '"': '"'}[name[at]], "", at + 1
            while True:
                if at >= len(name):
                    raise ValueError(f"unclosed name: {name!r}")
                if name[at] == last:
                    if name[at + 1 : at + 2] != last:
                        break
                    at += 1
                text += name[at]
                at += 1
            at += 1
        else:
            end = name.find(".", at)
            end = len(name) if end < 0 else end
            text, at = name[at:end], end
        parts.append(text)
        if at < len(name) and name[at] != ".":
            raise ValueError(f"can't read {name!r}")
        at += 1
    return parts


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def row(kind: str, name: str, prop: str, value: str | None, seq: int, deleted: bool = False) -> tuple:
    if kind not in CLASSES:
        raise ValueError(f"no class {kind!r}")
    parts = parse_name(name) if name else []
    if len(parts) != CLASSES[kind]:
        raise ValueError(f"{kind} takes {CLASSES[kind]} names, not {name!r}")
    return (kind, *[*parts, None, None, None][:3], prop, value, seq, deleted)


def current(log: DataFrame) -> DataFrame:
    """The properties there are: the last row of each name, unless it is a removal."""
    last = log.groupBy(*NAME).agg(F.max_by(F.struct("value", "deleted"), "seq").alias("r"))
    return last.where("not r.deleted").select(*NAME, "r.value")


def facade(log: DataFrame, kind: str) -> DataFrame:
    """One class as a relation: object_name, property, value."""
    return current(log).where(F.col("class") == kind).select(F.concat_ws(".", "name_1", "name_2", "name_3").alias("object_name"), "property", "value")


def change(log: DataFrame, action: str, kind: str, name: str, prop: str, value: str | None = None) -> DataFrame:
    """The log with one more row: ``add`` fails if the property is there, ``update`` and ``drop`` if it is not."""
    new = row(kind, name, prop, value, (log.agg(F.max("seq")).first()[0] or 0) + 1, action == "drop")
    same = F.lit(True)
    for column, part in zip(NAME, new, strict=False):
        same = same & F.col(column).eqNullSafe(F.lit(part))
    there = not current(log).where(same).isEmpty()
    if action not in ("add", "update", "drop"):
        raise ValueError(f"no action {action!r}")
    if there == (action == "add"):
        raise ValueError(f"{prop!r} of {kind} {name!r} is {'there' if there else 'not there'}")
    return log.unionByName(log.sparkSession.createDataFrame([new], SCHEMA))


def object_info(registry: DataFrame, name: str) -> DataFrame:
    """The registry's rows of an object named in dotted form: the last part is the object, the one before its schema."""
    parts = parse_name(name)
    found = registry.where(F.col("object_name") == parts[-1])
    return found.where(F.col("schema_name") == parts[-2]) if len(parts) > 1 else found
