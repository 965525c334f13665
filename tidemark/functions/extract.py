"""Type-aware extraction of values into forms that every system takes, and normalisation of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.types import resolve


def to_hex(value: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.hex(value))


def to_iso(value: Column) -> Column:
    """A time as ISO 8601 with microseconds; instants end in their offset."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def to_text(value: Column) -> Column:
    return value.cast("string")


def to_wkt(value: Column) -> Column:
    """Shapes arrive as well-known text, and pass through."""
    return value.cast("string")


TRANSFORMS = {"to_hex": to_hex, "to_iso": to_iso, "to_text": to_text, "to_wkt": to_wkt}


def extraction(columns: list[tuple[str, str]], dialect: str, hex_prefix: str = "") -> list[Column]:
    """Columns with the transform that the type reference names, large objects last."""
    out = []
    for name, kind in sorted(columns, key=lambda c: resolve(dialect, c[1]).is_lob):
        row = resolve(dialect, kind)
        value = F.col(f"`{name}`")
        if row.transform == "to_hex":
            value = to_hex(value, hex_prefix)
        elif row.transform:
            value = TRANSFORMS[row.transform](value)
        out.append(value.alias(name))
    return out


def normalise(rows: DataFrame, schema: T.StructType, known: list[str]) -> DataFrame:
    """Rows of a source with just the known columns: nulls for those it lacks, JSON text for nested ones."""
    fields = {f.name: f.dataType for f in rows.schema.fields}
    out = []
    for name in known:
        if name not in fields:
            out.append(F.lit(None).cast(schema[name].dataType if name in schema.names else T.StringType()).alias(name))
        elif isinstance(fields[name], (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(F.col(f"`{name}`")).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return rows.select(*out)


def epoch_or_text(value: Column) -> Column:
    """Seconds since 1970 of a text that is a time, else the text itself."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(value)).cast("string"), value)


def epoch_millis(value: Column) -> Column:
    return F.unix_millis(value.cast("timestamp"))


def bump(value: Column, seconds: int = 1) -> Column:
    """An ISO text moved by whole seconds, with milliseconds and Z."""
    moved = F.to_timestamp(value) + F.make_dt_interval(secs=F.lit(seconds))
    return F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def variant_text(value: Column) -> Column:
    """A variant as text by its own type: times as ISO, binary as hex, the rest as they are written."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "BINARY", F.hex(F.try_variant_get(value, "$", "binary"))).when(kind.startswith("TIMESTAMP"), to_iso(F.try_variant_get(value, "$", "timestamp"))).otherwise(F.try_variant_get(value, "$", "string"))
