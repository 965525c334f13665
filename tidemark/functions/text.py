"""Identifiers, names and hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LONGEST_IDENTIFIER = 63


def safe_identifiers(names: list[str], longest: int = LONGEST_IDENTIFIER) -> list[str]:
    """Names cut to a length, told apart by _1, _2, ... where cutting makes them equal."""
    out: list[str] = []
    taken: set[str] = set()
    for name in names:
        made, number = name[:longest], 0
        while made in taken:
            number += 1
            made = f"{name[: longest - len(str(number)) - 1]}_{number}"
        taken.add(made)
        out.append(made)
    return out


def domain_to_schema(domain: Column | str) -> Column | str:
    """A schema name for a domain: dots and hyphens become underscores, after ``s_``."""
    if isinstance(domain, str):
        return "s_" + domain.replace(".", "_").replace("-", "_")
    return F.concat(F.lit("s_"), F.translate(domain, ".-", "__"))


def quote_name(name: Column, opening: str = "[", closing: str = "]") -> Column:
    return F.concat(F.lit(opening), F.replace(name, F.lit(closing), F.lit(closing * 2)), F.lit(closing))


def name_part(name: Column, part: int) -> Column:
    """Part 1 of a dotted name is its last; null beyond the first."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= part, F.get(parts, F.size(parts) - part))


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def bytes_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fnv1a(value: str, bits: int = 32) -> int:
    """The FNV-1a hash of a text's UTF-8 bytes."""
    prime, basis = {32: (0x01000193, 0x811C9DC5), 64: (0x100000001B3, 0xCBF29CE484222325)}[bits]
    out = basis
    for byte in value.encode():
        out = (out ^ byte) * prime % (1 << bits)
    return out


def register_sql(spark: SparkSession) -> None:
    """SQL functions for the session: ``time_ms()``, ``domain_schema(d)``, ``op_code(op)``, and ``sequence_table(n)`` as a table."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION time_ms() RETURNS BIGINT RETURN unix_millis(current_timestamp())")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION domain_schema(d STRING) RETURNS STRING RETURN concat('s_', translate(d, '.-', '__'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION op_code(op STRING) RETURNS STRING RETURN CASE WHEN op IN ('D', 'DELETE', 'delete') THEN 'D' WHEN op IN ('I', 'INSERT', 'insert') THEN 'I' ELSE 'U' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sequence_table(n INT) RETURNS TABLE (i INT) RETURN SELECT explode(sequence(0, n - 1)) WHERE n > 0")
