"""Who changed what: sessions, transactions and the processes behind them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import asof_join

TRACE = re.compile(r"[0-9a-f]{32}")
SPAN = re.compile(r"[0-9a-f]{16}")


def traceparent(trace_id: Column, span_id: Column, sampled: Column | None = None) -> Column:
    """A W3C trace context header of hex ids; null without an active span (a null id or one of zeros)."""
    flags = F.when(F.coalesce(sampled, F.lit(True)) if sampled is not None else F.lit(True), "01").otherwise("00")
    live = trace_id.rlike("^[0-9a-f]{32}$") & span_id.rlike("^[0-9a-f]{16}$") & ~trace_id.rlike("^0+$") & ~span_id.rlike("^0+$")
    return F.when(live, F.concat_ws("-", F.lit("00"), trace_id, span_id, flags))


def set_session(spark: SparkSession, key: str, value: str | None) -> None:
    """Keep a value for the session, where queries can read it as a variable."""
    name = variable(key)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} STRING")
    spark.sql(f"SET VAR {name} = :value", args={"value": value})


def get_session(spark: SparkSession, key: str) -> str | None:
    """The value that :func:`set_session` kept, or None."""
    try:
        return spark.sql(f"SELECT {variable(key)} AS v").first()["v"]
    except Exception as error:
        if "UNRESOLVED" in str(error):
            return None
        raise


def variable(key: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][\w.]*", key):
        raise ValueError(f"not a session key: {key!r}")
    return "session_" + key.replace(".", "_")


def temporal_semi_join(events: DataFrame, starts: DataFrame, keys: list[str], event_ts: str, start_ts: str, tie: list[str] | None = None, stretch: str | None = None) -> DataFrame:
    """Each event with the last start of its keys strictly before it; events that have none go."""
    joined = asof_join(events, starts, keys, event_ts, start_ts, tie, strict=True, prefix="start_", stretch=stretch)
    return joined.where(F.col(f"start_{start_ts}").isNotNull())


def provenance_chain(changes: DataFrame, transactions: DataFrame, sessions: DataFrame | None = None, version: str = "version") -> DataFrame:
    """Changes with the transaction that made them (its version is one before) and, where given, its session."""
    made = transactions.withColumn("__version", F.col("ct_version") + 1)
    out = changes.join(made, changes[version] == made["__version"], "left").drop("__version")
    return out if sessions is None else out.join(sessions, "session_id", "left")


def commit_provenance(author: str | None, message: str | None, traceparent: str | None, extra: dict | None = None) -> dict[str, str | None]:
    """What a commit records of its maker: author, message and a JSON text with the trace."""
    import json

    info = {k: v for k, v in {"traceparent": traceparent, **(extra or {})}.items() if v is not None}
    return {"author": author, "commit_message": message, "commit_extra_info": json.dumps(info, sort_keys=True) if info else None}


def inferred_records(rows: DataFrame, event_time: str, observed: Column, body: list[str], fidelity: str) -> DataFrame:
    """Log records inferred from data: when it happened, when it was seen, what is known, and how faithfully."""
    return rows.select(F.col(event_time).alias("timestamp"), observed.alias("observed_timestamp"), F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("body"), F.lit(fidelity).alias("fidelity"))
