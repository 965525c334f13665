"""A log of HTTP requests as a table of a lake: appended to, asked for the last response of each URL and for what to fetch again."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import latest
from tidemark.sources.lake import Lake

#: What the log keeps of a request and its response.
COLUMNS = [
    ("local_path_response_body", "varchar"), ("response_body_bytes_written", "int64"), ("request_url", "varchar"), ("request_method", "varchar"), ("request_headers", "varchar"),
    ("request_cookies", "varchar"), ("request_body", "binary"), ("response_status", "varchar"), ("response_status_code", "int32"), ("response_headers", "varchar"), ("response_cookies", "varchar"),
    ("response_body", "binary"), ("remote_address", "varchar"), ("timings", "varchar"), ("meta", "varchar"), ("url_template_family", "varchar"), ("url_template_name", "varchar"),
]
KEY = ["request_method", "request_url"]


def header(headers: Column, name: str) -> Column:
    """The first value of a header in wire format, whatever its case; null where it is missing."""
    found = F.regexp_extract(headers, rf"(?im)^{name}\s*:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


@dataclass
class RequestLog:
    """The log, with ``requested_at`` and ``seq`` (an order among requests of one instant) beside the columns of a request."""

    lake: Lake
    name: str = "http_request"

    def create(self) -> RequestLog:
        if not any(r["table_name"] == self.name for r in self.lake.living("table")):
            self.lake.create_table(self.name, [*COLUMNS, ("requested_at", "timestamp_ntz"), ("seq", "int64")])
        return self

    def record(self, requests: DataFrame | list[dict], when: dt.datetime | None = None) -> int:
        """Append requests; a few stay in the lake's log and make no file."""
        return self.lake.write(self.name, requests, when=when, inline=64)

    def log(self, upto: Column | None = None) -> DataFrame:
        rows = self.lake.read(self.name)
        return rows if upto is None else rows.where(F.col("requested_at") <= upto)

    def last(self, upto: Column | None = None, good: bool = True) -> DataFrame:
        """The last response of each method and URL, of those of status 200 to 299 if ``good``."""
        rows = self.log(upto)
        return latest(rows.where(F.col("response_status_code").between(200, 299)) if good else rows, KEY, ["requested_at", "seq"])

    def due(self, now: Column, seconds: int, tries: int = 3) -> DataFrame:
        """method, url, reason of what to fetch again: ``failed`` with fewer than ``tries`` failures since the last good response, or ``stale``."""
        rows = self.log(now)
        good = F.col("response_status_code").between(200, 299)
        seen = F.struct("requested_at", "seq")
        per_url = rows.groupBy(*KEY).agg(F.max(F.when(good, seen)).alias("good"), F.max(seen).alias("last"))
        failures = rows.where(~good | F.col("response_status_code").isNull()).select(*KEY, seen.alias("at")).join(per_url, KEY).where(F.col("good").isNull() | (F.col("at") > F.col("good")))
        counted = per_url.join(failures.groupBy(*KEY).agg(F.count(F.lit(1)).alias("failures")), KEY, "left").na.fill(0, ["failures"])
        old = F.col("good.requested_at") < now - F.make_dt_interval(secs=F.lit(seconds))
        reason = F.when((F.col("failures") > 0) & (F.col("failures") < tries), "failed").when((F.col("failures") == 0) & old, "stale")
        return counted.select(*KEY, reason.alias("reason")).where("reason is not null")
