"""File sources: delimited, JSON and Parquet files, listings, footers, and frames from Arrow tables.

Paths are URIs that Spark's readers open; nothing here depends on where they lie.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A portal's catalog records, as far as they are used.
CATALOG_RECORD = (
    "metadata struct<domain:string>, permalink string, owner struct<id:string,display_name:string>, "
    "classification struct<categories:array<string>,domain_tags:array<string>,domain_category:string>, "
    "resource struct<id:string,name:string,description:string,type:string,createdAt:string,updatedAt:string,metadata_updated_at:string,data_updated_at:string,"
    "publication_date:string,attribution:string,attribution_link:string,provenance:string,page_views:struct<page_views_total:bigint>,download_count:bigint,"
    "columns_name:array<string>,columns_field_name:array<string>,columns_datatype:array<string>,columns_description:array<string>>"
)


def delimited(spark: SparkSession, path: str, separator: str = "\t", schema: str | T.StructType | None = None, keep_bad: bool = False) -> DataFrame:
    """A delimited file with a header; all columns are text unless a schema is given. Rows that don't fit are dropped, or kept in ``_bad``."""
    reader = spark.read.options(header=True, sep=separator, inferSchema=False, mode="PERMISSIVE" if keep_bad else "DROPMALFORMED")
    if keep_bad:
        plain = spark.read.options(header=True, sep=separator, inferSchema=False).csv(path).schema if schema is None else schema
        whole = T._parse_datatype_string(plain) if isinstance(plain, str) else plain
        return reader.option("columnNameOfCorruptRecord", "_bad").schema(T.StructType([*whole.fields, T.StructField("_bad", T.StringType())])).csv(path)
    return (reader if schema is None else reader.schema(schema)).csv(path)


def json_records(spark: SparkSession, path: str, schema: str | T.StructType = CATALOG_RECORD, whole_files: bool = True) -> DataFrame:
    """Records of JSON files that hold an array each (or a record a line), by a given schema: nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", whole_files).json(path)


def json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path, size, content, valid of every file under a folder, at any depth."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    found = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"))
    return found.withColumn("valid", F.try_parse_json("content").isNotNull())


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, rows of every file of a Parquet folder; only footers and no column is read."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return rows.groupBy("path", "size").agg(F.count(F.lit(1)).alias("rows"))


def parquet_columns(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema.fields]


def footers(spark: SparkSession, path: str) -> DataFrame:
    """path, size, footer_size of every Parquet file: the last 8 bytes hold the footer's length and the magic mark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    tail = files.select("path", F.col("length").alias("size"), F.expr("substring(content, -8, 8)").alias("tail"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack("<I", t[:4])[0] if t and len(t) == 8 and t[4:] == b"PAR1" else None for t in batch.column("tail").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(found, pa.int64())], ["path", "size", "footer_size"])

    return tail.mapInArrow(measure, "path string, size bigint, footer_size bigint")


def write_with_ids(df: DataFrame, path: str, ids: dict[str, int]) -> None:
    """Write Parquet whose columns carry ids."""
    columns = [F.col(c).alias(c, metadata={"parquet.field.id": ids[c]}) for c in df.columns]
    df.select(*columns).write.option("spark.sql.parquet.fieldId.write.enabled", "true").parquet(path)


def read_with_ids(spark: SparkSession, path: str, schema: T.StructType, ids: dict[str, int]) -> DataFrame:
    """Read Parquet by column ids: renamed columns are found, ids that a file lacks are null."""
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    bound = T.StructType([T.StructField(f.name, f.dataType, True, {"parquet.field.id": ids[f.name]}) for f in schema.fields])
    return spark.read.schema(bound).parquet(path)


def from_rows(spark: SparkSession, columns: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    """Tuples of the control plane as a frame, by way of an Arrow table."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
    arrays = [pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(columns)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[n for n, _ in columns]))


def merge_pages(pages: DataFrame, key: str, page: str = "page", position: str = "position") -> DataFrame:
    """One row for each key over overlapping pages: the first in page order, whichever task reads it."""
    order = Window.partitionBy(key).orderBy(page, position)
    return pages.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def workbook(spark: SparkSession, path: str, sheet: str | int = 0, cells: str | None = None) -> DataFrame:
    """A sheet of a workbook, or a range of it such as ``B2:D9``, whose first row names the columns. Driver-side; needs pandas' own reader."""
    import pandas as pd

    options: dict = {"sheet_name": sheet, "dtype": object}
    if cells:
        first, last = (c.strip("$") for c in cells.split(":"))
        letters, numbers = zip(*(("".join(x for x in c if x.isalpha()), int("".join(x for x in c if x.isdigit()))) for c in (first, last)), strict=True)
        options |= {"usecols": f"{letters[0]}:{letters[1]}", "skiprows": numbers[0] - 1, "nrows": numbers[1] - numbers[0]}
    return spark.createDataFrame(pd.read_excel(path, **options).astype("string"))
