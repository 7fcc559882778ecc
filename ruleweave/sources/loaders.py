"""Scans of the file formats that samples and logs come in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions.text import basename, time_of_day
from ruleweave.operators.logs import event_tokens


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of text files that aren't blank; line is a number that orders them in their file."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    return text.where("value <> ''")


def _number(text: Column) -> Column:
    """A double; an error names what isn't one."""
    return F.coalesce(text.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double"))


def _without_header(lines: DataFrame, is_header: Column) -> DataFrame:
    """Lines less each file's first one where that is a header."""
    first = lines.groupBy("file").agg(F.min("line").alias("first"))
    joined = lines.join(F.broadcast(first), "file")
    return joined.where(~((F.col("line") == F.col("first")) & is_header)).drop("first")


def read_numeric_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, features array<double>, label): `f1,...,fn,label` with or without a header.

    Blank lines and lines of one column are skipped; a later line that doesn't
    parse is an error. Labels are rounded half away from zero; negative ones are 0.
    """
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    lines = _lines(spark, path).withColumn("p", parts)
    lines = _without_header(lines, F.exists("p", lambda p: p.try_cast("double").isNull())).where(F.size("p") >= 2)
    label = F.round(_number(F.element_at("p", -1))).cast("bigint")
    return lines.select(F.col("line").alias("row_id"), F.transform(F.slice("p", 1, F.size("p") - 1), _number).alias("features"), F.greatest(F.lit(0), label).alias("label"))


def read_binary_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, bits, label): whole numbers, of which what isn't zero is one; a first line whose first column is no number is a header."""
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    lines = _lines(spark, path).withColumn("p", parts)
    lines = _without_header(lines, F.get("p", F.lit(0)).try_cast("bigint").isNull()).where(F.size("p") >= 2)
    whole = lambda p: F.coalesce(p.try_cast("bigint"), F.raise_error(F.concat(F.lit("not a whole number: "), p)).cast("bigint"))
    label = whole(F.element_at("p", -1))
    label = F.when(label < 0, F.raise_error(F.lit("a label is negative")).cast("bigint")).otherwise(label)
    return lines.select(F.col("line").alias("row_id"), F.transform(F.slice("p", 1, F.size("p") - 1), lambda p: (whole(p) != 0).cast("tinyint")).alias("bits"), label.alias("label"))


def read_sparse_binary(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """(row_id, bits, label) of lines `label index index ...`; indices out of range are left out, repeated ones count once, others than whole numbers are errors."""
    whole = lambda p: F.coalesce(p.try_cast("bigint"), F.raise_error(F.concat(F.lit("not a whole number: "), p)).cast("bigint"))
    parts = F.transform(F.split("value", r"\s+"), whole)
    lines = _lines(spark, path).withColumn("p", parts)
    held = F.filter(F.array_distinct(F.slice("p", 2, F.size("p"))), lambda i: (i >= 0) & (i < n_features))
    bits = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.array_contains(held, i.cast("bigint")).cast("tinyint"))
    return lines.select(F.col("line").alias("row_id"), bits.alias("bits"), F.get("p", F.lit(0)).alias("label"))


def _matrix(spark: SparkSession, path: str, rows: int, columns: int, kind: str, out: str) -> DataFrame:
    size = rows * columns * np.dtype(kind).itemsize

    def run(batches):
        for b in batches:
            for content in b["content"]:
                if len(content) != size:
                    raise ValueError(f"the file has {len(content)} bytes, not {size}")
                data = np.frombuffer(content, kind).reshape(rows, columns)
                for at in range(0, rows, 10_000):
                    part = data[at : at + 10_000]
                    yield pd.DataFrame({"row_id": np.arange(at, at + len(part)), "v": list(part) if columns > 1 or out.startswith("array") else part[:, 0]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"row_id bigint, v {out}")


def read_u8_matrix(spark: SparkSession, path: str, rows: int, columns: int) -> DataFrame:
    """(row_id, bits) of a headerless row-major matrix of bytes; its size must be exact."""
    return _matrix(spark, path, rows, columns, "u1", "array<smallint>").select("row_id", F.transform("v", lambda v: (v != 0).cast("tinyint")).alias("bits"))


def read_u32_vector(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(row_id, label) of little-endian 32-bit numbers."""
    return _matrix(spark, path, rows, 1, "<u4", "bigint").withColumnRenamed("v", "label")


def read_f64_vector(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(row_id, target) of little-endian doubles."""
    return _matrix(spark, path, rows, 1, "<f8", "double").withColumnRenamed("v", "target")


def read_ndjson(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """(file, json, fields map<string,string>) of line-delimited JSON objects below a folder.

    Malformed lines are left out, and so are archives' leftovers (`__MACOSX`,
    `._*`) and the map of labels, `tactic_map.json`.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("json"))
    text = text.where(~F.col("file").contains("__MACOSX") & ~basename(F.col("file")).startswith("._") & (basename(F.col("file")) != "tactic_map.json"))
    return text.withColumn("fields", F.from_json("json", "map<string,string>")).where(F.col("fields").isNotNull() & (F.size("fields") > 0))


def read_process_events(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """Process-creation events (event 1 of the channels that begin so) with their time; a missing field is empty, an absent company `<unknown>`."""
    field = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))
    rows = read_ndjson(spark, path, files).where(field("Channel").startswith("Microsoft-Windows-Sysmon") & (field("EventID") == "1"))
    rows = rows.withColumn("ts", time_of_day(field("EventTime"))).where("ts is not null")
    company = field("Company")
    known = company.contains("Microsoft") | company.contains("Google")
    return rows.select("file", "ts", basename(field("Image")).alias("image"), basename(field("ParentImage")).alias("parent"), field("User").alias("user"), field("IntegrityLevel").alias("integrity"), F.when(company == "", "<unknown>").otherwise(company).alias("company"), known.alias("signed"))


def read_open_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, event, tokens) of the line-delimited JSON events, of whatever schema, whose channel begins so; event is 0 where it isn't a number."""
    rows = read_ndjson(spark, path).where(F.coalesce(F.try_element_at("fields", F.lit("Channel")), F.lit("")).startswith("Microsoft-Windows-Sysmon"))
    event = F.coalesce(F.try_element_at("fields", F.lit("EventID")).try_cast("int"), F.lit(0))
    return rows.select("file", event.alias("event"), event_tokens(F.col("json"), event).alias("tokens"))


def label_files(rows: DataFrame, labels: DataFrame, default: int = 0) -> DataFrame:
    """rows with label: that of the longest stem (labels: stem, label) which begins their file's name, or default.

    The map is small; it is folded into one expression, so no join of all pairs is made.
    """
    name = basename(F.col("file"))
    found = F.lit(default)
    for r in sorted(labels.select("stem", "label").collect(), key=lambda r: len(r["stem"])):
        found = F.when(name.startswith(r["stem"]), r["label"]).otherwise(found)
    return rows.withColumn("label", found)
