"""Reading tables with checked schemas, metric files, and writing reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorwake.contracts import require_columns


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def require_file(spark: SparkSession, path: str) -> str:
    """Raises FileNotFoundError unless path exists, in whatever store it names."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return path


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(require_file(spark, path), wholetext=True).first()["value"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


# Sources


def derive_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema of a CSV file inferred from all its rows; keep it with save_schema and read with scan_csv."""
    return spark.read.csv(require_file(spark, path), header=True, inferSchema=True, samplingRatio=1.0, nullValue="").schema


def save_schema(spark: SparkSession, schema: T.StructType, path: str) -> None:
    write_text(spark, path, schema.json())


def load_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(read_text(spark, path)))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, columns=None) -> DataFrame:
    """A CSV file, strictly by its schema (bad values fail the read), empty strings null. Without a schema it is inferred.

    With columns, missing ones raise ValueError and only these are parsed.
    """
    schema = schema or derive_schema(spark, path)
    df = spark.read.csv(require_file(spark, path), header=True, schema=schema, mode="FAILFAST", nullValue="", enforceSchema=False)
    if columns:
        require_columns(df, columns)
        df = df.select(*columns)
    return df


def scan_parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    if columns:
        require_columns(df, columns)
        df = df.select(*columns)
    return df


def frame(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    """A small frame of dicts with an explicit schema, so columns of nulls have their types."""
    return spark.createDataFrame(rows, schema)


def with_identity(events: DataFrame, identity: DataFrame, id_col: str, columns) -> DataFrame:
    """Events with an identity table's columns: a left join on the id, both sides pruned first."""
    return events.join(identity.select(id_col, *columns), id_col, "left")


def read_metrics(spark: SparkSession, path: str) -> dict:
    """Metrics of a JSON file; refuses those that were not measured on validation."""
    out = json.loads(read_text(spark, path))
    if out.get("evaluation_partition") != "validation":
        raise ValueError(f"{path} was not measured on validation")
    return out


# Sinks


def write_json(spark: SparkSession, path: str, value) -> None:
    """A dict, or the one row of a frame, with sorted keys."""
    if isinstance(value, DataFrame):
        value = value.limit(1).first().asDict(recursive=True)
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite")


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of a report frame's first rows."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(most).collect()]) + "\n"


def replace_section(document: str, begin: str, end: str, text: str) -> str:
    """The document with what lies between two marker lines replaced; raises ValueError if a marker is missing."""
    a = document.find(begin)
    b = document.find(end, a + len(begin)) if a >= 0 else -1
    if a < 0 or b < 0:
        raise ValueError("markers are missing")
    return document[: a + len(begin)] + "\n" + text.strip("\n") + "\n" + document[b:]


def update_section(spark: SparkSession, path: str, begin: str, end: str, text: str) -> None:
    write_text(spark, path, replace_section(read_text(spark, path), begin, end, text))


def importance_report(importance: DataFrame) -> DataFrame:
    """(feature, gain) by gain, then name."""
    return importance.orderBy(F.desc("gain"), "feature")
