"""CSV, JSON and Parquet tables in and out, snapshots, previews and pandas frames."""

from __future__ import annotations

import uuid
from typing import Any

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, replace_columns
from ..operators.fit import scalars
from .csvlines import read_csv

FORMATS = ("csv", "json", "parquet")
PREVIEW_ROWS = 10_000
# Doubled quotes inside quotes, spaces kept. A missing value is an empty field and an empty text two
# quotes; a reader tells them apart only if its mark for missing values occurs in no text.
CSV = {
    "header": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
CSV_READ = {**CSV, "nullValue": "\ue000missing\ue000", "emptyValue": ""}
CSV_WRITE = {**CSV, "lineSep": "\n", "nullValue": "", "emptyValue": '""'}


def detect_format(path: str) -> str:
    """The format named by the file ending, in any case."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"unsupported file type {path!r}; expected one of {FORMATS}")
    return ending


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    schema: T.StructType | str | None = None,
    json_lines: bool | None = None,
    sampling_ratio: float | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Read a table lazily. Types of CSV and JSON are inferred (one pass over the data, or over
    ``sampling_ratio`` of it) unless a schema is given.

    CSV may hold line breaks and doubled quotes inside quotes; an empty field is missing and ``""``
    is an empty text. Lines end in a line feed, with or without a carriage return before it. Large files
    are read in parts either way; where no field holds a line break, ``multiline=False`` saves the scan
    that finds out where records begin.

    JSON is one record per line (splittable) or one array of records; None looks at the first
    character of the data.
    """
    format = format or detect_format(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    if format == "csv":
        if multiline:
            known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            return read_csv(spark, path, CSV_READ, known, sampling_ratio)
        return reader.options(**CSV_READ).option("inferSchema", schema is None).csv(path)
    if format == "json":
        if json_lines is None:
            json_lines = _starts_like_lines(spark, path)
        return reader.option("multiLine", not json_lines).json(path)
    if format == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported format {format!r}; expected one of {FORMATS}")


def _starts_like_lines(spark: SparkSession, path: str) -> bool:
    """JSON Lines unless the first non-empty line opens an array or leaves its object open. Only the
    ends of that line reach the driver: a one-line array is the whole file."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    ends = spark.read.text(path).select(
        F.left(line, F.lit(1)).alias("first"), F.right(line, F.lit(1)).alias("last")
    ).where("first <> ''").limit(1).collect()
    return not ends or (ends[0]["first"], ends[0]["last"]) == ("{", "}")


def write_table(df: DataFrame, path: str, format: str | None = None, single_file: bool = False) -> None:
    """Write as a folder of part files; with ``single_file`` ``path`` becomes one file, written by one
    task whatever its size.

    Vectors become numbered columns, and arrays in CSV become space-joined text.
    """
    format = format or detect_format(path)
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r}; expected one of {FORMATS}")
    out = expand_vectors(df)
    if format == "csv":
        arrays = [f.name for f in out.schema if isinstance(f.dataType, T.ArrayType)]
        out = replace_columns(out, {n: F.array_join(col(n), " ") for n in arrays})
    target = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}" if single_file else path
    if single_file:
        out = out.repartition(1)  # the work before it stays parallel
    writer = out.write.mode("overwrite")
    if format == "csv":
        writer = writer.options(**CSV_WRITE)
    writer.format(format).save(target)
    if single_file:
        _only_part(df.sparkSession, target, path)


def _only_part(spark: SparkSession, folder: str, path: str) -> None:
    """Move the one part file of ``folder`` to ``path``, on whatever file system they are."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(
        f.getPath() for f in files.listStatus(paths(folder)) if f.getPath().getName().startswith("part-")
    )
    files.delete(paths(path), True)  # as the overwriting of a folder does
    if not files.rename(part, paths(path)):
        raise OSError(f"could not move {part.toString()} to {path}")
    files.delete(paths(folder), True)


def expand_vectors(df: DataFrame) -> DataFrame:
    """Replace each vector column by scalar columns ``{name}_{i}``.

    The width comes from the column's ML attributes, else from the widest vector.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, VectorUDT)]
    if not names:
        return df
    widths = {n: df.schema[n].metadata.get("ml_attr", {}).get("num_attrs") for n in names}
    unknown = [n for n in names if widths[n] is None]
    widths |= scalars(df, {n: F.max(F.size(vector_to_array(col(n)))) for n in unknown})
    arrays = df.select(*[
        vector_to_array(col(n)).alias(n) if n in names else col(n) for n in df.columns
    ])
    return replace_columns(arrays, {
        n: [F.get(col(n), F.lit(i)).alias(f"{n}_{i}") for i in range(widths[n] or 0)] for n in names
    })


def snapshot(df: DataFrame, folder: str, step: str) -> tuple[DataFrame, dict[str, Any]]:
    """Write an intermediate table under its step name; returns it re-read, and its shape."""
    path = f"{folder.rstrip('/')}/{step}"
    expand_vectors(df).write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return stored, {
        "step": step, "rows": stored.count(), "columns": len(stored.columns), "path": path,
    }


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, order_by: str | list[str] | None = None) -> DataFrame:
    """The first rows; repeatable when an order is given."""
    if order_by:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        df = df.orderBy(*[col(k) for k in keys])
    return df.limit(rows)


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A Spark table from a small pandas frame in the driver; NaN in text columns becomes NULL."""
    texts = frame.select_dtypes(include=["object", "string"]).columns
    return spark.createDataFrame(frame.assign(**{
        c: frame[c].astype(object).where(frame[c].notna(), None) for c in texts
    }))
