"""Helpers that several operators share: the cluster's shared folder and streaming over Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes that one vectorised step works on; longer documents get a step of their own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a session on one machine gets a local one, and a cluster an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="studyflow-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: With this, Spark deletes the shuffle files of a query when it ends, not when its plan is forgotten.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, so that its lineage, and the disk that its shuffles take, end there."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" not in path:
            raise ValueError(f"not a table of this module: {path}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut the rows of a string column into ranges of about ``limit`` bytes of text, at least a row each."""
    lengths = np.diff(offsets(column))
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(column):
        yield start, len(column)


def offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_large_list(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows in it."""
    at = offsets(column)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column in which null has become the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def map_text(
    df: DataFrame, text: str, schema: T.StructType | str, step: Callable[[pa.RecordBatch, pa.Array], dict[str, object] | None]
) -> DataFrame:
    """Apply ``step`` to row ranges of bounded text; it gets the rows and their texts, and returns columns by name."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = fields.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(fields)
        for batch in batches:
            column = text_column(batch, text)
            for a, b in steps(column):
                out = step(batch.slice(a, b - a), column.slice(a, b - a))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([_as(out[n], kinds.field(n).type) for n in names], names=names)

    return df.mapInArrow(run, fields)


def filter_text(df: DataFrame, text: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, for whose text ``keep`` says true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_column(batch, text)
            for a, b in steps(column):
                yield batch.slice(a, b - a).filter(pa.array(keep(column.slice(a, b - a)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"_{name}{k or ''}").lower() not in taken) for name in names]


def lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column: ``counts[i]`` of the values for row i."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), values if isinstance(values, pa.Array) else pa.array(values))


def _as(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)
