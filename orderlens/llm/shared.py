"""What the text operators share: column choice, checkpoints, batch size and input scans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import configure, staging_dir

# Rows of one Arrow batch. Texts reach 100 kB, so a batch stays at tens of MB.
BATCH_ROWS = 512

# A null id orders behind every other id.
LAST_ID = (1 << 63) - 1


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; the checkpoint folder is the session's own."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(staging_dir(spark))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty); other columns, whatever their names, stay out."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def order_id(column: str | Column = "doc_id") -> Column:
    """The id to order by: null comes last."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(LAST_ID))


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that no later step recomputes ``df``."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def ids_and_texts(batch: pa.RecordBatch) -> tuple[pa.Array, list[str]]:
    return batch.column(0), batch.column(1).to_pylist()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its texts."""
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most_bytes`` of text (column 1), or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(1))
        first = 0
        while first < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
            end = min(max(end, first + 1), batch.num_rows)
            yield batch.slice(first, end - first)
            first = end


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder or file name as Spark takes it."""
    if ":/" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pyarrow.fs.FileSystem.from_uri(uri)


def emit(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type, from_pandas=False)
            for c, f in zip(columns, schema, strict=True)
        ],
        schema=schema,
    )
