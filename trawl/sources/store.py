"""Intermediate tables: written to the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a session on one machine gets a temporary one; a cluster has no such folder and must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="trawl-"))
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that later steps don't repeat what made it, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trawl-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose lists in a column have `most` elements together, or that are one row: what is made of a piece in a task has a bounded size, however long the rows of a batch are."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        room = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        end = min(max(room, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
