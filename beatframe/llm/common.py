"""What the training-data operators share: reading tables, shared scratch tables, safe column names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.functions.tables import shared_folder, stored  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_list_sha256(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ","), 256)


def map_texts(df: DataFrame, keep: list[str], text: Column, kernel, out: str, *, slice_bytes: int = 2_000_000) -> DataFrame:
    """Column row (a struct of the columns in keep) and the columns of the DDL string out.

    kernel gets an iterator of Arrow binary arrays (UTF-8 texts, nulls stay null), each of about
    slice_bytes or one text, and yields for each a list of arrays in the order of out. Columns of df can
    have any names, as they travel inside the struct.
    """
    fields = T._parse_datatype_string(out)
    schema = T.StructType([T.StructField("row", df.select(*keep).schema), *fields.fields])

    def run(batches):
        held = []

        def slices():
            for b in batches:
                data = b.column(1)
                ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                at = 0
                while at < len(data):
                    n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slice_bytes, "right")) - at)
                    held.append(b.column(0).slice(at, n))
                    yield data.slice(at, n)
                    at += n

        for arrays in kernel(slices()):
            yield pa.RecordBatch.from_arrays([held.pop(0), *arrays], names=[f.name for f in schema])

    return df.select(F.struct(*[df[c] for c in keep]).alias("row"), text.cast("binary").alias("text")).mapInArrow(run, schema)
