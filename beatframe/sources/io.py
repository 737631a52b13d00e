"""Sources and sinks: frame corpora, nested records, reports, tables, fingerprints."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION_NAME = r"^(?:.*/)?([A-Za-z]+\d+)_([A-Za-z]+)(\d*)\.\w+$"
SESSION_ORDER = ("baseline", "rest", "exercise", "recovery")


def read_npz(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """IO1, IO2: one row for each entry of axis 0 of the arrays named in fields (name to Spark type), and path, row.

    One file is one task, and only the named arrays are unpacked. A field that a file lacks is null.
    """

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    have = {f: z[f] for f in fields if f in z}
                    n = max((len(v) for v in have.values()), default=0)
                    for a in range(0, n, 1000):
                        out = {"path": name, "row": np.arange(a, min(n, a + 1000))}
                        out |= {f: list(have[f][a : a + 1000]) if f in have else [None] * min(1000, n - a) for f in fields}
                        yield pd.DataFrame(out)

    schema = ", ".join(["path string", "row bigint", *(f"{f} {k}" for f, k in fields.items())])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def defaulted(df: DataFrame, column: str, default: str) -> DataFrame:
    """IO2: column, or default where it is null or there is no such column."""
    return df.withColumn(column, F.coalesce(F.col(column), F.col(default)) if column in df.columns else F.col(default))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """IO3: nested records of JSON arrays, one row each."""
    return spark.read.option("multiLine", True).json(path)


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """IO4: report trees <experiment>/evaluation/report.json, with the experiment's name."""
    d = spark.read.option("multiLine", True).json(pattern)
    return d.withColumn("experiment", F.regexp_extract("_metadata.file_path", r"([^/]+)/evaluation/[^/]+$", 1))


def preferred_file(files: DataFrame, *, root: str = "root", path: str = "path", preferred: tuple[str, ...] = ("report.json", "summary.json")) -> DataFrame:
    """IO5: of each root the file with a preferred name, else the first by name."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    rank = F.lit(len(preferred))
    for i, p in reversed(list(enumerate(preferred))):
        rank = F.when(name == p, i).otherwise(rank)
    w = Window.partitionBy(root).orderBy(rank, path)
    return files.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """IO7: the named fields of CSV tables with a header; others are ignored."""
    return spark.read.option("header", True).csv(path).select(*fields)


def write_csv(df: DataFrame, path: str, fields: list[str], *, append: bool = False) -> None:
    df.select(*fields).write.mode("append" if append else "errorifexists").option("header", True).csv(path)


def write_once(df: DataFrame, path: str, partitions: list[str]) -> None:
    """IO8: refuses an existing path; Spark's committer leaves _SUCCESS only when all tasks are done."""
    out = df.repartition(*partitions) if partitions else df
    out.write.mode("errorifexists").partitionBy(*partitions).parquet(path)


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    """IO8, IO9: a table whose write has ended; ring, split and component come from its folders, and filters on them prune folders."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise ValueError(f"{path} is incomplete")
    return spark.read.parquet(path)


def frame_slice(df: DataFrame, *, order: str, start: int, n: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """IO10: frames start to start + n - 1 of each group, and the groups that have fewer."""
    d = df.filter(F.col(order).between(start, start + n - 1))
    every = df.select(*by).distinct()
    return d, every.join(d.groupBy(*by).count(), by, "left").filter(F.coalesce("count", F.lit(0)) < n).select(*by, F.coalesce("count", F.lit(0)).alias("frames"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """IO11: path and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


LIMBS, DIGITS = 10, 6


def value_fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """IO11: one fingerprint of the selected values, whatever the order and the partitions of rows: fingerprint and rows, one row.

    A row's SHA-256 is cut into ten numbers of 24 bits; each is summed over all rows, and the fingerprint is the digest of the sums and the
    count. Sums are combined where the rows are, so nothing grows with the table: a task passes on eleven numbers (which hold 5e11 rows).
    Repeated rows count each. Values are told apart by their lengths, and nulls from every value. It shows changes, and isn't meant to withstand someone who looks for collisions.
    """
    text = [F.col(c).cast("string") for c in [*keys, *columns]]
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("null")) for t in text]), 256)
    limbs = [F.sum(F.conv(F.substring("_h", 1 + DIGITS * i, DIGITS), 16, 10).cast("long")).alias(f"_s{i}") for i in range(LIMBS)]
    sums = df.select(row.alias("_h")).agg(F.count("*").alias("rows"), *limbs)
    parts = [F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(LIMBS)]
    return sums.select(F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *parts), 256).alias("fingerprint"), "rows")


def sessions(files: DataFrame, path: str = "path") -> DataFrame:
    """IO12: subject, session, number and rank of files named <subject>_<session><number>.<type>; other files are left out."""
    part = lambda i: F.regexp_extract(path, SESSION_NAME, i)
    d = files.withColumn("subject", F.lower(part(1))).withColumn("session", F.lower(part(2))).withColumn("number", part(3).try_cast("int")).filter("subject <> ''")
    rank: Column = F.lit(len(SESSION_ORDER))
    for i, name in reversed(list(enumerate(SESSION_ORDER))):
        rank = F.when(F.col("session") == name, i).otherwise(rank)
    return d.withColumn("session_rank", rank)


def transpose(df: DataFrame, *, by: list[str], channel: str, vector: str) -> DataFrame:
    """IO14: channel-major rows (one array over frames for each channel) to frame-major ones: by, frame_no, v over channels."""
    d = df.select(*by, channel, F.posexplode(vector).alias("frame_no", "x"))
    packed = F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), "x")))
    return d.groupBy(*by, "frame_no").agg(F.transform(packed, lambda s: s["x"]).alias("v"))


