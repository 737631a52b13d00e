"""Frame views of the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames in a beat and in the moving mean's window, for these short recordings; operators default to 50 and 100.
FPB, WINDOW = 10, 8


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def frames(self) -> DataFrame:
        """events as one-channel recordings: anatomy_id, frame_no, beat_id, sample_index, x, component."""
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = self("events").select("user_id", "ts", "event_id", "value", "event_type").withColumn("frame_no", F.row_number().over(order).cast("long") - 1)
        return e.select(
            F.col("user_id").alias("anatomy_id"), "frame_no", (F.col("user_id") * 1000 + F.floor(F.col("frame_no") / FPB)).alias("beat_id"),
            (F.col("frame_no") % FPB).alias("sample_index"), F.col("value").alias("x"), F.col("event_type").alias("kind"),
        )

    def vectors(self) -> DataFrame:
        """embeddings as recordings of 64 channels: anatomy_id, frame_no, key (vec_id), v."""
        order = Window.partitionBy("label").orderBy("vec_id")
        e = self("embeddings").withColumn("frame_no", F.row_number().over(order).cast("long") - 1)
        return e.select(F.col("label").alias("anatomy_id"), "frame_no", F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))

    def pairs(self) -> DataFrame:
        """Prediction and truth: each vector against the next one; resting is the one after that."""
        e = self("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
        t = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("truth"))
        r = e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("v").alias("resting"))
        return e.select("vec_id", F.col("label").alias("anatomy_id"), F.col("v").alias("pred")).join(t, "vec_id").join(r, "vec_id").withColumnRenamed("vec_id", "key")


FRAMES = f"""e AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no FROM events),
frames AS (SELECT user_id AS anatomy_id, frame_no, user_id * 1000 + frame_no // {FPB} AS beat_id, frame_no % {FPB} AS sample_index, value AS x, event_type AS kind FROM e)"""
VECTORS = "vectors AS (SELECT label AS anatomy_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
PAIRS = """pairs AS (SELECT p.vec_id AS key, p.label AS anatomy_id, CAST(p.embedding AS DOUBLE[]) AS pred, CAST(t.embedding AS DOUBLE[]) AS truth, CAST(r.embedding AS DOUBLE[]) AS resting
FROM embeddings p JOIN embeddings t ON t.vec_id = p.vec_id + 1 JOIN embeddings r ON r.vec_id = p.vec_id + 2),
el AS (SELECT key, anatomy_id, i, pred[i] AS p, truth[i] AS t, resting[i] AS r FROM (SELECT *, unnest(range(1, len(pred) + 1)) AS i FROM pairs))"""
