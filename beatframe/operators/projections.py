"""Projections and filters on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.functions.arrays import finite

CURRENT_A = -0.01
RINGS = tuple(f"US{n:03d}" for n in range(60, 135, 5))


def resistance_to_voltage(df: DataFrame, column: str, *, current_a: float = CURRENT_A, out: str = "voltage") -> DataFrame:
    """-I R; works on a number or an array column."""
    array = isinstance(df.schema[column].dataType, T.ArrayType)
    return df.withColumn(out, F.transform(column, lambda r: r * -current_a) if array else F.col(column) * -current_a)


def model_input(df: DataFrame, hp: str, lp: str, *, by: list[str], order: str, out: str = "input") -> DataFrame:
    """-(V - V_first) of V = hp + lp, with the first frame of each group as reference."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(hp) + F.col(lp)
    return df.withColumn(out, F.first(v).over(w) - v)


def flip_sign(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, F.transform(vector, lambda x: -x))


def fill_outside(df: DataFrame, vector: str, fill: float) -> DataFrame:
    """NaN (a place outside the domain) becomes fill."""
    return df.withColumn(vector, F.transform(vector, lambda x: F.nanvl(x, F.lit(fill))))


def floor_values(df: DataFrame, vector: str, floor: float, *, clipped: str = "clipped") -> DataFrame:
    """Values below floor become floor; how many did is in clipped."""
    n = F.size(F.filter(vector, lambda x: x < floor))
    return df.withColumn(clipped, n).withColumn(vector, F.transform(vector, lambda x: F.greatest(x, F.lit(floor))))


def ring_label(size: Column) -> Column:
    """12 or '10.5' to US120 or US105; null for sizes outside the list. Halves round to even."""
    number = F.bround(size.try_cast("double") * 10).cast("int")
    label = F.format_string("US%03d", number)
    return F.when(label.isin(*RINGS), label)


def phase_filter(df: DataFrame, anatomy: int, beat: int, *, order: str = "sample_index") -> DataFrame:
    """Frames of one beat of one anatomy, in order."""
    return df.filter((F.col("anatomy_id") == anatomy) & (F.col("beat_id") == beat)).orderBy(order)


def not_excluded(df: DataFrame, reason: str = "exclusion_reason") -> DataFrame:
    return df.filter(F.col(reason).isNull() | (F.col(reason) == ""))


def scalar_columns(df: DataFrame) -> DataFrame:
    """Without nested columns."""
    return df.select(*[f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)])


def baseline(df: DataFrame, like: str, *, value: float = 0.7, out: str = "sigma_baseline") -> DataFrame:
    return df.withColumn(out, F.array_repeat(F.lit(value), F.size(like)))


def only_finite(df: DataFrame, column: str) -> DataFrame:
    return df.filter(finite(column))
