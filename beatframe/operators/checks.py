"""Contract checks. Each gives tidy rows: check, scope, observed, expected, passed; nothing raises but assert_passed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.functions.arrays import all_finite, close, minus, plus

EPS32 = 1.1920928955078125e-07


def tidy(df: DataFrame, check: str, observed: Column, expected: Column | float, passed: Column, scope: Column | str = "all") -> DataFrame:
    scope = scope if isinstance(scope, Column) else F.lit(scope)
    expected = expected if isinstance(expected, Column) else F.lit(float(expected))
    return df.select(F.lit(check).alias("check"), scope.cast("string").alias("scope"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"), F.coalesce(passed, F.lit(False)).alias("passed"))


def none_of(df: DataFrame, check: str, bad: Column, by: str | None = None) -> DataFrame:
    """No row, of all or of each scope, is bad."""
    n = F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("int")), F.lit(0)).alias("n")
    g = df.groupBy(by).agg(n) if by else df.agg(n)
    return tidy(g, check, F.col("n"), 0, F.col("n") == 0, F.col(by) if by else "all")


def columns_present(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """VA1: the table has the column, and a value in it; one scan for all."""
    counts = df.agg(*[(F.count(c) if c in df.columns else F.lit(0).cast("long")).alias(f"n{i}") for i, c in enumerate(required)], F.lit(0).alias("_"))
    rows = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n{i}").alias("n")) for i, c in enumerate(required)])
    d = counts.select(F.explode(rows).alias("r"))
    return tidy(d, "column_present", (F.col("r.n") > 0).cast("double"), 1, F.col("r.n") > 0, F.col("r.c"))


def row_count(df: DataFrame, multiple: int, by: str | None = None) -> DataFrame:
    """VA2: some rows, and whole groups of `multiple`."""
    g = df.groupBy(by).agg(F.count("*").alias("n")) if by else df.agg(F.count("*").alias("n"))
    return tidy(g, "row_count_multiple", F.col("n"), multiple, (F.col("n") > 0) & (F.col("n") % multiple == 0), F.col(by) if by else "all")


def width(df: DataFrame, vector: str, n: int) -> DataFrame:
    """VA3."""
    return none_of(df, "width", F.size(vector) != n)


def constant(df: DataFrame, vector: str, value: float) -> DataFrame:
    """VA4."""
    return none_of(df, "constant", F.exists(vector, lambda x: ~close(x, F.lit(value))))


def finite_values(df: DataFrame, vector: str) -> DataFrame:
    """VA5."""
    return none_of(df, "finite", ~all_finite(vector))


def signs(df: DataFrame, vector: str, *, by: str, positive: str) -> DataFrame:
    """VA6: of scope `positive` all values are above 0; of every other scope both signs occur."""
    g = df.groupBy(by).agg(F.min(F.array_min(vector)).alias("lo"), F.max(F.array_max(vector)).alias("hi"))
    ok = F.when(F.col(by) == positive, F.col("lo") > 0).otherwise((F.col("lo") < 0) & (F.col("hi") > 0))
    return tidy(g, "signs", F.col("lo"), 0, ok, F.col(by))


def anatomy_complete(df: DataFrame, *, frames: int = 250, beats: int = 5) -> DataFrame:
    """VA7."""
    g = df.groupBy("anatomy_id").agg(F.count("*").alias("n"), F.countDistinct("beat_id").alias("b"))
    return tidy(g, "anatomy_complete", F.col("n"), frames, (F.col("n") == frames) & (F.col("b") == beats), F.col("anatomy_id"))


def beat_complete(df: DataFrame, *, fpb: int = 50) -> DataFrame:
    """VA8: exactly the samples 0 to fpb - 1."""
    g = df.groupBy("beat_id").agg(F.count("*").alias("n"), F.countDistinct("sample_index").alias("d"), F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi"))
    ok = (F.col("n") == fpb) & (F.col("d") == fpb) & (F.col("lo") == 0) & (F.col("hi") == fpb - 1)
    return tidy(g, "beat_complete", F.col("n"), fpb, ok, F.col("beat_id"))


def reference_present(df: DataFrame, *, by: str, order: str, k: int = 0) -> DataFrame:
    """WN3: each recording has its reference frame k; where it has none, referenced components are null."""
    g = df.groupBy(by).agg(F.count_if(F.col(order) == k).alias("n"))
    return tidy(g, "reference_present", F.col("n"), 1, F.col("n") == 1, F.col(by))


def stored_in_order(df: DataFrame, *, position: str) -> DataFrame:
    """VA9: along the stored position, samples rise by one inside each beat."""
    w = Window.partitionBy("beat_id").orderBy(position)
    step = F.col("sample_index") - F.lag("sample_index").over(w)
    return none_of(df.withColumn("_step", step), "stored_in_order", F.coalesce(F.col("_step") != 1, F.lit(False)), "beat_id")


def first_frame_zero(df: DataFrame, column: str, *, order: str, atol: float = 2e-7) -> DataFrame:
    """VA10: each anatomy's first frame is the zero of its reference."""
    g = df.groupBy("anatomy_id").agg(F.min_by(column, order).alias("x"))
    return tidy(g, "first_frame_zero", F.col("x"), 0, F.abs("x") <= atol, F.col("anatomy_id"))


def constant_within(df: DataFrame, vector: str, *, by: str, order: str) -> DataFrame:
    """VA11: inside each group every frame has the first one's vector."""
    first = F.first(vector).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    bad = F.exists(F.zip_with(vector, "_first", lambda x, y: ~close(x, y)), lambda b: b)
    return none_of(df.withColumn("_first", first), "constant_within", bad, by)


def additive_identity(df: DataFrame, reference: str, delta: str, absolute: str) -> DataFrame:
    """VA12: reference + delta = absolute, to a few float32 units at the observed size."""
    error = F.array_max(F.transform(minus(plus(reference, delta), absolute), F.abs))
    size = F.array_max(F.transform(F.col(absolute), F.abs))
    g = df.agg(F.max(error).alias("e"), F.max(size).alias("m"))
    limit = F.greatest(F.lit(2e-8), 4 * EPS32 * F.greatest("m", F.lit(1.0)))
    return tidy(g, "additive_identity", F.col("e"), limit, F.col("e") <= limit)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """VA13: both sides hold the same keys."""
    both = a.select(*keys, F.lit(1).alias("_a")).join(b.select(*keys, F.lit(1).alias("_b")), keys, "full")
    return none_of(both, "same_keys", F.col("_a").isNull() | F.col("_b").isNull())


def component_sum(full: DataFrame, hp: DataFrame, lp: DataFrame, keys: list[str], value: str, *, atol: float) -> DataFrame:
    """VA14: full = hp + lp."""
    j = full.select(*keys, F.col(value).alias("_f")).join(hp.select(*keys, F.col(value).alias("_h")), keys).join(lp.select(*keys, F.col(value).alias("_l")), keys)
    g = j.agg(F.max(F.abs(F.col("_h") + F.col("_l") - F.col("_f"))).alias("e"))
    return tidy(g, "component_sum", F.col("e"), atol, F.col("e") <= atol)


def split_leakage(df: DataFrame, unit: str, split: str) -> DataFrame:
    """VA15: no unit is in two splits."""
    g = df.groupBy(unit).agg(F.countDistinct(split).alias("n"))
    return none_of(g, "split_leakage", F.col("n") > 1)


def split_cardinality(df: DataFrame, unit: str, split: str, expected: dict[str, int]) -> DataFrame:
    """VA16."""
    want = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    g = df.groupBy(split).agg(F.countDistinct(unit).alias("n")).withColumn("w", F.element_at(want, F.col(split)))
    return tidy(g, "split_cardinality", F.col("n"), F.col("w"), F.col("n") == F.col("w"), F.col(split))


def only_values(df: DataFrame, column: str, allowed: set[str]) -> DataFrame:
    """VA17: the set of values is the allowed one."""
    g = df.agg(F.collect_set(column).alias("s"))
    want = F.array(*[F.lit(x) for x in sorted(allowed)])
    return tidy(g, "only_values", F.size("s"), len(allowed), F.array_sort("s") == want)


def side_records(frames: DataFrame, side: DataFrame, key: str, required: list[str]) -> DataFrame:
    """VA18: a side record for each unit, with the required fields."""
    j = frames.select(key).distinct().join(side.select(key, F.lit(1).alias("_there"), *required), key, "left")
    bad = F.col("_there").isNull()
    for c in required:
        bad = bad | F.col(c).isNull()
    return none_of(j, "side_records", bad)


def columns_equal(df: DataFrame, a: str, b: str) -> DataFrame:
    """VA19."""
    return none_of(df, "columns_equal", ~F.col(a).eqNullSafe(F.col(b)))


def augmented_pack(clean: DataFrame, augmented: DataFrame, keys: list[str], target: str, signal: str) -> DataFrame:
    """VA20: same keys and targets, another signal."""
    j = clean.select(*keys, F.col(target).alias("_t"), F.col(signal).alias("_s")).join(augmented.select(*keys, F.col(target).alias("_u"), F.col(signal).alias("_v")), keys, "full")
    g = j.agg(F.count("*").alias("n"), F.bool_and(F.col("_t").eqNullSafe(F.col("_u"))).alias("t"), F.bool_or(~F.col("_s").eqNullSafe(F.col("_v"))).alias("s"))
    return tidy(g, "augmented_pack", F.col("n"), F.col("n").cast("double"), F.col("t") & F.col("s"))


def gate_flags(df: DataFrame, flags: list[str], by: str) -> DataFrame:
    """VA21: every flag of each row is true."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & F.coalesce(F.col(f), F.lit(False))
    return none_of(df, "gate_flags", ~ok, by)


def contiguous(df: DataFrame, *, by: str, order: str) -> DataFrame:
    """VA22: one anatomy and one beat, samples one after another."""
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumn("_step", F.lead(order).over(w) - F.col(order))
    g = d.groupBy(by).agg(F.countDistinct("anatomy_id", "beat_id").alias("u"), F.max("_step").alias("hi"), F.min("_step").alias("lo"))
    ok = (F.col("u") == 1) & F.coalesce((F.col("hi") == 1) & (F.col("lo") == 1), F.lit(True))
    return tidy(g, "contiguous", F.col("u"), 1, ok, F.col(by))


def unit_row_sums(coo: DataFrame, *, row: str = "row", value: str = "value", atol: float = 1e-12) -> DataFrame:
    """VA23."""
    g = coo.groupBy(row).agg(F.sum(value).alias("s"))
    return none_of(g, "unit_row_sums", F.abs(F.col("s") - 1) > atol)


def identical_arrays(a: DataFrame, b: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """VA24: equal vectors for every key; NaN equals NaN."""
    j = a.select(*keys, F.col(vector).alias("_a")).join(b.select(*keys, F.col(vector).alias("_b")), keys, "full")
    return none_of(j, "identical_arrays", ~F.col("_a").eqNullSafe(F.col("_b")))


def one_value_per(df: DataFrame, by: str, columns: list[str], check: str = "one_value_per") -> DataFrame:
    """VA25, VA26: the columns have one value in each group."""
    g = df.groupBy(by).agg(F.countDistinct(F.struct(*columns)).alias("n"))
    return tidy(g, check, F.col("n"), 1, F.col("n") == 1, F.col(by))


def conditional_column(df: DataFrame, column: str, like: str, *, split: str, where: str) -> DataFrame:
    """VA27: the column is there in split `where` alone, as wide as `like`."""
    bad = F.when(F.col(split) == where, F.col(column).isNull() | (F.size(column) != F.size(like))).otherwise(F.col(column).isNotNull())
    return none_of(df, "conditional_column", bad, split)


def corpus_summary(df: DataFrame, target: str, signal: str, by: list[str]) -> DataFrame:
    """VA28: frames, anatomies, beats, target_rms, negative_fraction, signal_rms of each group; from sums, in one pass."""
    sq = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    n = lambda c: F.sum(F.size(c))
    return df.groupBy(*by).agg(
        F.count("*").alias("frames"), F.countDistinct("anatomy_id").alias("anatomies"), F.countDistinct("beat_id").alias("beats"), F.sqrt(sq(target) / n(target)).alias("target_rms"),
        (F.sum(F.size(F.filter(target, lambda x: x < 0))) / n(target)).alias("negative_fraction"), F.sqrt(sq(signal) / n(signal)).alias("signal_rms"),
    )


def roll_up(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """VA29: passed, n_checks, failures (sorted 'check scope')."""
    failed = F.when(~F.col("passed"), F.concat_ws(" ", "check", "scope"))
    return checks.groupBy(*(by or [])).agg(F.bool_and("passed").alias("passed"), F.count("*").alias("n_checks"), F.array_sort(F.collect_list(failed)).alias("failures"))


def assert_passed(checks: DataFrame) -> None:
    """The one place that raises; shows at most 20 failures."""
    failed = checks.filter(~F.col("passed")).limit(20).collect()
    if failed:
        raise ValueError("; ".join(f"{r['check']} {r['scope']}: {r['observed']} (expected {r['expected']})" for r in failed))


