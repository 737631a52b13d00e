"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.functions.tables import stored

ACCURACY = 2_000


def summarised(df: DataFrame, by: list[str], aggregates: list[Column], quantiles: dict[str, tuple[str | Column, float]], *, accuracy: int = ACCURACY) -> DataFrame:
    """by, the (aliased) aggregates, and a column for each of quantiles (name: value and q): linearly interpolated, nulls left out, NaN above every number; null in groups without a value.

    Two scans, however many quantiles and values, and no task holds a group. The aggregation that makes the aggregates also makes a
    mergeable sketch of each value, whose rank error is below 1 / accuracy, which brackets each quantile for certain;
    its result, a row for each group, is written. A second scan counts what is below each bracket and the distinct values
    inside, before anything is shuffled, so that a group sorts a few thousandths of its rows.
    """
    sources: dict[str, int] = {}
    of = {n: sources.setdefault(v if isinstance(v, str) else repr(v), len(sources)) for n, (v, _) in quantiles.items()}
    values = {f"_v{of[n]}": (F.col(v) if isinstance(v, str) else v).cast("double") for n, (v, _) in quantiles.items()}
    names, margin = list(quantiles), 4.0 / accuracy
    sides = [(max(0.0, q - margin), min(1.0, q + margin)) for _, q in quantiles.values()]
    keyed = df.withColumns({"_g": F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")), **values})
    edges = []
    for v in values:
        mine = [x for i, n in enumerate(names) if f"_v{of[n]}" == v for x in sides[i]]
        edges += [F.count(v).alias(f"_n{v}"), F.percentile_approx(v, F.array(*[F.lit(x) for x in mine]), F.lit(accuracy)).alias(f"_e{v}")]
    groups = stored(keyed.groupBy("_g").agg(*aggregates, *edges))
    brackets, seen = [], dict.fromkeys(values, 0)
    for i, n in enumerate(names):
        v = f"_v{of[n]}"
        at, count = F.col(f"_e{v}"), F.col(f"_n{v}")
        everything = lambda whole, count=count: (count <= accuracy) | F.lit(whole)  # noqa: E731  a sketch's ranks say little about so few, and all of them are not many
        low = F.when(everything(sides[i][0] == 0), float("-inf")).otherwise(F.get(at, F.lit(seen[v])))
        high = F.when(everything(sides[i][1] == 1), float("nan")).otherwise(F.get(at, F.lit(seen[v] + 1)))  # NaN is above every number
        brackets.append(F.struct(low.alias("low"), high.alias("high"), count.alias("n")))
        seen[v] += 2
    known = groups.select("_g", F.array(*brackets).alias("_s"))
    held = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_v{of[n]}").alias("v"), F.col("_s")[i].alias("s")) for i, n in enumerate(names)])
    met = keyed.select("_g", *values).join(known, "_g").select("_g", F.explode(F.filter(held, lambda x: x["v"] <= x["s"]["high"])).alias("_h"))
    inside = F.when(F.col("_h.v") >= F.col("_h.s.low"), F.col("_h.v"))  # null: below the bracket, counted only
    counts = met.groupBy("_g", F.col("_h.i").alias("_i"), inside.alias("_x")).agg(F.count("*").alias("count"), F.max("_h.s.n").alias("_n"))
    ranked = counts.withColumn("_c", F.sum("count").over(Window.partitionBy("_g", "_i").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_at", F.element_at(F.array(*[F.lit(float(q)) for _, q in quantiles.values()]), F.col("_i") + 1) * (F.col("_n") - 1)).withColumn("_k", F.floor("_at"))
    holds = lambda k: (F.col("_c") > k) & (F.col("_c") - F.col("count") <= k)
    after = F.least(F.col("_k") + 1, F.col("_n") - 1)
    ends = ranked.groupBy("_g", "_i").agg(F.max(F.when(holds(F.col("_k")), F.col("_x"))).alias("_a"), F.max(F.when(holds(after), F.col("_x"))).alias("_b"), F.max(F.col("_at") - F.col("_k")).alias("_f"))
    exact = ends.select("_g", "_i", F.when(F.col("_f") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("_q"))
    wide = exact.groupBy("_g").agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
    kept = [c for c in groups.columns if c != "_g" and not c.startswith(("_n_v", "_e_v"))]
    return groups.select("_g", *kept).join(wide, "_g", "left").select("_g.*", *kept, *names).drop("_")


def exact_percentiles(df: DataFrame, by: list[str], value: str | Column, quantiles: dict[str, float], *, accuracy: int = ACCURACY) -> DataFrame:
    """by, and a column for each of quantiles (name: q) of one value; see summarised. Groups without a value have no row."""
    v = F.col(value) if isinstance(value, str) else value
    return summarised(df.filter(v.isNotNull()), by, [], {n: (value, q) for n, q in quantiles.items()}, accuracy=accuracy)


def with_percentiles(summary: DataFrame, df: DataFrame, by: list[str], value: str | Column, quantiles: dict[str, float]) -> DataFrame:
    """summary (one row for each of df's groups) with exact percentiles of df's groups; null in groups without a value."""
    q = exact_percentiles(df, by, value, quantiles)
    if not by:
        return summary.join(q, F.lit(True), "left")  # one row each
    same = [summary[c].eqNullSafe(q[c]) for c in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return summary.join(q, on, "left").select(*[summary[c] for c in summary.columns], *[q[n] for n in quantiles])
