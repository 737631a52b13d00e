"""Many contract checks of one table at once: each says what it measures and where, and all that measure alike share a scan.

Three scans, however many checks: one gives sums, least and largest values for the finest groups any check names, from
which every coarser scope (all, split, component, anatomy, beat) is put together; one goes through beats in order; one
compares frames with their anatomy's first. The last two are made only if a check asks for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.functions.arrays import all_finite, close, minus, plus
from beatframe.functions.tables import stored
from beatframe.operators.checks import EPS32

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Check:
    """result(m) -> (observed, expected, passed), where m(name) is a measure at the check's scope `by` (None: the table).

    rows: measures by name, (how they merge, expression over a row). distinct: numbers of distinct values by name,
    (columns that are to be told apart in the finest groups, aggregate over them). crossing: (unit, column), for a check of the
    whole table: measure n is how many units have several values of the column. beats: aggregates over the frames of a beat in order, where _step (along
    stored positions) and _lead (along samples) are the distances of neighbours and _new says that a sample differs from the one
    before. first: (column, order, bad): whether a row is bad, given _first, the column in the scope's first row; the measure is bad.
    """

    name: str
    by: str | None
    result: Callable
    rows: dict[str, tuple[str, Column]] = field(default_factory=dict)
    distinct: dict[str, tuple[list[str], Column]] = field(default_factory=dict)
    crossing: tuple[str, str] | None = None
    beats: dict[str, Column] = field(default_factory=dict)
    first: tuple[str, str, Column] | None = None
    scope: str | None = None


def number(m, name: str) -> Column:
    return F.coalesce(m(name), F.lit(0))


def none_bad(name: str, bad: Column, by: str | None = None) -> Check:
    """No row of the scope is bad; unknown is bad."""
    return Check(name, by, lambda m: (number(m, "bad"), 0, number(m, "bad") == 0), {"bad": ("sum", F.coalesce(bad, F.lit(True)).cast("long"))})


def columns_present(df: DataFrame, required: Iterable[str]) -> list[Check]:
    """VA1: the table has the column, and a value in it."""
    held = {c: F.col(c).isNotNull().cast("long") if c in df.columns else F.lit(0).cast("long") for c in required}
    return [Check("column_present", None, lambda m: ((number(m, "n") > 0).cast("double"), 1, number(m, "n") > 0), {"n": ("sum", e)}, scope=c) for c, e in held.items()]


def row_count(multiple: int, by: str | None = None) -> Check:
    """VA2."""
    return Check("row_count_multiple", by, lambda m: (number(m, "n"), multiple, (number(m, "n") > 0) & (number(m, "n") % multiple == 0)), {"n": ("sum", F.lit(1).cast("long"))})


def width(vector: str, n: int) -> Check:
    """VA3."""
    return none_bad("width", F.size(vector) != n)


def constant(vector: str, value: float) -> Check:
    """VA4."""
    return none_bad("constant", F.exists(vector, lambda x: ~close(x, F.lit(value))))


def finite_values(vector: str) -> Check:
    """VA5."""
    return none_bad("finite", ~all_finite(vector))


def signs(vector: str, *, by: str, positive: str) -> Check:
    """VA6."""
    ok = lambda m: F.when(F.col(by) == positive, m("lo") > 0).otherwise((m("lo") < 0) & (m("hi") > 0))
    return Check("signs", by, lambda m: (m("lo"), 0, ok(m)), {"lo": ("min", F.array_min(vector)), "hi": ("max", F.array_max(vector))})


def anatomy_complete(*, frames: int = 250, beats: int = 5, anatomy: str = "anatomy_id", beat: str = "beat_id") -> Check:
    """VA7."""
    return Check("anatomy_complete", anatomy, lambda m: (m("n"), frames, (m("n") == frames) & (m("b") == beats)), {"n": ("sum", F.lit(1).cast("long"))}, {"b": ([beat], F.countDistinct(beat))})


def beat_complete(*, fpb: int = 50, beat: str = "beat_id", sample: str = "sample_index") -> Check:
    """VA8."""
    ok = lambda m: (m("n") == fpb) & (m("d") == fpb) & (m("lo") == 0) & (m("hi") == fpb - 1)
    return Check("beat_complete", beat, lambda m: (m("n"), fpb, ok(m)), beats={"n": F.count("*"), "d": F.sum("_new"), "lo": F.min(sample), "hi": F.max(sample)})


def stored_in_order(*, beat: str = "beat_id") -> Check:
    """VA9."""
    return Check("stored_in_order", beat, lambda m: (m("bad"), 0, m("bad") == 0), beats={"bad": F.sum(F.coalesce(F.col("_step") != 1, F.lit(False)).cast("long"))})


def first_frame_zero(column: str, *, order: str, atol: float = 2e-7, anatomy: str = "anatomy_id") -> Check:
    """VA10."""
    x = lambda m: m("first")["x"]
    return Check("first_frame_zero", anatomy, lambda m: (x(m), 0, F.abs(x(m)) <= atol), {"first": ("min", F.when(F.col(order).isNotNull(), F.struct(F.col(order).alias("order"), F.col(column).alias("x"))))})


def constant_within(vector: str, *, by: str, order: str) -> Check:
    """VA11."""
    bad = F.exists(F.zip_with(vector, "_first", lambda x, y: ~close(x, y)), lambda b: b)
    return Check("constant_within", by, lambda m: (m("bad"), 0, m("bad") == 0), first=(vector, order, bad))


def additive_identity(reference: str, delta: str, absolute: str) -> Check:
    """VA12."""
    limit = lambda m: F.greatest(F.lit(2e-8), 4 * EPS32 * F.greatest(m("m"), F.lit(1.0)))
    error = F.array_max(F.transform(minus(plus(reference, delta), absolute), F.abs))
    return Check("additive_identity", None, lambda m: (m("e"), limit(m), m("e") <= limit(m)), {"e": ("max", error), "m": ("max", F.array_max(F.transform(absolute, F.abs)))})


def split_leakage(unit: str, split: str) -> Check:
    """VA15."""
    return Check("split_leakage", None, lambda m: (m("n"), 0, m("n") == 0), crossing=(unit, split))


def split_cardinality(unit: str, split: str, expected: dict[str, int]) -> Check:
    """VA16."""
    want = F.try_element_at(F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))]), F.col(split))
    return Check("split_cardinality", split, lambda m: (m("n"), want, m("n") == want), distinct={"n": ([unit], F.countDistinct(unit))})


def only_values(column: str, allowed: set[str]) -> Check:
    """VA17: as many values as are allowed, and none of them another."""
    other = F.coalesce(~F.col(column).isin(sorted(allowed)), F.lit(False)).cast("long")
    ok = lambda m: (m("values") == len(allowed)) & (number(m, "other") == 0)
    return Check("only_values", None, lambda m: (m("values"), len(allowed), ok(m)), {"other": ("sum", other)}, {"values": ([column], F.countDistinct(column))})


def columns_equal(a: str, b: str) -> Check:
    """VA19."""
    return none_bad("columns_equal", ~F.col(a).eqNullSafe(F.col(b)))


def gate_flags(flags: list[str], by: str) -> Check:
    """VA21."""
    ok = F.lit(True)
    for f in flags:
        ok = ok & F.coalesce(F.col(f), F.lit(False))
    return none_bad("gate_flags", ~ok, by)


def contiguous(*, beat: str = "beat_id", anatomy: str = "anatomy_id") -> Check:
    """VA22."""
    ok = lambda m: (m("u") == 1) & F.coalesce((m("hi") == 1) & (m("lo") == 1), F.lit(True))
    return Check("contiguous", beat, lambda m: (m("u"), 1, ok(m)), distinct={"u": ([anatomy, beat], F.countDistinct(anatomy, beat))}, beats={"hi": F.max("_lead"), "lo": F.min("_lead")})


def one_value_per(by: str, columns: list[str], name: str = "one_value_per") -> Check:
    """VA25, VA26."""
    return Check(name, by, lambda m: (m("n"), 1, m("n") == 1), distinct={"n": (columns, F.countDistinct(F.struct(*columns)))})


def conditional_column(column: str, like: str, *, split: str, where: str) -> Check:
    """VA27."""
    bad = F.when(F.col(split) == where, F.col(column).isNull() | (F.size(column) != F.size(like))).otherwise(F.col(column).isNotNull())
    return none_bad("conditional_column", bad, split)


def finest(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row for each combination of what the checks tell apart, with every measure of every check, merged: m0_bad is measure bad of check 0. The only scan of whole rows; they are combined before they are shuffled."""
    keys = list(dict.fromkeys(k for c in checks for k in [*([c.by] if c.by else []), *(x for columns, _ in c.distinct.values() for x in columns), *(c.crossing or ())]))
    measures = {f"m{i}_{n}": m for i, c in enumerate(checks) for n, m in c.rows.items()}
    firsts = {f"m{i}_first": F.struct(F.col(c.first[1]).alias("order"), F.col(c.first[0]).alias("x")) for i, c in enumerate(checks) if c.first}
    d = df.select(*keys, *[e.alias(n) for n, (_, e) in measures.items()], *[e.alias(n) for n, e in firsts.items()])
    merged = [MERGE[how](n).alias(n) for n, (how, _) in measures.items()] + [F.min_by(n, F.col(n)["order"]).alias(n) for n in firsts]
    return d.groupBy(*keys).agg(F.count("*").alias("_n"), *merged)


def merged(parts: DataFrame, checks: dict[int, Check], by: str | None) -> DataFrame:
    """The measures of one scope from those of the finest groups."""
    out = [F.sum("_n").alias("_n")]
    for i, c in checks.items():
        out += [MERGE[how](f"m{i}_{n}").alias(f"m{i}_{n}") for n, (how, _) in c.rows.items()]
        out += [e.alias(f"m{i}_{n}") for n, (_, e) in c.distinct.items()]
        if c.first:
            out.append(F.min_by(f"m{i}_first", F.col(f"m{i}_first")["order"]).alias(f"m{i}_first"))
    grouped = parts.groupBy(*([by] if by else [])).agg(*out)
    for i, c in checks.items():
        if c.crossing:
            several = parts.groupBy(c.crossing[0]).agg(F.countDistinct(c.crossing[1]).alias("_d"))
            grouped = grouped.join(several.agg(F.count_if(F.col("_d") > 1).alias(f"m{i}_n")), F.lit(True))  # one row each
    return grouped


def in_order(df: DataFrame, checks: dict[int, Check], beat: str, position: str, sample: str) -> DataFrame:
    """The measures that need a beat's frames side by side; narrow rows, one shuffle by beat for both orders."""
    narrow = df.select(beat, F.col(position).alias("_position"), sample)
    along, by_sample = Window.partitionBy(beat).orderBy("_position"), Window.partitionBy(beat).orderBy(sample)
    d = narrow.withColumn("_step", F.col(sample) - F.lag(sample).over(along)).withColumn("_lead", F.lead(sample).over(by_sample) - F.col(sample))
    d = d.withColumn("_new", (F.col(sample).isNotNull() & ~F.col(sample).eqNullSafe(F.lag(sample).over(by_sample))).cast("long"))
    return d.groupBy(beat).agg(*[e.alias(f"m{i}_{n}") for i, c in checks.items() for n, e in c.beats.items()])


def unlike_first(df: DataFrame, firsts: DataFrame, checks: dict[int, Check], by: str) -> DataFrame:
    """Bad rows of each group, compared with the group's first."""
    known = firsts.select(F.col(by).alias("_by"), *[f"m{i}_first" for i in checks])
    d = df.join(known, df[by].eqNullSafe(known["_by"]))
    bad = []
    for i, c in checks.items():
        d = d.withColumn("_first", F.col(f"m{i}_first")["x"]).withColumn(f"m{i}_bad", F.coalesce(c.first[2], F.lit(True)).cast("long"))
        bad.append(F.sum(f"m{i}_bad").alias(f"m{i}_bad"))
    return d.groupBy(by).agg(*bad)


def rows_of(grouped: DataFrame, checks: dict[int, Check], by: str | None) -> DataFrame:
    """Tidy rows of all checks of one scope, from one row for each of its groups."""
    out = []
    for i, c in checks.items():
        observed, expected, passed = c.result(lambda n, i=i: F.col(f"m{i}_{n}"))
        expected = expected if isinstance(expected, Column) else F.lit(float(expected))
        scope = F.lit(c.scope or "all") if by is None else F.col(by)
        out.append(F.struct(F.lit(c.name).alias("check"), scope.cast("string").alias("scope"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"), F.coalesce(passed, F.lit(False)).alias("passed")))
    return grouped.select(F.explode(F.array(*out)).alias("_r")).select("_r.*")


def validate(df: DataFrame, checks: Iterable[Check | list[Check]], *, beat: str = "beat_id", position: str = "frame_no", sample: str = "sample_index") -> DataFrame:
    """check, scope, observed, expected, passed of all checks (VA1 to VA12, VA15 to VA17, VA19, VA21, VA22, VA25 to VA27) of one table: the rows that each would give alone.

    Scopes with a null are scopes of their own. An empty table has rows for checks of the whole table alone. The
    finest groups are written once (functions.tables.stored), as all scopes read them.
    """
    flat = dict(enumerate([c for some in checks for c in (some if isinstance(some, list) else [some])]))
    parts = stored(finest(df, list(flat.values())))
    out = None
    for by in dict.fromkeys(c.by for c in flat.values()):
        mine = {i: c for i, c in flat.items() if c.by == by}
        grouped = merged(parts, mine, by)
        ordered, compared = ({i: c for i, c in mine.items() if c.beats}, {i: c for i, c in mine.items() if c.first})
        for more in (in_order(df, ordered, beat, position, sample) if ordered else None, unlike_first(df, grouped, compared, by) if compared else None):
            if more is not None:
                more = more.withColumnRenamed(by, "_by")
                grouped = grouped.join(more, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
        rows = rows_of(grouped, mine, by)
        out = rows if out is None else out.unionByName(rows)
    return out
