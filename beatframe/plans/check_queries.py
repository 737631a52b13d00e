"""Queries of contract checks and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatframe.functions import arrays as A
from beatframe.operators import checks as C
from beatframe.operators import joins as J
from beatframe.operators import signals as G
from beatframe.operators import validation as K
from beatframe.plans.bindings import FPB, FRAMES, PAIRS, VECTORS, WINDOW
from beatframe.plans.frame_queries import BY, LP, r6
from beatframe.plans.registry import query



def check_sql(check, body, observed, expected, passed, scope="'all'", with_=""):
    return f"{with_} SELECT '{check}' AS \"check\", CAST({scope} AS VARCHAR) AS scope, CAST({observed} AS DOUBLE) AS observed, CAST({expected} AS DOUBLE) AS expected, {passed} AS passed FROM {body}"


def bad_sql(check, bad, source, with_="", by=None):
    group = f" GROUP BY {by}" if by else ""
    scope = by or "'all'"
    return check_sql(check, f"(SELECT {scope} AS s, coalesce(sum(CAST(({bad}) AS INTEGER)), 0) AS n FROM {source}{group})", "n", 0, "n = 0", "s", with_)


PRESENT = "SELECT 'column_present' AS \"check\", scope, CAST(n > 0 AS DOUBLE) AS observed, 1.0::DOUBLE AS expected, n > 0 AS passed FROM ({})"


@query("va1_columns_present", PRESENT.format("SELECT 'event_id' AS scope, count(event_id) AS n FROM events UNION ALL SELECT 'value', count(value) FROM events UNION ALL SELECT 'over_a_million', count(CASE WHEN value > 1e6 THEN value END) FROM events UNION ALL SELECT 'sigma', 0 FROM range(1)"))
def _(t):
    return C.columns_present(t("events").withColumn("over_a_million", F.when(F.col("value") > 1e6, F.col("value"))), ["event_id", "value", "over_a_million", "sigma"])


@query("va2_row_count", check_sql("row_count_multiple", "(SELECT anatomy_id, count(*) AS n FROM frames GROUP BY 1)", "n", 10, "n > 0 AND n % 10 = 0", "anatomy_id", f"WITH {FRAMES}"))
def _(t):
    return C.row_count(t.frames(), 10, "anatomy_id")


@query("va3_width", bad_sql("width", "len(v) <> 64", "vectors", f"WITH {VECTORS}"))
def _(t):
    return C.width(t.vectors(), "v", 64)


@query("va4_constant", bad_sql("constant", "len(list_filter(v, lambda x: NOT abs(x - 0.7) <= 1e-8 + 1e-5 * 0.7)) > 0", "vectors", f"WITH {VECTORS}"))
def _(t):
    return C.constant(t.vectors(), "v", 0.7)


@query("va5_finite", bad_sql("finite", "len(list_filter(v, lambda x: NOT isfinite(x))) > 0", "vectors", f"WITH {VECTORS}"))
def _(t):
    return C.finite_values(t.vectors(), "v")


@query("va6_signs", check_sql("signs", "(SELECT c, min(list_min(v)) AS lo, max(list_max(v)) AS hi FROM (SELECT v, CASE WHEN key % 2 = 0 THEN 'full' ELSE 'hp' END AS c FROM vectors) GROUP BY c)", "lo", 0, "CASE WHEN c = 'full' THEN lo > 0 ELSE lo < 0 AND hi > 0 END", "c", f"WITH {VECTORS}"))
def _(t):
    d = t.vectors().withColumn("component", F.when(F.col("key") % 2 == 0, "full").otherwise("hp"))
    return C.signs(d, "v", by="component", positive="full")


@query("va7_anatomy_complete", check_sql("anatomy_complete", "(SELECT anatomy_id, count(*) AS n, count(DISTINCT beat_id) AS b FROM frames GROUP BY 1)", "n", 60, "n = 60 AND b = 6", "anatomy_id", f"WITH {FRAMES}"))
def _(t):
    return C.anatomy_complete(t.frames(), frames=60, beats=6)


@query("va8_beat_complete", check_sql("beat_complete", "(SELECT beat_id, count(*) AS n, count(DISTINCT sample_index) AS d, min(sample_index) AS lo, max(sample_index) AS hi FROM frames GROUP BY 1)", "n", FPB, f"n = {FPB} AND d = {FPB} AND lo = 0 AND hi = {FPB - 1}", "beat_id", f"WITH {FRAMES}"))
def _(t):
    return C.beat_complete(t.frames(), fpb=FPB)


@query("va9_stored_in_order", bad_sql("stored_in_order", "coalesce(step <> 1, false)", "s", f"WITH {FRAMES}, s AS (SELECT *, sample_index - lag(sample_index) OVER (PARTITION BY beat_id ORDER BY x, frame_no) AS step FROM frames)", "beat_id"))
def _(t):
    return C.stored_in_order(t.frames().withColumn("position", F.struct("x", "frame_no")), position="position")


@query("va10_first_frame_zero", check_sql("first_frame_zero", "(SELECT anatomy_id, round(arg_min(lp, frame_no), 6) AS x FROM lp GROUP BY 1)", "x", 0, "abs(x) <= 2e-7", "anatomy_id", f"WITH {FRAMES}, {LP}"))
def _(t):
    d = G.hp_lp(t.frames(), by=BY, order="frame_no", window=WINDOW).withColumn("lp", r6("lp"))
    return C.first_frame_zero(d, "lp", order="frame_no")


@query("va10_reference_present", check_sql("reference_present", "(SELECT anatomy_id, sum(CAST(frame_no = 5 AS INTEGER)) AS n FROM frames GROUP BY 1)", "n", 1, "n = 1", "anatomy_id", f"WITH {FRAMES}"))
def _(t):
    return C.reference_present(t.frames(), by="anatomy_id", order="frame_no", k=5)


@query("va11_constant_within", bad_sql("constant_within", "len(list_filter(range(1, 65), lambda i: NOT abs(v[i] - f[i]) <= 1e-8 + 1e-5 * abs(f[i]))) > 0", "w", f"WITH {VECTORS}, w AS (SELECT anatomy_id, v, first_value(v) OVER (PARTITION BY anatomy_id ORDER BY frame_no) AS f FROM vectors)", "anatomy_id"))
def _(t):
    return C.constant_within(t.vectors(), "v", by="anatomy_id", order="frame_no")


@query("va12_additive_identity", check_sql("additive_identity", "(SELECT round(max(abs(t + (p - t) - p)), 12) AS e, max(abs(p)) AS m FROM el)", "e", "round(greatest(2e-8, 4 * 1.1920928955078125e-07 * greatest(m, 1.0)), 12)", "e <= greatest(2e-8, 4 * 1.1920928955078125e-07 * greatest(m, 1.0))", with_=f"WITH {PAIRS}"))
def _(t):
    d = t.pairs().withColumn("delta", A.minus("pred", "truth"))
    return C.additive_identity(d, "truth", "delta", "pred").withColumn("observed", F.round("observed", 12)).withColumn("expected", F.round("expected", 12))


def moved(key, n, far=1_000_000_000):
    """The key, moved far away on every n-th row, so that it has no partner there."""
    return F.col(key) + F.when(F.col(key) % n == 0, far).otherwise(0)


@query("va13_same_keys", bad_sql("same_keys", "a IS NULL OR b IS NULL", "j", "WITH j AS (SELECT a.o_orderkey AS a, b.l_orderkey AS b FROM (SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000000000 ELSE 0 END AS o_orderkey FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) b ON a.o_orderkey = b.l_orderkey)"))
def _(t):
    a = t("orders").select(moved("o_orderkey", 3).alias("k"))
    return C.same_keys(a, t("lineitem").select(F.col("l_orderkey").alias("k")).distinct(), ["k"])


@query("va14_component_sum", check_sql("component_sum", "(SELECT round(max(abs((x - lp) + lp - x)), 6) AS e FROM lp)", "e", 1e-9, "e <= 1e-9", with_=f"WITH {FRAMES}, {LP}"))
def _(t):
    d = G.hp_lp(t.frames(), by=BY, order="frame_no", window=WINDOW)
    part = lambda c: d.select("anatomy_id", "frame_no", F.col(c).alias("value"))
    return C.component_sum(part("x"), part("hp"), part("lp"), ["anatomy_id", "frame_no"], "value", atol=1e-9).withColumn("observed", r6("observed"))


@query("va15_split_leakage", bad_sql("split_leakage", "n > 1", "g", "WITH g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1)"))
def _(t):
    return C.split_leakage(t("orders"), "o_custkey", "o_orderstatus")


@query("va16_split_cardinality", check_sql("split_cardinality", "(SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)", "n", "CASE s WHEN 'F' THEN 160 WHEN 'O' THEN 20 ELSE 20 END", "n = CASE s WHEN 'F' THEN 160 WHEN 'O' THEN 20 ELSE 20 END", "s"))
def _(t):
    return C.split_cardinality(t("orders"), "o_custkey", "o_orderstatus", {"F": 160, "O": 20, "P": 20})


@query("va17_only_values", check_sql("only_values", "(SELECT count(DISTINCT event_type) AS n, list_sort(list(DISTINCT event_type)) AS s FROM events)", "n", 2, "s = ['click', 'view']"))
def _(t):
    return C.only_values(t("events"), "event_type", {"click", "view"})


@query("va18_side_records", bad_sql("side_records", "c_custkey IS NULL OR c_name IS NULL", "(SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN (SELECT c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1000000000 ELSE 0 END AS c_custkey, c_name FROM customer) c ON o_custkey = c_custkey"))
def _(t):
    side = t("customer").withColumn("k", moved("c_custkey", 7))
    return C.side_records(t("orders").withColumnRenamed("o_custkey", "k"), side, "k", ["c_name"])


@query("va19_columns_equal", bad_sql("columns_equal", "l_linenumber IS DISTINCT FROM CAST(l_quantity AS BIGINT)", "lineitem"))
def _(t):
    return C.columns_equal(t("lineitem").withColumn("q", F.col("l_quantity").cast("long")).withColumn("n", F.col("l_linenumber").cast("long")), "n", "q")


@query("va20_augmented_pack", check_sql("augmented_pack", "(SELECT count(*) AS n, bool_and(a.label = b.label) AND bool_or(list_transform(b.embedding, lambda x: x * 2) <> a.embedding) AS ok FROM embeddings a FULL JOIN embeddings b USING (vec_id))", "n", "n", "ok"))
def _(t):
    d = t.vectors()
    return C.augmented_pack(d.withColumn("y", F.col("anatomy_id")), d.withColumn("y", F.col("anatomy_id")).withColumn("v", A.scaled("v", 2.0)), ["key"], "y", "v")


@query("va21_gate_flags", bad_sql("gate_flags", "NOT (l_discount <= 0.1 AND l_tax <= 0.05)", "lineitem", by="l_returnflag"))
def _(t):
    d = t("lineitem").withColumn("a", F.col("l_discount") <= 0.1).withColumn("b", F.col("l_tax") <= 0.05)
    return C.gate_flags(d, ["a", "b"], "l_returnflag")


@query("va22_contiguous", check_sql("contiguous", "(SELECT beat_id, count(DISTINCT (anatomy_id, beat_id)) AS u, max(st) AS hi, min(st) AS lo FROM s GROUP BY 1)", "u", 1, "u = 1 AND coalesce(hi = 1 AND lo = 1, true)", "beat_id", f"WITH {FRAMES}, s AS (SELECT *, lead(i) OVER (PARTITION BY beat_id ORDER BY i) - i AS st FROM (SELECT *, sample_index + CASE WHEN x > 3 THEN 0 ELSE 100 END AS i FROM frames))"))
def _(t):
    d = t.frames().withColumn("sample_index", F.col("sample_index") + F.when(F.col("x") > 3, 0).otherwise(100))
    return C.contiguous(d, by="beat_id", order="sample_index")


COO = "coo AS (SELECT l_orderkey % 64 AS row, l_partkey % 64 AS col, round(sum(CAST(l_discount AS DOUBLE)), 6) AS value FROM lineitem GROUP BY 1, 2)"


def coo(t):
    d = t("lineitem").groupBy((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"))
    return d.agg(r6(F.sum(F.col("l_discount").cast("double"))).alias("value"))


@query("va23_unit_row_sums", bad_sql("unit_row_sums", "abs(s - 1) > 1e-12", "g", f"WITH {COO}, g AS (SELECT row, sum(value) AS s FROM coo GROUP BY 1)"))
def _(t):
    return C.unit_row_sums(coo(t))


@query("va24_identical_arrays", bad_sql("identical_arrays", "a IS DISTINCT FROM b", "j", "WITH j AS (SELECT x.embedding AS a, y.embedding AS b FROM embeddings x FULL JOIN (SELECT vec_id, CASE WHEN label < 5 THEN embedding ELSE list_transform(embedding, lambda v: v * 2) END AS embedding FROM embeddings) y ON x.vec_id = y.vec_id)"))
def _(t):
    b = t("embeddings").withColumn("embedding", F.when(F.col("label") < 5, F.col("embedding")).otherwise(F.transform("embedding", lambda v: (v * 2).cast("float"))))
    return C.identical_arrays(t("embeddings"), b, ["vec_id"], "embedding")


@query("va25_one_value_per", check_sql("same_hash", "(SELECT o_orderpriority AS s, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1)", "n", 1, "n = 1", "s"))
def _(t):
    return C.one_value_per(t("orders"), "o_orderpriority", ["o_orderstatus"], "same_hash")


@query("va26_cross_export", check_sql("cross_export", "(SELECT l_linenumber AS s, count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem GROUP BY 1)", "n", 1, "n = 1", "s"))
def _(t):
    return C.one_value_per(t("lineitem"), "l_linenumber", ["l_returnflag", "l_linestatus"], "cross_export")


@query("va27_conditional_column", bad_sql("conditional_column", "CASE WHEN s = 'test' THEN c IS NULL OR len(c) <> len(v) ELSE c IS NOT NULL END", "d", f"WITH {VECTORS}, d AS (SELECT v, CASE WHEN anatomy_id < 3 THEN 'test' ELSE 'train' END AS s, CASE WHEN anatomy_id < 4 THEN v END AS c FROM vectors)", "s"))
def _(t):
    d = t.vectors().withColumn("split", F.when(F.col("anatomy_id") < 3, "test").otherwise("train")).withColumn("newton", F.when(F.col("anatomy_id") < 4, F.col("v")))
    return C.conditional_column(d, "newton", "v", split="split", where="test")


@query("va28_corpus_summary", f"WITH {VECTORS}, b AS (SELECT *, anatomy_id * 1000 + frame_no // 10 AS beat_id, CASE WHEN anatomy_id < 7 THEN 'train' ELSE 'test' END AS split FROM vectors), g AS (SELECT split, beat_id, anatomy_id, unnest(v) AS x FROM b), a AS (SELECT split, round(sqrt(avg(x * x)), 6) AS target_rms, round(avg(CAST(x < 0 AS INTEGER)), 6) AS negative_fraction FROM g GROUP BY 1) SELECT split, count(*) AS frames, count(DISTINCT anatomy_id) AS anatomies, count(DISTINCT beat_id) AS beats, any_value(target_rms) AS target_rms, any_value(negative_fraction) AS negative_fraction, any_value(target_rms) AS signal_rms FROM b JOIN a USING (split) GROUP BY split")
def _(t):
    d = t.vectors().withColumn("beat_id", F.col("anatomy_id") * 1000 + F.floor(F.col("frame_no") / 10)).withColumn("split", F.when(F.col("anatomy_id") < 7, "train").otherwise("test"))
    s = C.corpus_summary(d, "v", "v", ["split"])
    return s.select("split", "frames", "anatomies", "beats", *[r6(c).alias(c) for c in ("target_rms", "negative_fraction", "signal_rms")])


@query("va29_roll_up", f"WITH {FRAMES}, c AS (SELECT beat_id, count(*) = {FPB} AS ok FROM frames GROUP BY 1) SELECT bool_and(ok) AS passed, count(*) AS n_checks, sha256(array_to_string(list_sort(list('beat_complete ' || beat_id) FILTER (WHERE NOT ok)), ',')) AS failures FROM c")
def _(t):
    return C.roll_up(C.beat_complete(t.frames(), fpb=FPB)).withColumn("failures", F.sha2(F.array_join("failures", ","), 256))


# -- all checks of one corpus

CORPUS = f"""{VECTORS}, b AS (SELECT *, anatomy_id * 1000 + frame_no // {FPB} AS beat_id, frame_no % {FPB} AS sample_index, CASE WHEN anatomy_id < 7 THEN 'train' WHEN anatomy_id = 7 AND frame_no % 40 = 3 THEN 'train' ELSE 'test' END AS split, CASE WHEN key % 2 = 0 THEN 'full' ELSE 'hp' END AS component, list_transform(v, lambda x: x - 0.1) AS delta, [0.1] AS offs, CASE WHEN anatomy_id <> 3 THEN v END AS newton, v[1] > -0.3 AS gate FROM vectors),
so AS (SELECT *, sample_index - lag(sample_index) OVER (PARTITION BY beat_id ORDER BY v[1], frame_no) AS step, lead(sample_index) OVER (PARTITION BY beat_id ORDER BY sample_index) - sample_index AS nxt, first_value(v) OVER (PARTITION BY anatomy_id ORDER BY frame_no) AS f FROM b)"""

CORPUS_CHECKS = [
    *[PRESENT.format(f"SELECT '{c}' AS scope, {n} AS n FROM b") for c, n in (("v", "count(v)"), ("newton", "count(newton)"), ("sigma", "0 * count(*)"))],
    check_sql("row_count_multiple", "(SELECT split, count(*) AS n FROM b GROUP BY 1)", "n", 10, "n > 0 AND n % 10 = 0", "split"),
    bad_sql("width", "len(v) <> 64", "b"),
    bad_sql("constant", "len(list_filter(v, lambda x: NOT abs(x - 0.7) <= 1e-8 + 1e-5 * 0.7)) > 0", "b"),
    bad_sql("finite", "len(list_filter(v, lambda x: NOT isfinite(x))) > 0", "b"),
    check_sql("signs", "(SELECT component, min(list_min(v)) AS lo, max(list_max(v)) AS hi FROM b GROUP BY 1)", "lo", 0, "CASE WHEN component = 'full' THEN lo > 0 ELSE lo < 0 AND hi > 0 END", "component"),
    check_sql("anatomy_complete", "(SELECT anatomy_id, count(*) AS n, count(DISTINCT beat_id) AS d FROM b GROUP BY 1)", "n", 50, "n = 50 AND d = 5", "anatomy_id"),
    check_sql("beat_complete", "(SELECT beat_id, count(*) AS n, count(DISTINCT sample_index) AS d, min(sample_index) AS lo, max(sample_index) AS hi FROM b GROUP BY 1)", "n", FPB, f"n = {FPB} AND d = {FPB} AND lo = 0 AND hi = {FPB - 1}", "beat_id"),
    bad_sql("stored_in_order", "coalesce(step <> 1, false)", "so", by="beat_id"),
    check_sql("first_frame_zero", "(SELECT anatomy_id, round(arg_min(v[2], frame_no), 6) AS x FROM b GROUP BY 1)", "x", 0, "abs(x) <= 2e-7", "anatomy_id"),
    bad_sql("constant_within", "len(list_filter(range(1, 65), lambda i: NOT abs(v[i] - f[i]) <= 1e-8 + 1e-5 * abs(f[i]))) > 0", "so", by="anatomy_id"),
    check_sql("additive_identity", "(SELECT round(max(list_max(list_transform(v, lambda x, i: abs((0.1 + delta[i]) - x)))), 12) AS e, max(list_max(list_transform(v, lambda x: abs(x)))) AS m FROM b)", "e", "round(greatest(2e-8, 4 * 1.1920928955078125e-07 * greatest(m, 1.0)), 12)", "e <= greatest(2e-8, 4 * 1.1920928955078125e-07 * greatest(m, 1.0))"),
    bad_sql("split_leakage", "n > 1", "(SELECT anatomy_id, count(DISTINCT split) AS n FROM b GROUP BY 1)"),
    check_sql("split_cardinality", "(SELECT split, count(DISTINCT anatomy_id) AS n FROM b GROUP BY 1)", "n", "CASE split WHEN 'train' THEN 8 ELSE 2 END", "n = CASE split WHEN 'train' THEN 8 ELSE 2 END", "split"),
    check_sql("only_values", "(SELECT count(DISTINCT component) AS n, list_sort(list(DISTINCT component)) AS s FROM b)", "n", 2, "s = ['full', 'hp']"),
    bad_sql("columns_equal", "sample_index IS DISTINCT FROM frame_no", "b"),
    bad_sql("gate_flags", "NOT coalesce(gate, false)", "b", by="split"),
    check_sql("contiguous", "(SELECT beat_id, count(DISTINCT (anatomy_id, beat_id)) AS u, max(nxt) AS hi, min(nxt) AS lo FROM so GROUP BY 1)", "u", 1, "u = 1 AND coalesce(hi = 1 AND lo = 1, true)", "beat_id"),
    check_sql("same_split", "(SELECT anatomy_id, count(DISTINCT {'s': split}) AS n FROM b GROUP BY 1)", "n", 1, "n = 1", "anatomy_id"),
    bad_sql("conditional_column", "CASE WHEN split = 'test' THEN newton IS NULL OR len(newton) <> len(v) ELSE newton IS NOT NULL END", "b", by="split"),
]


def corpus(t):
    d = t.vectors().withColumn("beat_id", F.col("anatomy_id") * 1000 + F.floor(F.col("frame_no") / FPB)).withColumn("sample_index", F.col("frame_no") % FPB)
    d = d.withColumn("split", F.when((F.col("anatomy_id") < 7) | ((F.col("anatomy_id") == 7) & (F.col("frame_no") % 40 == 3)), "train").otherwise("test")).withColumn("component", F.when(F.col("key") % 2 == 0, "full").otherwise("hp"))
    d = d.withColumn("reference", F.transform("v", lambda x: F.lit(0.1))).withColumn("delta", F.transform("v", lambda x: x - 0.1)).withColumn("newton", F.when(F.col("anatomy_id") != 3, F.col("v")))
    return d.withColumn("gate", F.col("v")[0] > -0.3).withColumn("second", r6(F.col("v")[1])).withColumn("position", F.struct(F.col("v")[0], F.col("frame_no")))


def corpus_checks(d):
    return [
        K.columns_present(d, ["v", "newton", "sigma"]), K.row_count(10, "split"), K.width("v", 64), K.constant("v", 0.7), K.finite_values("v"), K.signs("v", by="component", positive="full"), K.anatomy_complete(frames=50, beats=5),
        K.beat_complete(fpb=FPB), K.stored_in_order(), K.first_frame_zero("second", order="frame_no"), K.constant_within("v", by="anatomy_id", order="frame_no"), K.additive_identity("reference", "delta", "v"), K.split_leakage("anatomy_id", "split"),
        K.split_cardinality("anatomy_id", "split", {"train": 8, "test": 2}), K.only_values("component", {"full", "hp"}), K.columns_equal("sample_index", "frame_no"), K.gate_flags(["gate"], "split"), K.contiguous(), K.one_value_per("anatomy_id", ["split"], "same_split"),
        K.conditional_column("newton", "v", split="split", where="test"),
    ]


@query("va_fused_validation", f"WITH {CORPUS} " + " UNION ALL ".join(CORPUS_CHECKS))
def _(t):
    d = corpus(t)
    v = K.validate(d, corpus_checks(d), position="position")
    return v.withColumn("observed", F.round("observed", 12)).withColumn("expected", F.round("expected", 12))


# -- joins


@query("jn1_add_components", f"WITH {PAIRS} SELECT key, round(sum(p + t), 6) AS s FROM el GROUP BY 1")
def _(t):
    p = t.pairs()
    j = J.add_components(p.select("key", F.col("pred").alias("v")), p.select("key", F.col("truth").alias("v")), ["key"], ["v"])
    return j.select("key", r6(A.total("v")).alias("s"))


@query("jn2_registry", "SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN NULL ELSE n_name END AS ring, CASE WHEN n_nationkey IS NULL THEN 'no ring size' WHEN n_regionkey = 2 THEN 'no assets for ring' END AS exclusion_reason, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS source_order FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 1000 ELSE 0 END")
def _(t):
    rings = t("nation").select(moved("n_nationkey", 5, 1000).alias("subject"), F.col("n_name").alias("ring"))
    assets = t("nation").select(F.when(F.col("n_regionkey") == 2, "none").otherwise(F.col("n_name")).alias("ring"))
    d = J.registry(t("customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("subject")), rings, assets, subject="subject", ring="ring")
    return J.source_order(d, "c_mktsegment", ["c_custkey"]).select("c_custkey", "ring", "exclusion_reason", "source_order")


@query("jn3_selection", "SELECT o_orderkey, c_name, o_orderkey * 3 + 3 AS period_sum FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def _(t):
    chosen = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("subject"))
    d = J.selection(chosen, t("customer").select(F.col("c_custkey").alias("subject"), "c_name"), ["subject"], start="o_orderkey", n=3)
    return d.select("o_orderkey", "c_name", F.aggregate("periods", F.lit(0).cast("long"), lambda s, x: s + x).alias("period_sum"))


@query("jn4_paired", "WITH a AS (SELECT o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000000 ELSE 0 END AS o_orderkey, o_orderpriority FROM orders), b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 2000000000 ELSE 0 END AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM orders) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'a_only' WHEN a.o_orderkey IS NULL THEN 'b_only' WHEN a.o_orderpriority <> b.o_orderpriority THEN 'mismatch' ELSE 'match' END AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def _(t):
    o = t("orders")
    b = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderpriority"))).withColumn("o_orderkey", moved("o_orderkey", 4, 2_000_000_000))
    return J.paired(o.withColumn("o_orderkey", moved("o_orderkey", 5)), b, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "status")


@query("jn5_vessel_areas", "SELECT l_orderkey, l_linenumber, round(CASE WHEN p_partkey % 2 = 0 THEN least(pi() * p_size * 2 * 0.25, pi() * (p_size + 1) * 0.5 * 0.64) ELSE least(pi() * p_size * 0.5, pi() * 3.0 * 7) END, 6) AS least_area FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    size = F.col("p_size").cast("double")
    artery = lambda x, y, f: F.struct(x.alias("radius_x_mm"), F.lit(y).alias("radius_y_mm"), F.lit(f).alias("lumen_fraction"))
    vessel = lambda a, b: F.struct(a.alias("axis_a"), F.lit(b).alias("axis_b"))
    model, even = F.struct(F.array(artery(size, 2.0, 0.5), artery(size + 1, 0.5, 0.8)).alias("arteries")), F.col("p_partkey") % 2 == 0
    side = t("part").select(F.col("p_partkey").alias("k"), F.when(even, model).alias("model"), F.when(~even, F.array(vessel(size, 0.5), vessel(F.lit(3.0), 7.0))).alias("vessels"))
    d = J.vessel_areas(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k")), side, "k")
    return d.select("l_orderkey", "l_linenumber", r6("least_area").alias("least_area"))


NEAR = "coalesce(len(list_filter(range(1, 65), lambda i: NOT abs(a.{0}[i] - b.{0}[i]) <= 1e-7)) = 0, false)"


@query("jn6_aligned", f"WITH {VECTORS}, b AS (SELECT key + CASE WHEN key % 7 = 0 THEN 1000000000 ELSE 0 END AS key, v, list_transform(v, lambda x: x * CASE WHEN key % 2 = 0 THEN 1 + 1e-9 ELSE 1.5 END) AS c FROM vectors), a AS (SELECT *, v AS c FROM vectors) SELECT coalesce(a.key, b.key) AS key, a.key IS NOT NULL AND b.key IS NOT NULL AS in_both, a.key IS NOT NULL AND b.key IS NOT NULL AND {NEAR.format('v')} AS same_truth, a.key IS NOT NULL AND b.key IS NOT NULL AND {NEAR.format('c')} AS same_control FROM a FULL JOIN b ON a.key = b.key")
def _(t):
    a = t.vectors().withColumn("c", F.col("v"))
    b = a.withColumn("c", F.when(F.col("key") % 2 == 0, A.scaled("v", 1 + 1e-9)).otherwise(A.scaled("v", 1.5))).withColumn("key", moved("key", 7))
    return J.aligned(a, b, ["key"], "v", "c")


@query("jn7_contract", "WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'other' ELSE md5(p_name) END AS h FROM part) SELECT p.p_partkey, md5(p_name) = h AS same, md5(p_name) = h OR p.p_partkey IN (10, 20) AS passed FROM part p JOIN c USING (p_partkey)")
def _(t):
    s = t("part").select("p_partkey", F.md5("p_name").alias("hash"), F.col("p_retailprice").cast("double").alias("number"))
    c = s.withColumn("hash", F.when(F.col("p_partkey") % 10 == 0, "other").otherwise(F.col("hash")))
    return J.contract(s, c, ["p_partkey"], exempt=[10, 20])


@query("jn8_nearest", "WITH d AS (SELECT q.vec_id AS key, b.vec_id AS bank, list_sum(list_transform(range(1, 65), lambda i: pow(q.embedding[i]::DOUBLE + 0.5 * b.embedding[i]::DOUBLE, 2))) / 64 AS d FROM embeddings q, embeddings b) SELECT key, arg_min(bank, (d, bank)) AS bank, round(min(d), 6) AS distance FROM d GROUP BY 1")
def _(t):
    v = t.vectors()
    bank = v.select(F.col("key").alias("bank"), A.scaled("v", -0.5).alias("v"))
    return J.nearest(v, bank, key="key", vector="v", bank_key="bank", bank_vector="v").withColumn("distance", r6("distance"))


BOXES = "a AS (SELECT p_partkey, (p_partkey * 7 % 101)::DOUBLE AS x0, (p_partkey * 7 % 101 + 1 + p_size % 5)::DOUBLE AS x1, (p_partkey * 13 % 97)::DOUBLE AS y0, (p_partkey * 13 % 97 + 1 + p_size % 3)::DOUBLE AS y1 FROM part), b AS (SELECT s_suppkey, (s_suppkey * 11 % 101)::DOUBLE AS x0, (s_suppkey * 11 % 101 + 4)::DOUBLE AS x1, (s_suppkey * 5 % 97)::DOUBLE AS y0, (s_suppkey * 5 % 97 + 3)::DOUBLE AS y1 FROM supplier)"


def boxes(t):
    box = lambda *c: [F.expr(e).cast("double").alias(n) for n, e in zip(("x0", "x1", "y0", "y1"), c, strict=True)]
    a = t("part").select("p_partkey", *box("p_partkey * 7 % 101", "p_partkey * 7 % 101 + 1 + p_size % 5", "p_partkey * 13 % 97", "p_partkey * 13 % 97 + 1 + p_size % 3"))
    b = t("supplier").select("s_suppkey", *box("s_suppkey * 11 % 101", "s_suppkey * 11 % 101 + 4", "s_suppkey * 5 % 97", "s_suppkey * 5 % 97 + 3"))
    return a, b


@query("jn9_box_overlap", f"WITH {BOXES} SELECT p_partkey, s_suppkey FROM a JOIN b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def _(t):
    return J.box_overlap(*boxes(t), cell=4.0, repeats=True).select("p_partkey", F.col("b_s_suppkey").alias("s_suppkey"))


@query("jn10_inside_ellipse", f"WITH {BOXES} SELECT p_partkey, s_suppkey FROM a JOIN b ON pow(a.x0 - b.x0, 2) / 9 + pow(a.y0 - b.y0, 2) / 4 <= 1")
def _(t):
    a, b = boxes(t)
    e = b.select("s_suppkey", F.col("x0").alias("center_x"), F.col("y0").alias("center_y"), F.lit(3.0).alias("radius_x"), F.lit(2.0).alias("radius_y"), F.lit(0.0).alias("angle"))
    return J.inside_ellipse(a.select("p_partkey", F.col("x0").alias("x"), F.col("y0").alias("y")), e, cell=4.0, repeats=True).select("p_partkey", "s_suppkey")
