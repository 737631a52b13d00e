"""Queries of metrics and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatframe.functions import arrays as A
from beatframe.operators import metrics as M
from beatframe.operators import rollup as R
from beatframe.operators import signals as G
from beatframe.plans.bindings import FRAMES, PAIRS, VECTORS, WINDOW
from beatframe.plans.frame_queries import BY, LP, r6
from beatframe.plans.registry import query

CORR = "(avg(p * t) - avg(p) * avg(t)) / (stddev_pop(p) * stddev_pop(t))"


def rounded(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes if c not in keys])


def sparse(t):
    """Pairs with a truth of few places."""
    return t.pairs().withColumn("truth", F.transform("truth", lambda x: F.when(F.abs(x) > 0.15, x).otherwise(0.0)))


SPARSE = "sp AS (SELECT key, anatomy_id, i, p, CASE WHEN abs(t) > 0.15 THEN t ELSE 0.0 END AS t FROM el)"


@query("me1_error_metrics", f"""WITH {PAIRS} SELECT anatomy_id, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(sqrt(avg((p - t) * (p - t))) / sqrt(avg(t * t)), 6) AS nrmse, round(avg(abs(p - t)), 6) AS mae, round(avg((p - t) * (p - t)), 6) AS mse,
round(sqrt(avg(p * p)), 6) AS prediction_rms, round(sqrt(avg(t * t)), 6) AS truth_rms, round(sqrt(avg(p * p)) / sqrt(avg(t * t)), 6) AS rms_ratio, round({CORR}, 6) AS correlation FROM el GROUP BY 1""")
def _(t):
    return rounded(M.error_metrics(M.pooled(M.frame_sums(t.pairs()), BY)), "anatomy_id")


@query("me2_pooled_correlation", f"WITH {PAIRS} SELECT round({CORR}, 6) AS correlation FROM el")
def _(t):
    return M.pooled(M.frame_sums(t.pairs()), []).select(r6(M.correlation()).alias("correlation"))


@query("me3_frame_correlation", f"WITH {PAIRS}, f AS (SELECT key, anatomy_id, {CORR} AS r FROM el GROUP BY 1, 2) SELECT anatomy_id, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, count(*) AS frames FROM f GROUP BY 1")
def _(t):
    return rounded(M.frame_correlations(M.frame_sums(t.pairs()), BY), "anatomy_id")


@query("me4_jointly_finite", f"WITH {PAIRS} SELECT key, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round({CORR}, 6) AS correlation FROM el WHERE p > -0.1 AND t < 0.1 GROUP BY key")
def _(t):
    d = t.pairs().withColumn("pred", F.transform("pred", lambda x: F.when(x > -0.1, x).otherwise(float("nan")))).withColumn("truth", F.transform("truth", lambda x: F.when(x < 0.1, x).otherwise(float("inf"))))
    return rounded(M.error_metrics(M.pooled(M.frame_sums(M.jointly_finite(d, "pred", "truth")), ["key"])).select("key", "rmse", "correlation"), "key")


DICE = f"{SPARSE}, s AS (SELECT key, anatomy_id, count(*) AS k FROM sp WHERE abs(t) > 1e-8 GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(p) DESC, i) AS n FROM sp), dc AS (SELECT s.key, any_value(s.anatomy_id) AS anatomy_id, sum(CAST(abs(t) > 1e-8 AS INTEGER)) / any_value(k) AS dice FROM rk JOIN s USING (key) WHERE n <= k GROUP BY 1)"


@query("me5_localisation_dice", f"WITH {PAIRS}, {DICE} SELECT key, round(dice, 6) AS dice FROM dc")
def _(t):
    return M.localisation_dice(sparse(t)).select("key", r6("dice").alias("dice"))


@query("se15_top_k", f"WITH {PAIRS}, rk AS (SELECT key, i, row_number() OVER (PARTITION BY key ORDER BY abs(p) DESC, i) AS n FROM el) SELECT key, CAST(sum(i - 1) AS BIGINT) AS total, min(i - 1) AS least FROM rk WHERE n <= 7 GROUP BY key")
def _(t):
    d = t.pairs().withColumn("top", M.top_k_indices("pred", F.lit(7)))
    return d.select("key", F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_min("top").cast("long").alias("least"))


MESH8 = "((i - 1) % 8 - 3.5) / 4 AS x, ((i - 1) // 8 - 3.5) / 4 AS y"


def mesh8(t):
    """64 elements on a square grid, for vectors of 64."""
    return t.spark.range(64).select(F.col("id").alias("elem_id"), ((F.col("id") % 8 - 3.5) / 4).alias("x"), ((F.floor(F.col("id") / 8) - 3.5) / 4).alias("y"))


@query("me6_object_metrics", f"""WITH {PAIRS}, g AS (SELECT key, anatomy_id, i, p, t, (i - 1) % 5 AS tissue, {MESH8} FROM el), vs AS (SELECT key, 2 * truth[1] AS ax, 2 * truth[2] AS ay, 2 * truth[3] AS bx, 2 * truth[4] AS by_, (key % 7)::DOUBLE AS an, 2 * pred[1] AS px, 2 * pred[2] AS py, 2 * pred[3] AS qx, 2 * pred[4] AS qy FROM pairs),
m AS (SELECT g.*, pow((cos(an) * (x - ax) + sin(an) * (y - ay)) / 0.5, 2) + pow((cos(an) * (y - ay) - sin(an) * (x - ax)) / 0.3, 2) <= 1 AS m0, pow((x - bx) / 0.4, 2) + pow((y - by_) / 0.4, 2) <= 1 AS m1 FROM g JOIN vs USING (key)),
c AS (SELECT *, m0 OR m1 AS core, row_number() OVER (PARTITION BY key ORDER BY abs(p) DESC, i) AS n, count(*) FILTER (WHERE m0 OR m1) OVER (PARTITION BY key) AS k FROM m),
f AS (SELECT key, any_value(anatomy_id) AS anatomy_id, 2.0 * count(*) FILTER (WHERE core AND n <= k) / nullif(2 * any_value(k), 0) AS dice, abs(avg(p) FILTER (WHERE m0) - avg(t) FILTER (WHERE m0)) AS a0, abs(avg(p) FILTER (WHERE m1) - avg(t) FILTER (WHERE m1)) AS a1, CASE WHEN sum(abs(t)) > 1e-10 THEN sum(abs(p)) / sum(abs(t)) END AS ratio FROM c GROUP BY 1),
h AS (SELECT anatomy_id, sqrt(avg(pow(p - t, 2)) FILTER (WHERE tissue = 3 AND NOT core)) AS halo, sqrt(avg(p * p) FILTER (WHERE tissue <> 3 AND NOT core)) AS outside FROM c GROUP BY 1),
d AS (SELECT key, least((sqrt(pow(px - ax, 2) + pow(py - ay, 2)) + sqrt(pow(qx - bx, 2) + pow(qy - by_, 2))) / 2, (sqrt(pow(px - bx, 2) + pow(py - by_, 2)) + sqrt(pow(qx - ax, 2) + pow(qy - ay, 2))) / 2) AS centre FROM vs)
SELECT anatomy_id, round(avg(dice), 6) AS core_dice, round(avg(centre), 6) AS centre_error, round((sum(a0) + sum(a1)) / (count(a0) + count(a1)), 6) AS amplitude_mae, round(any_value(halo), 6) AS halo_rmse, round(any_value(outside), 6) AS outside_rms, round(quantile_cont(ratio, 0.5), 6) AS mass_ratio_median FROM f JOIN d USING (key) JOIN h USING (anatomy_id) GROUP BY 1""")
def _(t):
    at = lambda c, i: 2 * F.col(c)[i]
    vessel = lambda i, a, b, angle: F.struct(at("truth", i).alias("x"), at("truth", i + 1).alias("y"), F.lit(a).alias("axis_a"), F.lit(b).alias("axis_b"), angle.cast("double").alias("angle"))
    centre = lambda i: F.struct(at("pred", i).alias("x"), at("pred", i + 1).alias("y"))
    d = t.pairs().withColumn("tissue", F.transform("pred", lambda x, i: i % 5)).withColumn("vessels", F.array(vessel(0, 0.5, 0.3, F.col("key") % 7), vessel(2, 0.4, 0.4, F.lit(0)))).withColumn("centres", F.array(centre(0), centre(2)))
    return rounded(M.object_metrics(d, BY, mesh8(t)), "anatomy_id")


@query("me7_support_metrics", f"WITH {PAIRS}, {SPARSE} SELECT anatomy_id, round(avg(CAST(sign(p) = sign(t) AS DOUBLE)) FILTER (WHERE abs(t) > 1e-8), 6) AS sign_accuracy, round(sqrt(avg(p * p) FILTER (WHERE abs(t) <= 1e-8)), 6) AS background_rms, round(avg(p) FILTER (WHERE abs(t) > 1e-8), 6) AS support_mean FROM sp GROUP BY 1")
def _(t):
    return rounded(M.support_metrics(sparse(t), BY), "anatomy_id")


@query("me8_dynamics", f"WITH {PAIRS}, j AS (SELECT a.p AS p0, b.p AS p1, a.t AS t0, b.t AS t1 FROM el a JOIN el b ON b.key = a.key + 1 AND a.i = b.i) SELECT round(sqrt(avg(pow(p1 - p0, 2))), 6) AS frame_difference_rms, round(sqrt(avg(pow(t1 - t0, 2))), 6) AS truth_frame_difference_rms, round(sqrt(avg(pow(p1 - p0, 2))) / sqrt(avg(pow(t1 - t0, 2))), 6) AS frame_difference_rms_ratio FROM j")
def _(t):
    return rounded(M.dynamics(t.pairs(), order="key"))


@query("me8_dynamics_in_anatomy", f"WITH {PAIRS}, j AS (SELECT a.p AS p0, b.p AS p1, a.t AS t0, b.t AS t1 FROM el a JOIN el b ON b.key = a.key + 1 AND a.i = b.i AND a.anatomy_id = b.anatomy_id) SELECT round(sqrt(avg(pow(p1 - p0, 2))), 6) AS frame_difference_rms, round(sqrt(avg(pow(t1 - t0, 2))), 6) AS truth_frame_difference_rms, round(sqrt(avg(pow(p1 - p0, 2))) / sqrt(avg(pow(t1 - t0, 2))), 6) AS frame_difference_rms_ratio FROM j")
def _(t):
    return rounded(M.dynamics(t.pairs(), order="key", scope=["anatomy_id"]))


@query("me9_dynamic_set", f"""WITH {PAIRS}, z AS (SELECT anatomy_id, i, arg_min(p, key) AS p0, arg_min(t, key) AS t0 FROM el GROUP BY 1, 2), w AS (SELECT el.*, p0, t0 FROM el JOIN z USING (anatomy_id, i)),
a AS (SELECT anatomy_id, CAST(sum(CAST(p <= 0 AS INTEGER)) AS BIGINT) AS nonpositive, round(sqrt(avg(pow(p - t, 2))), 6) AS absolute_rmse, round({CORR}, 6) AS absolute_correlation FROM w GROUP BY 1),
b AS (SELECT anatomy_id, round(sqrt(avg(pow(p - t, 2))), 6) AS dynamic_rmse, round(sqrt(avg(pow(p - t, 2))) / sqrt(avg(t * t)), 6) AS dynamic_nrmse, round({CORR}, 6) AS dynamic_correlation, round(sqrt(avg(p * p)) / sqrt(avg(t * t)), 6) AS dynamic_rms_ratio FROM (SELECT anatomy_id, p - r AS p, t - r AS t FROM w) GROUP BY 1),
f AS (SELECT anatomy_id, round(quantile_cont(c, 0.5), 6) AS dynamic_frame_correlation_median FROM (SELECT anatomy_id, key, {CORR} AS c FROM (SELECT anatomy_id, key, p - r AS p, t - r AS t FROM w) GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT anatomy_id, round(sqrt(avg(pow(p - t, 2))) / sqrt(avg(t * t)), 6) AS temporal_delta_nrmse, round({CORR}, 6) AS temporal_delta_correlation, round(sqrt(avg(p * p)) / sqrt(avg(t * t)), 6) AS temporal_delta_rms_ratio FROM (SELECT anatomy_id, p - p0 AS p, t - t0 AS t FROM w) GROUP BY 1)
SELECT * FROM a JOIN b USING (anatomy_id) JOIN f USING (anatomy_id) JOIN d USING (anatomy_id)""")
def _(t):
    return rounded(M.dynamic_set(t.pairs(), BY, order="key"), "anatomy_id")


@query("me10_relative_errors", f"WITH {PAIRS} SELECT key, round(sum(abs(p - t)) / sum(abs(t)), 6) AS re_l1, round(sqrt(sum(pow(p - t, 2))) / sqrt(sum(t * t)), 6) AS re_l2 FROM el GROUP BY 1")
def _(t):
    return rounded(M.relative_errors(t.pairs()).select("key", "re_l1", "re_l2"), "key")


@query("me11_parity", f"WITH {PAIRS} SELECT anatomy_id, round(sqrt(sum(pow(p - t, 2))) / sqrt(sum(t * t)), 6) AS relative_l2, round(max(abs(p - t)), 6) AS max_abs, round(avg(abs(p - t)), 6) AS mean_abs, false AS passed FROM el GROUP BY 1")
def _(t):
    return rounded(M.parity(t.pairs(), BY), "anatomy_id")


@query("me12_checkpoint_score", f"WITH {PAIRS}, {DICE}, a AS (SELECT anatomy_id, sqrt(avg(pow(p - t, 2))) / sqrt(avg(t * t)) AS nrmse, sqrt(avg(p * p) FILTER (WHERE abs(t) <= 1e-8)) AS bg FROM sp GROUP BY 1), b AS (SELECT anatomy_id, avg(dice) AS dice FROM dc GROUP BY 1) SELECT anatomy_id, round(nrmse + 0.5 * bg - 0.25 * dice, 6) AS score FROM a JOIN b USING (anatomy_id)")
def _(t):
    return rounded(M.checkpoint_score(sparse(t), BY, background=0.5, dice=0.25), "anatomy_id")


@query("me13_distillation", f"WITH {PAIRS}, m AS (SELECT anatomy_id % 2 AS g, round(avg(pow(p - t, 2)), 6) AS mse, round(avg(abs(p - t)), 6) AS mae, round({CORR}, 6) AS correlation, round(avg(t * t), 6) AS zero_mse FROM el GROUP BY 1), h AS (SELECT anatomy_id % 2 AS g, array_to_string(list_sort(list(DISTINCT anatomy_id) FILTER (WHERE key % 3 = 0)), ',') AS held_out_trials FROM pairs GROUP BY 1) SELECT * FROM m JOIN h USING (g)")
def _(t):
    d = t.pairs().withColumn("g", F.col("anatomy_id") % 2).withColumn("held", F.col("key") % 3 == 0)
    return rounded(M.distillation(d, ["g"], trial="anatomy_id", held_out="held"), "g").withColumn("held_out_trials", F.array_join(F.col("held_out_trials").cast("array<string>"), ","))


@query("me14_negative_mass", f"WITH {PAIRS} SELECT anatomy_id, round(sum(greatest(-p, 0)) / sum(abs(p)), 6) AS negative_mass FROM el GROUP BY 1")
def _(t):
    return rounded(M.negative_mass(t.pairs(), BY), "anatomy_id")


# -- roll-ups


@query("ag1_summary", "SELECT o_orderpriority, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS mean, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5), 4) AS median, max(CAST(o_totalprice AS DOUBLE)) AS max FROM orders GROUP BY 1")
def _(t):
    d = R.summary(t("orders").withColumn("x", F.col("o_totalprice").cast("double")), "x", ["o_orderpriority"])
    return d.select("o_orderpriority", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "max")


@query("ag2_activation", f"WITH {VECTORS}, f AS (SELECT CASE WHEN anatomy_id < 5 THEN 'a' ELSE 'b' END AS stage, sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64) AS rms FROM vectors), g AS (SELECT stage, avg(rms) AS mean, quantile_cont(rms, 0.5) AS median, max(rms) AS max FROM f GROUP BY 1) SELECT stage, round(mean, 6) AS mean, round(median, 6) AS median, round(max, 6) AS max, round(mean / (SELECT mean FROM g WHERE stage = 'a'), 6) AS share FROM g")
def _(t):
    d = t.vectors().withColumn("stage", F.when(F.col("anatomy_id") < 5, "a").otherwise("b"))
    return rounded(R.activation(d, "v", "stage", reference="a"), "stage")


@query("ag3_diagnostics", "SELECT l_returnflag, count(*) AS n, round(avg(l_discount::DOUBLE), 6) AS residual_mean, max(l_discount::DOUBLE) AS residual_max, round(avg(l_tax::DOUBLE), 6) AS step_mean, CAST(sum(l_linenumber) AS BIGINT) AS clipped_total FROM lineitem GROUP BY 1")
def _(t):
    d = t("lineitem").select("l_returnflag", F.col("l_discount").cast("double").alias("r"), F.col("l_tax").cast("double").alias("s"), F.col("l_linenumber").cast("long").alias("c"))
    return rounded(R.diagnostics(d, ["l_returnflag"], residual="r", step="s", clipped="c"), "l_returnflag")


@query("ag4_latency", "SELECT event_type, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def _(t):
    return rounded(R.latency(t("events"), "value", ["event_type"]), "event_type").withColumn("total", F.round("total", 4))


@query("ag5_throughput", "WITH c AS (SELECT event_type, (value + 1) / 100 AS s, 50 + event_id % 3 AS n FROM events), f AS (SELECT *, s / (n / 50) AS b FROM c) SELECT event_type, CAST(sum(n) AS BIGINT) AS timed_frames, round(sum(n) / sum(s), 6) AS effective_hz, round(sum(s) / sum(n), 6) AS per_frame, sum(n) / sum(s) >= 50 AS meets, round(avg(b), 6) AS budget_fraction, round(quantile_cont(b, 0.95), 6) AS budget_fraction_p95, round(max(b), 6) AS budget_fraction_max, quantile_cont(b, 0.95) <= 1 AS p95_meets, max(b) <= 1 AS max_meets, round(max(n) / 50, 6) AS buffer_fill, round(max(n) / 50 + avg(s), 6) AS buffered_delivery FROM f GROUP BY 1")
def _(t):
    d = t("events").select("event_type", ((F.col("value") + 1) / 100).alias("s"), (50 + F.col("event_id") % 3).alias("n"))
    return rounded(R.throughput(d, "s", "n", ["event_type"], hz=50), "event_type")


@query("ag6_session_gate", "WITH c AS (SELECT user_id, epoch(min(ts)) AS b, sum(value) / 10 AS s, count(*) * 50 AS n, max(value) / 1e6 AS d FROM events GROUP BY 1), w AS (SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS total_frames, max(b + s) - min(b) AS wall_s, max(d) AS worst_parity FROM c) SELECT sessions, total_frames, round(wall_s, 4) AS wall_s, round(total_frames / wall_s, 6) AS frames_per_s, round(wall_s * 8000 / total_frames, 4) AS scaled_s, round(worst_parity, 9) AS worst_parity, worst_parity <= 1e-4 AND wall_s * 8000 / total_frames <= 900 AS passed FROM w")
def _(t):
    s = t("events").groupBy("user_id").agg(F.min("ts").cast("timestamp").cast("double").alias("b"), (F.sum("value") / 10).alias("s"), (F.count("*") * 50).alias("n"), (F.max("value") / 1e6).alias("d"))
    g = R.session_gate(s, start="b", seconds="s", frames="n", difference="d")
    return g.withColumns({"wall_s": F.round("wall_s", 4), "scaled_s": F.round("scaled_s", 4), "frames_per_s": r6("frames_per_s"), "worst_parity": F.round("worst_parity", 9)})


@query("ag7_aggregate_metrics", "WITH o AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders), l AS (UNPIVOT o ON price, cust INTO NAME metric VALUE value) SELECT o_orderpriority, o_orderstatus, metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median, min(value) AS min, max(value) AS max, count(DISTINCT o_orderkey) = 100 AS complete FROM l GROUP BY 1, 2, 3")
def _(t):
    d = t("orders").select("o_orderpriority", "o_orderstatus", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    g = R.aggregate_metrics(d, ["o_orderpriority", "o_orderstatus"], ["price", "cust"], unit="o_orderkey", units=100)
    return g.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


@query("ag8_deltas", "WITH m AS (SELECT o_orderpriority AS stage, o_orderstatus AS version, CAST(count(*) % 7 AS DOUBLE) AS value FROM orders GROUP BY 1, 2) SELECT a.stage, a.version, a.value - b.value AS delta, round(CASE WHEN b.value = 0 THEN 'nan'::DOUBLE ELSE 100 * (a.value - b.value) / abs(b.value) END, 6) AS percent FROM m a JOIN m b ON a.stage = b.stage AND b.version = 'F' WHERE a.version <> 'F'")
def _(t):
    m = t("orders").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("version")).agg((F.count("*") % 7).cast("double").alias("value"))
    return R.deltas(m, ["stage"], version="version", value="value", baseline="F").withColumn("percent", r6("percent"))


@query("ag9_best_epoch", "SELECT l_orderkey, arg_min(l_linenumber, (CAST(l_quantity AS DOUBLE), l_linenumber)) AS l_linenumber, min(CAST(l_quantity AS DOUBLE)) AS score, count(*) AS epochs_run FROM lineitem GROUP BY 1")
def _(t):
    return R.best_epoch(t("lineitem").withColumn("score", F.col("l_quantity").cast("double")), ["l_orderkey"], score="score", epoch="l_linenumber")


def reports(t):
    """Orders as nested reports: key, history (stages of epochs), settings, physics, hashes."""
    e = F.struct(F.col("l_linenumber").alias("epoch"), F.col("l_quantity").cast("double").alias("composite_score"))
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(e)).alias("epochs"), F.max("l_returnflag").alias("flag"))
    return g.select("l_orderkey", F.array("epochs", F.slice("epochs", 1, 2)).alias("history"), F.struct("flag").alias("settings"), F.create_map(F.lit("n"), F.size("epochs")).alias("physics"), F.create_map(F.lit("md5"), F.md5("flag")).alias("hashes"))


@query("ag10_training_epochs", "WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem) SELECT l_orderkey, 0 AS stage, n - 1 AS epoch_order, l_linenumber AS epoch, q AS composite_score FROM e UNION ALL SELECT l_orderkey, 1, n - 1, l_linenumber, q FROM e WHERE n <= 2")
def _(t):
    return R.training_tables(reports(t), "l_orderkey")["epochs"].withColumn("epoch_order", F.col("epoch_order").cast("long"))


@query("ag10_training_selected", "WITH e AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS n FROM lineitem), s AS (SELECT l_orderkey, 0 AS stage, n, q FROM e UNION ALL SELECT l_orderkey, 1, n, q FROM e WHERE n < 2) SELECT l_orderkey, stage, arg_min(n, (q, n)) AS epoch_order, min(q) AS composite_score, count(*) AS epochs_run FROM s GROUP BY 1, 2")
def _(t):
    return R.training_tables(reports(t), "l_orderkey")["selected"].withColumn("epoch_order", F.col("epoch_order").cast("long"))


@query("ag10_training_hashes", "SELECT l_orderkey, 'md5' AS name, md5(max(l_returnflag)) AS value FROM lineitem GROUP BY 1")
def _(t):
    return R.training_tables(reports(t), "l_orderkey")["hashes"]


@query("ag11_comparison_table", "SELECT o_custkey, o_orderstatus AS stage, CAST(count(*) AS DOUBLE) AS n, max(CAST(o_totalprice AS DOUBLE)) AS top FROM orders GROUP BY 1, 2")
def _(t):
    g = t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").cast("double").alias("n"), F.max(F.col("o_totalprice").cast("double")).alias("top"))
    r = g.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("stage"), F.struct("n", "top").alias("metrics"))).alias("stages"))
    return R.comparison_table(r, "o_custkey", "stages")


@query("ag13_scale_fit", f"WITH {VECTORS}, x AS (SELECT unnest(v) AS x FROM vectors WHERE anatomy_id < 7), b AS (SELECT sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64) AS r FROM vectors WHERE anatomy_id < 7) SELECT round(quantile_cont(abs(x), 0.995), 6) AS all_p995, round(quantile_cont(abs(x), 0.995) FILTER (WHERE x <> 0), 6) AS nonzero_p995, round(max(abs(x)), 6) AS maximum, round(quantile_cont(abs(x), 0.995), 6) AS signal_p995, round((SELECT quantile_cont(r, 0.5) FROM b), 6) AS median_rms FROM x")
def _(t):
    d = t.vectors().withColumn("split", F.when(F.col("anatomy_id") < 7, "train").otherwise("test"))
    return rounded(R.scale_fit(d, "v", "v", split="split"))


@query("ag14_beat_quality", f"WITH {PAIRS} SELECT anatomy_id, count(DISTINCT key) AS frames, round(sqrt(sum(pow(p - t, 2))) / sqrt(sum(t * t)), 6) AS nrmse, round({CORR}, 6) AS correlation FROM el GROUP BY 1")
def _(t):
    return rounded(R.beat_quality(t.pairs(), BY), "anatomy_id")


@query("ag14_waveforms", f"WITH {PAIRS} SELECT anatomy_id, key, round(sqrt(avg(t * t)), 6) AS truth_rms, round(sqrt(avg(p * p)), 6) AS prediction_rms FROM el GROUP BY 1, 2")
def _(t):
    return rounded(R.waveforms(t.pairs(), BY, "key"), "anatomy_id", "key")


@query("ag15_weakest", f"WITH {FRAMES}, u AS (SELECT kind, anatomy_id, round(sqrt(avg(x * x)), 6) AS rms FROM frames GROUP BY 1, 2) SELECT kind, min(rms) AS rms FROM u GROUP BY 1")
def _(t):
    return R.weakest(t.frames(), "x", by=["kind"], unit="anatomy_id").select("kind", r6("rms").alias("rms"))


@query("ag16_coverage", f"""WITH {VECTORS}, x AS (SELECT CASE WHEN key % 2 = 0 THEN 'hp' ELSE 'lp' END AS signal, unnest(v) AS x, generate_subscripts(v, 1) AS c FROM vectors), c AS (SELECT signal, c, sqrt(avg(x * x)) AS rms, quantile_cont(x, 0.99) - quantile_cont(x, 0.01) AS span, sum(CAST(x < 0 AS INTEGER)) AS neg, count(*) AS n FROM x GROUP BY 1, 2),
g AS (SELECT signal, count(*) AS channels, quantile_cont(rms, 0.5) / 0.1 AS rms_ratio, quantile_cont(span, 0.5) / 0.4 AS span_ratio, sum(neg) / sum(n) AS negative_fraction FROM c GROUP BY 1)
SELECT signal, channels, round(rms_ratio, 6) AS rms_ratio, round(span_ratio, 6) AS span_ratio, round(negative_fraction, 6) AS negative_fraction, rms_ratio BETWEEN 0.5 AND 1.5 AND span_ratio BETWEEN 0.5 AND 1.5 AND negative_fraction BETWEEN 0.1 AND 0.9 AS passed FROM g""")
def _(t):
    d = A.long(t.vectors().withColumn("signal", F.when(F.col("key") % 2 == 0, "hp").otherwise("lp")), "v")
    audit = t.spark.range(2).select(F.when(F.col("id") == 0, "hp").otherwise("lp").alias("signal"), F.lit(0.1).alias("rms"), F.lit(0.4).alias("span"))
    return rounded(R.coverage(d, audit, signal="signal", channel="i", value="x", ratio=(0.5, 1.5), negative=(0.1, 0.9)), "signal")


@query("ag17_linearisation_gate", f"WITH {FRAMES}, {LP}, u AS (SELECT kind, anatomy_id, sqrt(sum(pow(lp - x, 2))) / sqrt(sum(x * x)) AS rel, CASE WHEN sum(x * x) / count(*) - pow(sum(x) / count(*), 2) > 1e-30 AND sum(lp * lp) / count(*) - pow(sum(lp) / count(*), 2) > 1e-30 THEN covar_pop(x, lp) / (stddev_pop(x) * stddev_pop(lp)) ELSE 0 END AS r FROM lp GROUP BY 1, 2) SELECT kind, round(avg(rel), 5) AS mean_error, round(max(rel), 5) AS max_error, round(avg(r), 5) AS mean_correlation, round(min(r), 5) AS min_correlation, avg(rel) <= 0.5 AND avg(r) >= 0.8 AS passed FROM u GROUP BY 1")
def _(t):
    d = G.hp_lp(t.frames(), by=BY, order="frame_no", window=WINDOW)
    g = R.linearisation_gate(d, ["kind"], unit="anatomy_id", exact="x", linear="lp")
    return g.select("kind", *[F.round(c, 5).alias(c) for c in ("mean_error", "max_error", "mean_correlation", "min_correlation")], "passed")


@query("ag18_display_limit", "SELECT event_type, round(greatest(quantile_cont(abs(value - 50), 0.995), 1e-8), 6) AS \"limit\", round(quantile_cont(value - 50, 0.005), 6) AS low, round(quantile_cont(value - 50, 0.995), 6) AS high FROM events GROUP BY 1")
def _(t):
    return rounded(R.display_limit(t("events").withColumn("x", F.col("value") - 50), "x", ["event_type"]), "event_type")


@query("ag19_channel_scale", f"WITH {VECTORS}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM vectors), g AS (SELECT i, max(abs(x)) AS s FROM x GROUP BY 1) SELECT i, round(CASE WHEN i IN (0, 1, 2) THEN (SELECT max(s) FROM g WHERE i IN (0, 1, 2)) ELSE s END, 6) AS scale FROM g")
def _(t):
    return R.channel_scale(A.long(t.vectors(), "v"), channel="i", value="x", shared=[0, 1, 2]).select(F.col("i").cast("long").alias("i"), r6("scale").alias("scale"))


@query("ag20_stage_fractions", "SELECT l_returnflag, round(avg(CAST(a <= b AND a <= c AS DOUBLE)), 6) AS share_a, round(avg(CAST(b < a AND b <= c AS DOUBLE)), 6) AS share_b, round(avg(CAST(c < a AND c < b AS DOUBLE)), 6) AS share_c, round(avg(CAST(c < a AS DOUBLE)), 6) AS accepted, round(avg(least(a, b, c)) / avg(a), 6) AS chosen_to_first FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS a, (l_partkey % 50)::DOUBLE AS b, (l_suppkey % 50)::DOUBLE AS c FROM lineitem) GROUP BY 1")
def _(t):
    d = t("lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("a"), (F.col("l_partkey") % 50).cast("double").alias("b"), (F.col("l_suppkey") % 50).cast("double").alias("c"))
    return rounded(R.stage_fractions(d, ["l_returnflag"], ["a", "b", "c"]), "l_returnflag")


@query("ag21_classify", """WITH c AS (SELECT p_partkey, (p_partkey % 7) / 7.0 AS a, (p_partkey % 5) / 5.0 AS b, (p_partkey % 3) / 3.0 AS d, (p_partkey % 11) / 11.0 AS e, (p_partkey % 40) / 1.9 AS f, 1.0 AS g, (p_size % 10) / 10.0 AS h FROM part),
w AS (SELECT *, a < 0.5 AS wa, b > 0.3 AS wb, d > 0.3 AS wd, e > 0.5 AS we, abs(f - 1) < 5 AS wf, abs(g - 1) < 2 AS wg, h < 0.5 AS wh FROM c),
n AS (SELECT *, CAST(wa AS INTEGER) + CAST(wb AS INTEGER) + CAST(wd AS INTEGER) + CAST(we AS INTEGER) + CAST(wf AS INTEGER) + CAST(wg AS INTEGER) + CAST(wh AS INTEGER) AS n FROM w)
SELECT p_partkey, wa AS better_element_nrmse, wb AS better_image_correlation, wd AS better_localisation_dice, we AS better_sign_accuracy, wf AS better_rms_ratio, wg AS better_frame_difference_rms_ratio, wh AS better_voltage_residual, round(a - 0.5, 6)::DOUBLE AS delta_element_nrmse, round(f - 6, 6)::DOUBLE AS delta_rms_ratio, round(h - 0.5, 6)::DOUBLE AS delta_voltage_residual, true AS finite, f BETWEEN 0.05 AND 20 AS sane, n AS improvements, CASE WHEN NOT f BETWEEN 0.05 AND 20 THEN 'failed' WHEN n >= 4 THEN 'promising' ELSE 'exploratory' END AS class FROM n""")
def _(t):
    p = lambda e: F.expr(e).cast("double")
    c = t("part").select("p_partkey", F.lit(1).alias("k"), p("p_partkey % 7 / 7.0D").alias("element_nrmse"), p("p_partkey % 5 / 5.0D").alias("image_correlation"), p("p_partkey % 3 / 3.0D").alias("localisation_dice"), p("p_partkey % 11 / 11.0D").alias("sign_accuracy"), p("p_partkey % 40 / 1.9D").alias("rms_ratio"), p("1").alias("frame_difference_rms_ratio"), p("p_size % 10 / 10.0D").alias("voltage_residual"))
    base = {"element_nrmse": 0.5, "image_correlation": 0.3, "localisation_dice": 0.3, "sign_accuracy": 0.5, "rms_ratio": 6.0, "frame_difference_rms_ratio": 3.0, "voltage_residual": 0.5}
    b = t.spark.range(1).select(F.lit(1).alias("k"), *[F.lit(v).alias(n) for n, v in base.items()])
    d = R.classify(c, b, ["k"])
    deltas = [r6(f"delta_{m}").alias(f"delta_{m}") for m in ("element_nrmse", "rms_ratio", "voltage_residual")]
    return d.select("p_partkey", *[f"better_{m}" for m in base], *deltas, "finite", "sane", "improvements", "class")
