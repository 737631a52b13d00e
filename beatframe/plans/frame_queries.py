"""Queries on frames: projections, signals, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from beatframe.functions import arrays as A
from beatframe.operators import projections as P
from beatframe.operators import select as S
from beatframe.operators import signals as G
from beatframe.plans.bindings import FPB, FRAMES, VECTORS, WINDOW
from beatframe.plans.registry import query

BY = ["anatomy_id"]
MEAN = f"avg(x) OVER (PARTITION BY anatomy_id ORDER BY frame_no ROWS BETWEEN {WINDOW // 2} PRECEDING AND {WINDOW - WINDOW // 2 - 1} FOLLOWING)"
LP = f"lp AS (SELECT *, {MEAN} AS lp FROM frames)"
REF = "ref AS (SELECT *, lp - max(CASE WHEN frame_no = 0 THEN lp END) OVER p AS rlp, (x - lp) - max(CASE WHEN frame_no = 0 THEN x - lp END) OVER p AS rhp FROM lp WINDOW p AS (PARTITION BY anatomy_id))"


def r6(c):
    return F.round(c, 6)


# -- projections


@query("pr1_resistance_to_voltage", "SELECT l_orderkey, l_linenumber, round(CAST(l_extendedprice AS DOUBLE) * 0.01, 6) AS voltage FROM lineitem")
def _(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("r"))
    return P.resistance_to_voltage(d, "r").select("l_orderkey", "l_linenumber", r6("voltage").alias("voltage"))


@query("pr2_model_input", f"WITH {FRAMES}, {LP} SELECT anatomy_id, frame_no, round(first_value(lp + (x - lp)) OVER (PARTITION BY anatomy_id ORDER BY frame_no) - (lp + (x - lp)), 4) AS input FROM lp")
def _(t):
    d = G.hp_lp(t.frames(), by=BY, order="frame_no", window=WINDOW)
    return P.model_input(d, "hp", "lp", by=BY, order="frame_no").select("anatomy_id", "frame_no", F.round("input", 4).alias("input"))


@query("pr3_flip_sign", f"WITH {VECTORS} SELECT key, round(list_sum(list_transform(v, lambda x: -x)), 6) AS s, -v[1] AS first FROM vectors")
def _(t):
    return P.flip_sign(t.vectors(), "v").select("key", r6(A.total("v")).alias("s"), F.col("v")[0].alias("first"))


@query("pr4_fill_outside", f"WITH {VECTORS} SELECT key, round(list_sum(list_transform(v, lambda x: CASE WHEN x < 0 THEN 0.3 ELSE x END)), 6) AS s FROM vectors")
def _(t):
    d = t.vectors().withColumn("v", F.transform("v", lambda x: F.when(x < 0, float("nan")).otherwise(x)))
    return P.fill_outside(d, "v", 0.3).select("key", r6(A.total("v")).alias("s"))


@query("pr5_floor_values", f"WITH {VECTORS} SELECT key, len(list_filter(v, lambda x: x < 0.01)) AS clipped, round(list_sum(list_transform(v, lambda x: greatest(x, 0.01))), 6) AS s FROM vectors")
def _(t):
    return P.floor_values(t.vectors(), "v", 0.01).select("key", F.col("clipped").cast("long").alias("clipped"), r6(A.total("v")).alias("s"))


@query("pr6_ring_label", "SELECT p_partkey, CASE WHEN p_size BETWEEN 6 AND 13 THEN 'US' || lpad(CAST(p_size * 10 AS VARCHAR), 3, '0') END AS ring, CASE WHEN p_size BETWEEN 6 AND 12 THEN 'US' || lpad(CAST(p_size * 10 + 5 AS VARCHAR), 3, '0') END AS half FROM part")
def _(t):
    return t("part").select("p_partkey", P.ring_label(F.col("p_size").cast("string")).alias("ring"), P.ring_label(F.concat(F.col("p_size").cast("string"), F.lit(".5"))).alias("half"))


@query("pr7_phase_filter", f"WITH {FRAMES} SELECT frame_no, sample_index, x FROM frames WHERE anatomy_id = 3 AND beat_id = 3001")
def _(t):
    return P.phase_filter(t.frames(), 3, 3001).select("frame_no", "sample_index", "x")


@query("pr8_not_excluded", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P')")
def _(t):
    d = t("orders").withColumn("exclusion_reason", F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", ""))
    return P.not_excluded(d).select("o_orderkey")


@query("pr9_scalar_columns", "SELECT vec_id, label FROM embeddings")
def _(t):
    return P.scalar_columns(t("embeddings"))


@query("pr10_baseline", f"WITH {VECTORS} SELECT key, len(v) AS n, CAST(round(0.7 * len(v), 6) AS DOUBLE) AS s FROM vectors")
def _(t):
    return P.baseline(t.vectors(), "v").select("key", F.size("sigma_baseline").cast("long").alias("n"), r6(A.total("sigma_baseline")).alias("s"))


@query("io13_wide_long", f"WITH {VECTORS}, l AS (SELECT key, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM vectors) SELECT i, round(sum(x), 6) AS s, count(*) AS n FROM l GROUP BY i")
def _(t):
    return A.long(t.vectors(), "v").groupBy("i").agg(r6(F.sum("x")).alias("s"), F.count("*").alias("n")).withColumn("i", F.col("i").cast("long"))


@query("io13_long_wide", f"WITH {VECTORS} SELECT key, len(v) AS n, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS s FROM vectors")
def _(t):
    d = A.wide(A.long(t.vectors(), "v").select("key", "i", "x"), ["key"])
    return d.select("key", F.size("v").cast("long").alias("n"), r6(A.sum_squares("v")).alias("s"))


# -- signals


@query("wn1_moving_mean", f"WITH {FRAMES} SELECT anatomy_id, frame_no, round({MEAN}, 6) AS lp FROM frames")
def _(t):
    return t.frames().select("anatomy_id", "frame_no", r6(G.moving_mean("x", by=BY, order="frame_no", window=WINDOW)).alias("lp"))


@query("wn1_long_recordings", f"WITH {FRAMES}, o AS (SELECT anatomy_id, frame_no + 30 * (frame_no // 7) AS frame_no, x FROM frames) SELECT anatomy_id, frame_no, round(avg(x) OVER (PARTITION BY anatomy_id ORDER BY frame_no ROWS BETWEEN {WINDOW // 2} PRECEDING AND {WINDOW - WINDOW // 2 - 1} FOLLOWING), 6) AS lp FROM o")
def _(t):
    """Recordings with gaps, in blocks of 16 frames."""
    from beatframe.operators.blocks import moving_mean

    d = moving_mean(t.frames().withColumn("frame_no", F.col("frame_no") + 30 * F.floor(F.col("frame_no") / 7)), "x", by=BY, order="frame_no", window=WINDOW, block=16)
    return d.select("anatomy_id", "frame_no", r6("lp").alias("lp"))


@query("wn2_hp_lp", f"WITH {FRAMES}, {LP} SELECT anatomy_id, frame_no, round(lp, 6) AS lp, round(x - lp, 6) AS hp FROM lp")
def _(t):
    return G.hp_lp(t.frames(), by=BY, order="frame_no", window=WINDOW).select("anatomy_id", "frame_no", r6("lp").alias("lp"), r6("hp").alias("hp"))


@query("wn3_component_reference", f"WITH {FRAMES} SELECT anatomy_id, frame_no, round(x - max(CASE WHEN frame_no = 3 THEN x END) OVER (PARTITION BY anatomy_id), 6) AS x FROM frames")
def _(t):
    return G.component_reference(t.frames(), ["x"], by=BY, order="frame_no", k=3).select("anatomy_id", "frame_no", r6("x").alias("x"))


@query("wn4_referenced_hp_lp", f"WITH {FRAMES}, {LP}, {REF} SELECT anatomy_id, frame_no, round(rhp, 6) AS hp, round(rlp, 6) AS lp FROM ref")
def _(t):
    return G.referenced_hp_lp(t.frames(), by=BY, order="frame_no", window=WINDOW).select("anatomy_id", "frame_no", r6("hp").alias("hp"), r6("lp").alias("lp"))


@query("wn4_referenced_hp_lp_rms", f"WITH {FRAMES}, {LP}, {REF} SELECT anatomy_id, beat_id, count(*) AS frames, round(sqrt(avg(rhp * rhp)), 6) AS hp_rms, round(sqrt(avg(rlp * rlp)), 6) AS lp_rms FROM ref GROUP BY 1, 2")
def _(t):
    d = G.referenced_hp_lp(t.frames(), by=BY, order="frame_no", window=WINDOW)
    square = lambda c: r6(F.sqrt(F.avg(F.col(c) * F.col(c))))
    return d.groupBy("anatomy_id", "beat_id").agg(F.count("*").alias("frames"), square("hp").alias("hp_rms"), square("lp").alias("lp_rms"))


D1 = "d1 AS (SELECT *, coalesce((lead(x) OVER w - lag(x) OVER w) / 2, 0) AS d FROM frames WINDOW w AS (PARTITION BY anatomy_id ORDER BY frame_no))"


@query("wn5_centered_difference", f"WITH {FRAMES}, {D1} SELECT anatomy_id, frame_no, round(d, 6) AS d FROM d1")
def _(t):
    return t.frames().select("anatomy_id", "frame_no", r6(G.centered_difference("x", by=BY, order="frame_no")).alias("d"))


@query("wn6_second_difference", f"WITH {FRAMES}, {D1} SELECT anatomy_id, frame_no, round(d, 6) AS d, round(coalesce((lead(d) OVER w - lag(d) OVER w) / 2, 0), 6) AS dd FROM d1 WINDOW w AS (PARTITION BY anatomy_id ORDER BY frame_no)")
def _(t):
    return G.second_difference(t.frames(), "x", by=BY, order="frame_no").select("anatomy_id", "frame_no", r6("d").alias("d"), r6("dd").alias("dd"))


@query("wn7_decompose_and_retain", f"""WITH {FRAMES}, {LP}, r AS (SELECT *, lp - max(CASE WHEN frame_no = 10 THEN lp END) OVER p AS rlp, (x - lp) - max(CASE WHEN frame_no = 10 THEN x - lp END) OVER p AS rhp FROM lp WINDOW p AS (PARTITION BY anatomy_id)),
k AS (SELECT anatomy_id, frame_no - 10 AS frame_no, x, rhp, rlp FROM r WHERE frame_no BETWEEN 10 AND 49)
SELECT anatomy_id, frame_no, 'full' AS component, round(x, 6) AS value FROM k UNION ALL SELECT anatomy_id, frame_no, 'hp', round(rhp, 6) FROM k UNION ALL SELECT anatomy_id, frame_no, 'lp', round(rlp, 6) FROM k""")
def _(t):
    d = G.decompose_and_retain(t.frames(), by=BY, order="frame_no", window=WINDOW, pad=FPB, keep=4 * FPB)
    return d.withColumn("value", r6("value"))


@query("wn9_frame_steps", "SELECT round(sqrt(avg(pow(b.value - a.value, 2))), 6) AS step_rms, count(*) AS n FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def _(t):
    d = G.frame_steps(t("events").select("event_id", "value"), "value", order="event_id")
    return d.agg(r6(F.sqrt(F.avg("step2"))).alias("step_rms"), F.count("*").alias("n"))


@query("wn9_beat_steps", f"WITH {FRAMES} SELECT a.anatomy_id, round(sqrt(avg(pow(b.x - a.x, 2))), 6) AS step_rms, count(*) AS n FROM frames a JOIN frames b ON b.beat_id = a.beat_id AND b.frame_no = a.frame_no + 1 GROUP BY 1")
def _(t):
    d = G.frame_steps(t.frames(), "x", order="frame_no", scope=["beat_id"])
    return d.groupBy("anatomy_id").agg(r6(F.sqrt(F.avg("step2"))).alias("step_rms"), F.count("*").alias("n"))


@query("wn10_delta_to_first", "SELECT event_id, round(value - (SELECT value FROM events ORDER BY event_id LIMIT 1), 6) AS delta FROM events")
def _(t):
    return G.delta_to_first(t("events").select("event_id", "value"), "value", order="event_id").select("event_id", r6("delta").alias("delta"))


@query("wn11_peak_sample", f"WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY beat_id ORDER BY x DESC, sample_index) AS n FROM frames) SELECT beat_id, sample_index, x FROM n WHERE n = 1")
def _(t):
    return G.peak_sample(t.frames(), "x", by=["beat_id"], order="sample_index").select("beat_id", "sample_index", "x")


@query("wn12_consecutive_periods", """WITH s AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS period, min(event_id) AS pos FROM events GROUP BY 1, 2),
g AS (SELECT *, lead(period) OVER w - period AS d1, lead(period, 2) OVER w - lead(period) OVER w AS d2 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, arg_min(period, pos) AS start FROM g WHERE d1 = 1 AND d2 = 1 GROUP BY user_id""")
def _(t):
    d = t("events").select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("long") % 12).alias("period"))
    return G.consecutive_periods(d, by=["user_id"], period="period", order="event_id", n=3)


@query("wn13_phase_rank", f"WITH {FRAMES} SELECT beat_id, frame_no, row_number() OVER (PARTITION BY beat_id ORDER BY sample_index DESC) - 1 AS phase_index FROM frames")
def _(t):
    d = G.phase_rank(t.frames().withColumn("phase", -F.col("sample_index")), by=["beat_id"], phase="phase")
    return d.select("beat_id", "frame_no", F.col("phase_index").cast("long").alias("phase_index"))


@query("wn18_residual_frames", f"WITH {FRAMES} SELECT anatomy_id, frame_no FROM (SELECT *, max(frame_no) OVER (PARTITION BY anatomy_id) AS m FROM frames) WHERE frame_no % 7 = 0 OR frame_no = m")
def _(t):
    return G.residual_frames(t.frames(), by=BY, order="frame_no", stride=7).select("anatomy_id", "frame_no")


@query("st1_tumbling_buffers", f"WITH {FRAMES} SELECT anatomy_id, frame_no // 50 AS buffer, count(*) AS frames, round(avg(x), 6) AS mean FROM frames GROUP BY 1, 2")
def _(t):
    return t.frames().withColumn("buffer", G.tumbling("frame_no")).groupBy("anatomy_id", "buffer").agg(F.count("*").alias("frames"), r6(F.avg("x")).alias("mean"))


@query("st3_reference_epochs", f"""WITH {FRAMES}, a AS (SELECT *, CAST(kind = 'error' OR frame_no = 0 AS INTEGER) AS rs FROM frames), b AS (SELECT *, sum(rs) OVER (PARTITION BY anatomy_id ORDER BY frame_no) AS part FROM a),
c AS (SELECT *, (row_number() OVER (PARTITION BY anatomy_id, part ORDER BY frame_no) - 1) // 5 AS ep FROM b)
SELECT anatomy_id, frame_no, CAST(part AS VARCHAR) || '-' || CAST(ep AS VARCHAR) AS epoch, round(x - first_value(x) OVER (PARTITION BY anatomy_id, part, ep ORDER BY frame_no), 6) AS delta FROM c""")
def _(t):
    d = t.frames().withColumn("reset", F.col("kind") == "error")
    return G.reference_epochs(d, by=BY, order="frame_no", reset="reset", size=5).select("anatomy_id", "frame_no", "epoch", r6("delta").alias("delta"))


# -- selection

COMPLETE = f"cb AS (SELECT anatomy_id, beat_id FROM frames GROUP BY 1, 2 HAVING count(*) = {FPB} AND count(DISTINCT sample_index) = {FPB} AND min(sample_index) = 0 AND max(sample_index) = {FPB - 1})"


@query("se1_first_complete_beat", f"WITH {FRAMES}, {COMPLETE} SELECT beat_id, frame_no, x FROM frames WHERE beat_id = (SELECT beat_id FROM cb ORDER BY anatomy_id, beat_id LIMIT 1)")
def _(t):
    return S.first_complete_beat(t.frames(), fpb=FPB).select("beat_id", "frame_no", "x")


@query("se2_consecutive_beats", f"WITH {FRAMES}, {COMPLETE}, a AS (SELECT DISTINCT anatomy_id, beat_id FROM frames), b AS (SELECT a.*, sum(CAST(cb.beat_id IS NOT NULL AS INTEGER)) OVER (PARTITION BY a.anatomy_id ORDER BY a.beat_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM a LEFT JOIN cb USING (beat_id)) SELECT anatomy_id, min(beat_id) AS first_beat FROM b WHERE run = 3 GROUP BY 1")
def _(t):
    return S.consecutive_complete_beats(t.frames(), 3, fpb=FPB)


@query("se3_split_ids", "WITH r AS (SELECT user_id, row_number() OVER (ORDER BY md5('7:' || user_id), user_id) AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, CASE WHEN n <= 80 THEN 'train' WHEN n <= 100 THEN 'validation' ELSE 'test' END AS split FROM r WHERE n <= 120")
def _(t):
    return S.split_ids(t("events"), {"train": 80, "validation": 20, "test": 20}, seed=7, column="user_id")


@query("se4_position_split", f"WITH {FRAMES} SELECT anatomy_id, frame_no, CASE WHEN row_number() OVER (PARTITION BY anatomy_id ORDER BY frame_no) <= floor(0.8 * count(*) OVER (PARTITION BY anatomy_id)) THEN 'train' ELSE 'validation' END AS split FROM frames")
def _(t):
    return S.position_split(t.frames(), 0.8, order="frame_no", by=BY).select("anatomy_id", "frame_no", "split")


@query("se5_stratified", "WITH u AS (SELECT DISTINCT c_mktsegment, c_custkey FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) AS pick FROM u) SELECT * FROM n WHERE pick <= 5")
def _(t):
    return S.stratified(t("customer"), 5, by="c_mktsegment", unit="c_custkey", seed=3).withColumn("pick", F.col("pick").cast("long"))


@query("se6_gallery", "WITH n AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) > 1 AS later FROM customer) SELECT c_custkey, c_mktsegment FROM n ORDER BY later, c_custkey LIMIT 12")
def _(t):
    return S.gallery(t("customer").select("c_custkey", "c_mktsegment"), 12, by="c_mktsegment", order="c_custkey")


@query("se7_even_rows", f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY anatomy_id) AS n FROM frames), w AS (SELECT DISTINCT anatomy_id, (j * (n - 1)) // 8 AS frame_no FROM (SELECT DISTINCT anatomy_id, n FROM n), range(9) r(j)) SELECT anatomy_id, frame_no, x FROM frames JOIN w USING (anatomy_id, frame_no)")
def _(t):
    return S.even_rows(t.frames(), 9, by=BY, order="frame_no").select("anatomy_id", "frame_no", "x")


@query("se8_head", f"WITH {FRAMES} SELECT anatomy_id, frame_no, x FROM frames ORDER BY anatomy_id, frame_no LIMIT 100")
def _(t):
    return S.head(t.frames().select("anatomy_id", "frame_no", "x"), 100, order=["anatomy_id", "frame_no"])


@query("se9_phase_pick", f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY beat_id ORDER BY x DESC, sample_index) AS a, row_number() OVER (PARTITION BY beat_id ORDER BY x, sample_index) AS b, row_number() OVER (PARTITION BY beat_id ORDER BY abs(x), sample_index) AS c FROM frames),
s AS (SELECT *, CASE WHEN a = 1 THEN 0 WHEN b = 1 THEN 1 WHEN c = 1 THEN 2 ELSE 3 END AS s FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY beat_id ORDER BY s, md5('5:' || beat_id || ':' || sample_index), sample_index) AS k FROM s) SELECT beat_id, sample_index, x FROM k WHERE k <= 4""")
def _(t):
    return S.phase_pick(t.frames(), 4, by=["beat_id"], value="x", order="sample_index", seed=5).select("beat_id", "sample_index", "x")


@query("se10_nearest_phase", f"WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY beat_id ORDER BY abs(x - 60), sample_index) AS n FROM frames WHERE x >= 10) SELECT beat_id, sample_index, x FROM n WHERE n = 1")
def _(t):
    return S.nearest_phase(t.frames(), F.lit(60.0), by=["beat_id"], value="x", order="sample_index", least=10).select("beat_id", "sample_index", "x")


@query("se11_best_and_worst", f"""WITH {FRAMES}, h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY anatomy_id ORDER BY x, frame_no) <= count(*) OVER (PARTITION BY anatomy_id) // 2 THEN 'good' ELSE 'bad' END AS pool FROM frames),
k AS (SELECT *, row_number() OVER (PARTITION BY anatomy_id, pool ORDER BY md5('9:' || frame_no), frame_no) AS k FROM h) SELECT anatomy_id, frame_no, pool, row_number() OVER (PARTITION BY anatomy_id, pool ORDER BY x, frame_no) AS pool_rank FROM k WHERE k <= 3""")
def _(t):
    d = S.best_and_worst(t.frames(), 3, by=BY, score="x", order="frame_no", seed=9)
    return d.select("anatomy_id", "frame_no", "pool", F.col("pool_rank").cast("long").alias("pool_rank"))


@query("se12_top_per_group", "WITH n AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) SELECT * FROM n WHERE rank <= 5")
def _(t):
    d = t("supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return S.top_per_group(d, 5, by=["s_nationkey"], score="s_acctbal", order="s_suppkey").select("s_nationkey", "s_suppkey", F.col("rank").cast("long").alias("rank"))


@query("se13_match_rms", f"""WITH {VECTORS}, r AS (SELECT key, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)) AS rms, v[1] AS x FROM vectors), real AS (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS i, p_retailprice / 10000.0 AS rms FROM part),
j AS (SELECT r.*, CAST(('0x' || substr(md5('2:' || key), 1, 8)) AS BIGINT) % (SELECT count(*) FROM real) AS i FROM r)
SELECT key, round(least(greatest(real.rms / greatest(j.rms, 1e-12), 0.25), 4.0), 6) AS factor, round(x * least(greatest(real.rms / greatest(j.rms, 1e-12), 0.25), 4.0), 6) AS x FROM j JOIN real USING (i)""")
def _(t):
    d = t.vectors().select("key", A.rms("v").alias("rms"), F.col("v")[0].alias("x"))
    low = t("part").agg(F.min("p_partkey").alias("low"))
    real = t("part").crossJoin(low).select((F.col("p_partkey") - F.col("low")).alias("i"), (F.col("p_retailprice").cast("double") / 10000.0).alias("rms"))
    return S.match_rms(d, real, key="key", columns=["x"], rms="rms", seed=2, low=0.25, high=4.0).select("key", r6("factor").alias("factor"), r6("x").alias("x"))


@query("se14_multi_key_sort", f"WITH {FRAMES} SELECT anatomy_id, beat_id, sample_index, row_number() OVER (PARTITION BY anatomy_id ORDER BY beat_id, sample_index) AS at FROM frames")
def _(t):
    w = Window.partitionBy("anatomy_id").orderBy("beat_id", "sample_index")
    return t.frames().select("anatomy_id", "beat_id", "sample_index", F.row_number().over(w).cast("long").alias("at")).orderBy("anatomy_id", "beat_id", "sample_index")


@query("se16_best_median_worst", f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY anatomy_id) AS n, row_number() OVER (PARTITION BY anatomy_id ORDER BY x, frame_no) AS r FROM frames)
SELECT anatomy_id, frame_no, CASE WHEN r = 1 THEN 'best' WHEN r = n // 2 + 1 THEN 'median' ELSE 'worst' END AS place FROM n WHERE r = 1 OR r = n // 2 + 1 OR r = n""")
def _(t):
    return S.best_median_worst(t.frames(), by=BY, score="x", order="frame_no").select("anatomy_id", "frame_no", "place")
