"""Queries of linear reconstruction and beat templates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from beatframe.functions import arrays as A
from beatframe.operators import blocks as B
from beatframe.operators import linear as L
from beatframe.operators import templates as T
from beatframe.plans.bindings import FRAMES, VECTORS
from beatframe.plans.frame_queries import BY, r6
from beatframe.plans.metric_queries import rounded
from beatframe.plans.registry import query

#: An 8 x 64 operator, and one the other way.
ROW, COL = np.indices((8, 64))
JACOBIAN = ((ROW * 13 + COL * 7) % 11 - 5) / 10
INVERSE = ((COL * 5 + ROW * 3) % 7 - 3).T / 20
MATRICES = "j AS (SELECT r, c, ((r * 13 + c * 7) % 11 - 5) / 10 AS a, ((c * 5 + r * 3) % 7 - 3) / 20 AS b FROM range(8) x(r), range(64) y(c)), s AS (SELECT key, anatomy_id, frame_no, i - 1 AS c, v[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors)), v8 AS (SELECT key, c AS r, x AS v FROM s WHERE c < 8)"
FORWARD = "f AS (SELECT key, r, sum(a * x) AS f FROM s JOIN j USING (c) GROUP BY 1, 2)"


def weighted(vector):
    """The sum of a result's elements, each times its place, signs kept; null where the result is."""
    return F.round(F.aggregate(F.transform(vector, lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, y: a + y), 5)


@query("ln1_reconstruct", f"WITH {VECTORS}, {MATRICES}, d AS (SELECT key, c, x - first_value(x) OVER (PARTITION BY anatomy_id, c ORDER BY frame_no) AS d FROM s) SELECT key, round(sum(y * (r + 1)), 5) AS weighted FROM (SELECT key, r, sum(a * d) AS y FROM d JOIN j USING (c) GROUP BY 1, 2) GROUP BY 1")
def _(t):
    d = L.reconstruct(t.vectors(), "v", JACOBIAN, by=BY, order="frame_no")
    return d.select("key", weighted("reconstruction").alias("weighted"))


#: Four rings with operators of their own, ring 3 narrower; frames of five rings, some of them null, short, or with a null or a NaN.
RING_WIDTH = [64, 64, 64, 40]
RING_JACOBIAN = {r: (((ROW * 13 + COL * 7 + 3 * r) % 11 - 5) / 10)[:, :w] for r, w in enumerate(RING_WIDTH)}
RING_INVERSE = {r: (((COL * 5 + ROW * 3 + 2 * r) % 7 - 3).T / 20)[:w] for r, w in enumerate(RING_WIDTH)}
RINGS = f"""{VECTORS}, j AS (SELECT ring, r, c, ((r * 13 + c * 7 + 3 * ring) % 11 - 5) / 10 AS a, ((c * 5 + r * 3 + 2 * ring) % 7 - 3) / 20 AS b FROM range(4) k(ring), range(8) x(r), range(64) y(c) WHERE ring < 3 OR c < 40), w AS (SELECT ring, count(DISTINCT c) AS w FROM j GROUP BY 1),
rv AS (SELECT key, anatomy_id, frame_no, ring, v[1:8] AS volt, CASE WHEN key % 19 <> 0 THEN list_transform(v[1:n], lambda x, i: CASE WHEN key % 11 = 0 AND i = 3 THEN 'nan'::DOUBLE WHEN key % 13 = 0 AND i = 5 THEN NULL ELSE x END) END AS v FROM (SELECT *, (key // 2) % 5 AS ring, CASE WHEN key % 3 = 0 THEN 40 ELSE 64 END AS n FROM vectors)),
s AS (SELECT key, ring, i - 1 AS c, v[i] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM rv)), g AS (SELECT key FROM rv JOIN w USING (ring) WHERE len(v) = w AND len(list_filter(v, lambda x: x IS NULL)) = 0),
f AS (SELECT key, ring, r, sum(a * x) AS f FROM s JOIN g USING (key) JOIN j USING (ring, c) GROUP BY 1, 2, 3)"""


def ringed_vectors(t):
    k = F.col("key")
    v = F.transform(F.slice("v", 1, F.when(k % 3 == 0, 40).otherwise(64)), lambda x, i: F.when((k % 11 == 0) & (i == 2), float("nan")).when((k % 13 == 0) & (i == 4), F.lit(None)).otherwise(x))
    return t.vectors().select("key", "anatomy_id", "frame_no", (F.floor(k / 2) % 5).alias("ring"), F.slice("v", 1, 8).alias("volt"), F.when(k % 19 != 0, v).alias("v"))


@query("ln1_all_rings", f"WITH {RINGS}, o AS (SELECT key, first_value(key) OVER (PARTITION BY anatomy_id, ring ORDER BY frame_no) AS k0 FROM rv), d AS (SELECT o.key, x.ring, x.c, x.x - y.x AS d FROM o JOIN s x ON x.key = o.key JOIN s y ON y.key = o.k0 AND y.c = x.c), n AS (SELECT key FROM o JOIN rv USING (key) JOIN rv z ON z.key = k0 JOIN w ON w.ring = rv.ring WHERE len(rv.v) = w AND len(z.v) = w AND len(list_filter(rv.v, lambda x: x IS NULL)) = 0 AND len(list_filter(z.v, lambda x: x IS NULL)) = 0), y AS (SELECT key, r, sum(a * d) AS y FROM d JOIN n USING (key) JOIN j USING (ring, c) GROUP BY 1, 2) SELECT key, round(sum(y * (r + 1)), 5) AS weighted FROM rv LEFT JOIN y USING (key) GROUP BY 1")
def _(t):
    d = L.reconstruct(ringed_vectors(t), "v", RING_JACOBIAN, by=BY, order="frame_no", ring="ring")
    return d.select("key", weighted("reconstruction").alias("weighted"))


@query("ln4_all_rings", f"WITH {RINGS}, d AS (SELECT key, c, sum(b * (volt[r + 1] - f)) AS y FROM f JOIN rv USING (key) JOIN j ON j.ring = f.ring AND j.r = f.r GROUP BY 1, 2) SELECT key, round(sum(y * (c + 1)), 5) AS weighted FROM rv LEFT JOIN d USING (key) GROUP BY 1".replace("USING (key) JOIN j ON j.ring = f.ring AND j.r = f.r", "USING (key, ring) JOIN j USING (ring, r)"))
def _(t):
    d = L.directions(ringed_vectors(t), voltage="volt", state="v", jacobian=RING_JACOBIAN, inverse=RING_INVERSE, ring="ring")
    return d.select("key", weighted("direction").alias("weighted"))


@query("ln5_all_rings", f"WITH {RINGS}, st AS (SELECT key, ring, c, sum(b * volt[r + 1]) AS y FROM rv JOIN j USING (ring) GROUP BY 1, 2, 3), p AS (SELECT key, r, sum(a * y) AS f FROM st JOIN j USING (ring, c) GROUP BY 1, 2) SELECT key, round(list_sum(list_transform(range(1, 9), lambda i: volt[i] * volt[i] / 8)), 6) AS mean_square_before, round(avg(pow(volt[r + 1] - f, 2)), 5) AS mean_square_after, (SELECT round(sum(y * (c + 1)), 5) FROM st WHERE st.key = rv.key) AS weighted FROM rv LEFT JOIN p USING (key) GROUP BY key, volt")
def _(t):
    d = L.first_step(ringed_vectors(t), voltage="volt", jacobian=RING_JACOBIAN, inverse=RING_INVERSE, ring="ring")
    return d.select("key", r6(F.col("residual_before") * F.col("residual_before")).alias("mean_square_before"), F.round(F.col("residual_after") * F.col("residual_after"), 5).alias("mean_square_after"), weighted("step").alias("weighted"))


@query("ln7_all_rings", f"WITH {RINGS}, q AS (SELECT key, r, sum(a * (x - 0.1)) AS f FROM s JOIN g USING (key) JOIN j USING (ring, c) GROUP BY 1, 2) SELECT key, round(sum((volt[r + 1] + f) * (r + 1)), 5) AS weighted FROM rv LEFT JOIN q USING (key) GROUP BY 1")
def _(t):
    d = ringed_vectors(t).withColumn("base", F.transform("v", lambda x: F.lit(0.1)))
    return L.linearised_voltage(d, state="v", baseline="base", voltage0="volt", jacobian=RING_JACOBIAN, ring="ring").select("key", weighted("voltage").alias("weighted"))


@query("ln12_all_rings", f"WITH {RINGS}, q AS (SELECT key, ring, r, sum(a * greatest(CASE WHEN isnan(x) THEN 0.5 ELSE x END, 0.01)) AS f FROM s JOIN g USING (key) JOIN j USING (ring, c) GROUP BY 1, 2, 3), e AS (SELECT q.ring, sqrt(avg(pow(volt[r + 1] - f, 2))) AS e FROM q JOIN rv USING (key) GROUP BY 1), n AS (SELECT ring, count(*) FILTER (WHERE x < 0.01) AS clipped FROM s GROUP BY 1) SELECT ring, round(e, 6) AS residual_rms, clipped FROM n LEFT JOIN e USING (ring)")
def _(t):
    d = ringed_vectors(t).withColumn("v", F.transform("v", lambda x: F.nanvl(x, F.lit(0.5))))  # a NaN would be all there is to see
    return L.dataset_residual(d, state="v", voltage="volt", jacobian=RING_JACOBIAN, floor=0.01, ring="ring").select("ring", r6("residual_rms").alias("residual_rms"), "clipped")


@query("ln13_all_rings", f"WITH {RINGS} SELECT key, frame_no // 50 AS \"group\", coalesce(bool_and(isfinite(f)), false) AS valid, round(sum(f * (r + 1)) FILTER (WHERE isfinite(f)), 5) AS weighted FROM rv LEFT JOIN f USING (key) GROUP BY 1, 2")
def _(t):
    d = L.batch_scores(ringed_vectors(t), RING_JACOBIAN, vector="v", order="frame_no", by=["key"], ring="ring")
    return d.select("key", "group", "valid", weighted("score").alias("weighted"))


@query("ln2_operators")
def _(t):
    q = t("lineitem").select((F.col("l_suppkey") % 4).alias("ring"), (F.col("l_orderkey") % 8).alias("channel"), (F.col("l_partkey") % 20).alias("elem_id"), F.col("l_discount").cast("double").alias("value"))
    reg = q.select("ring").distinct().select("ring", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("ring", "i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    return rounded(L.operators(q, reg, h=0.5, sign=-1.0), "ring", "elem_id", "channel")


@query("ln3_regularised_operators")
def _(t):
    q = t("lineitem").select((F.col("l_suppkey") % 4).alias("ring"), (F.col("l_orderkey") % 8).alias("channel"), (F.col("l_partkey") % 20).alias("elem_id"), F.col("l_tax").cast("double").alias("value"))
    reg = q.select("ring").distinct().select("ring", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("ring", "i", F.col("i").alias("j"), F.lit(2.0).alias("value"))
    return rounded(L.operators(q, reg, h=0.1, ridge=0.01), "ring", "elem_id", "channel")


def left_side(jacobian, x, diagonal):
    """(J'J + diagonal) X of each ring: what must equal J' (times the sign)."""
    j = jacobian.groupBy("ring", "channel", "elem_id").agg(F.sum("value").alias("j"))
    inner = j.withColumnRenamed("channel", "c2").join(x.withColumnRenamed("value", "x"), ["ring", "elem_id"]).groupBy("ring", "c2", "channel").agg(F.sum(F.col("j") * F.col("x")).alias("y"))
    outer = j.withColumnRenamed("channel", "c2").join(inner, ["ring", "c2"]).select("ring", "elem_id", "channel", (F.col("j") * F.col("y")).alias("value"))
    both = outer.unionByName(x.select("ring", "elem_id", "channel", (F.col("value") * diagonal).alias("value")))
    return both.groupBy("ring", "elem_id", "channel").agg(r6(F.sum("value")).alias("value"))


RIGHT = "WITH j AS (SELECT l_suppkey % 4 AS ring, l_orderkey % 8 AS channel, l_partkey % 20 AS elem_id, sum(CAST({} AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT DISTINCT ring FROM j), f AS (SELECT ring, c AS channel, e AS elem_id FROM k, range(8) x(c), range(20) y(e)) SELECT ring, elem_id, channel, round({} * coalesce(v, 0), 6) + 0.0 AS value FROM f LEFT JOIN j USING (ring, channel, elem_id)"


def ringed(t, value, weight):
    q = t("lineitem").select((F.col("l_suppkey") % 4).alias("ring"), (F.col("l_orderkey") % 8).alias("channel"), (F.col("l_partkey") % 20).alias("elem_id"), F.col(value).cast("double").alias("value"))
    i = q.select("ring").distinct().select("ring", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    return q, i.select("ring", "i", F.col("i").alias("j"), F.lit(weight).alias("value"))


@query("ln2_normal_equations", RIGHT.format("l_discount", "-1.0"))
def _(t):
    q, reg = ringed(t, "l_discount", 1.0)
    return left_side(q, L.operators(q, reg, h=0.5, sign=-1.0), 0.25).withColumn("value", F.col("value") + 0.0)


@query("ln3_normal_equations", RIGHT.format("l_tax", "1.0"))
def _(t):
    q, reg = ringed(t, "l_tax", 2.0)
    return left_side(q, L.operators(q, reg, h=0.1, ridge=0.01), 0.03).withColumn("value", F.col("value") + 0.0)


@query("ln4_directions", f"WITH {VECTORS}, {MATRICES}, {FORWARD}, d AS (SELECT key, c, sum(b * (v - f)) AS y FROM f JOIN v8 USING (key, r) JOIN j USING (r) GROUP BY 1, 2) SELECT key, round(sum(y * (c + 1)), 5) AS weighted FROM d GROUP BY 1")
def _(t):
    d = L.directions(t.vectors().withColumn("volt", F.slice("v", 1, 8)), voltage="volt", state="v", jacobian=JACOBIAN, inverse=INVERSE)
    return d.select("key", weighted("direction").alias("weighted"))


@query("ln5_first_step", f"WITH {VECTORS}, {MATRICES}, st AS (SELECT key, c, sum(b * v) AS y FROM v8 JOIN j USING (r) GROUP BY 1, 2), g AS (SELECT key, r, sum(a * y) AS f FROM st JOIN j USING (c) GROUP BY 1, 2) SELECT key, round(sqrt(avg(v * v)), 6) AS residual_before, round(sqrt(avg(pow(v - f, 2))), 5) AS residual_after, round(any_value(sr), 6) AS step_rms FROM g JOIN v8 USING (key, r) JOIN (SELECT key, sqrt(avg(y * y)) AS sr FROM st GROUP BY 1) USING (key) GROUP BY key")
def _(t):
    d = L.first_step(t.vectors().withColumn("volt", F.slice("v", 1, 8)), voltage="volt", jacobian=JACOBIAN, inverse=INVERSE)
    return d.select("key", r6("residual_before").alias("residual_before"), F.round("residual_after", 5).alias("residual_after"), r6("step_rms").alias("step_rms"))


@query("ln6_frame_solves")
def _(t):
    d = t.vectors().select("key", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 12 + 1, 12)).alias("jacobian"), F.slice("v", 50, 4).alias("residual"))
    lap = 2 * np.eye(12) - np.eye(12, k=1) - np.eye(12, k=-1)
    values, vectors = np.linalg.eigh(lap + 0.1 * np.eye(12))
    s = L.frame_solves(d, key="key", jacobian="jacobian", residual="residual", eigenvalues=values, eigenvectors=vectors)
    return s.select("key", r6(A.total("step")).alias("step_sum"), (F.col("backward_error") <= 1e-7).alias("exact"))


@query("ln6_normal_equations", f"WITH {VECTORS}, s AS (SELECT key, i, sum(v[c * 12 + i] * v[50 + c]) AS y FROM vectors, range(1, 13) a(i), range(4) b(c) GROUP BY 1, 2) SELECT key, i, round(y, 6) AS y FROM s")
def _(t):
    """(J'J + R) x of each frame, which must equal J'r."""
    d = t.vectors().select("key", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 12 + 1, 12)).alias("jacobian"), F.slice("v", 50, 4).alias("residual"))
    lap = 2 * np.eye(12) - np.eye(12, k=1) - np.eye(12, k=-1)
    values, vectors = np.linalg.eigh(lap + 0.1 * np.eye(12))
    s = L.frame_solves(d, key="key", jacobian="jacobian", residual="residual", eigenvalues=values, eigenvectors=vectors).join(d, "key")
    s = s.withColumn("_y", F.transform("jacobian", lambda r: A.dot(r, "step")))
    near = lambda i: F.coalesce(F.get("step", i), F.lit(0.0))
    total = lambda i: F.aggregate(F.zip_with("jacobian", "_y", lambda r, y: F.get(r, i) * y), F.lit(0.0), lambda a, x: a + x)
    y = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: total(i) + 2.1 * near(i) - near(i - 1) - near(i + 1))
    return s.select("key", F.posexplode(y).alias("i", "y")).select("key", (F.col("i") + 1).cast("long").alias("i"), r6("y").alias("y"))


@query("ln7_linearised_voltage", f"WITH {VECTORS}, {MATRICES}, g AS (SELECT key, r, sum(a * (x - 0.1)) AS f FROM s JOIN j USING (c) GROUP BY 1, 2) SELECT key, round(sum((v + f) * (r + 1)), 5) AS weighted FROM g JOIN v8 USING (key, r) GROUP BY 1")
def _(t):
    d = t.vectors().withColumn("v0", F.slice("v", 1, 8)).withColumn("base", F.array_repeat(F.lit(0.1), 64))
    return L.linearised_voltage(d, state="v", baseline="base", voltage0="v0", jacobian=JACOBIAN).select("key", weighted("voltage").alias("weighted"))


@query("ln8_amplitude_fit", f"WITH {VECTORS}, h AS (SELECT key, v[1:32] AS p, v[33:64] AS q FROM vectors), a AS (SELECT *, least(greatest(list_dot_product(p, q) / list_dot_product(p, p), 0), 0.2) AS amp FROM h) SELECT key, round(amp, 6) AS amplitude, round(sqrt(list_sum(list_transform(range(1, 33), lambda i: pow(q[i] - amp * p[i], 2)))), 6) AS residual FROM a")
def _(t):
    d = t.vectors().select("key", F.slice("v", 1, 32).alias("p"), F.slice("v", 33, 32).alias("q"))
    return L.amplitude_fit(d, predicted="p", voltage="q", most=0.2).select("key", r6("amplitude").alias("amplitude"), r6(A.norm("residual")).alias("residual"))


@query("ln9_shape_fit", f"WITH {VECTORS}, h AS (SELECT key, v[1:16] AS s, v[17:32] AS p, v[33:48] AS q, v[49:64] AS b FROM vectors), r AS (SELECT key, sqrt(list_dot_product(s, s) / 16) AS rms, p, list_transform(range(1, 17), lambda i: q[i] - b[i]) AS rest FROM h), a AS (SELECT *, least(greatest(list_dot_product(p, rest) / rms / (list_dot_product(p, p) / rms / rms), 0), 0.5) AS amp FROM r) SELECT key, round(amp, 6) AS amplitude, round(list_sum(list_transform(range(1, 17), lambda i: pow(rest[i] - amp * p[i] / rms, 2))) / list_dot_product(rest, rest), 6) AS relative_mse FROM a")
def _(t):
    d = t.vectors().select("key", *[F.slice("v", 1 + 16 * i, 16).alias(n) for i, n in enumerate("spqb")])
    return L.shape_fit(d, shape="s", predicted="p", voltage="q", base="b", most=0.5).select("key", r6("amplitude").alias("amplitude"), r6("relative_mse").alias("relative_mse"))


@query("ln10_context", f"WITH {VECTORS}, q AS (SELECT key, quantile_cont(abs(x), 0.95) AS p FROM (SELECT key, unnest(v) AS x FROM vectors) GROUP BY 1) SELECT key, round(list_sum(list_transform(v, lambda x, i: i * least(abs(x) / p, 5.0))), 5) AS weighted FROM vectors JOIN q USING (key)")
def _(t):
    return L.context(t.vectors(), "v").select("key", weighted("context").alias("weighted"))


@query("ln11_calibrated", f"WITH {VECTORS}, h AS (SELECT key, v[1:16] AS a, v[17:32] AS b, v[33:48] AS m FROM vectors) SELECT key, round(CASE WHEN abs(list_dot_product(b, m)) > 1e-30 THEN list_dot_product(b, m) / list_dot_product(m, m) ELSE 1 END, 6) AS inverse_alpha, round(list_sum(list_transform(range(1, 17), lambda i: abs((a[i] - m[i]) - (b[i] - m[i])))), 6) AS residual FROM h")
def _(t):
    d = t.vectors().select("key", F.slice("v", 1, 16).alias("a"), F.slice("v", 17, 16).alias("b"), F.slice("v", 33, 16).alias("m"))
    c = L.calibrated(d, voltage="a", reference="b", model0="m")
    return c.select("key", r6(F.try_divide(F.lit(1.0), "alpha")).alias("inverse_alpha"), r6(A.sum_of("differential", F.abs)).alias("residual"))


@query("ln12_dataset_residual", f"WITH {VECTORS}, {MATRICES}, g AS (SELECT key, r, sum(a * greatest(x, 0.01)) AS f FROM s JOIN j USING (c) GROUP BY 1, 2) SELECT round(sqrt(avg(pow(v - f, 2))), 6) AS residual_rms, (SELECT count(*) FROM s WHERE x < 0.01) AS clipped FROM g JOIN v8 USING (key, r)")
def _(t):
    d = L.dataset_residual(t.vectors().withColumn("volt", F.slice("v", 1, 8)), state="v", voltage="volt", jacobian=JACOBIAN, floor=0.01)
    return d.select(r6("residual_rms").alias("residual_rms"), "clipped")


@query("ln13_batch_scores", f"WITH {VECTORS}, {MATRICES}, {FORWARD} SELECT anatomy_id, frame_no, frame_no // 50 AS \"group\", true AS valid, round(sum(f * (r + 1)), 5) AS score FROM f JOIN vectors USING (key) GROUP BY 1, 2, 3")
def _(t):
    d = L.batch_scores(t.vectors(), JACOBIAN, vector="v", order="frame_no", by=BY)
    return d.withColumn("score", weighted("score"))


# -- templates and filters


LOW_B, LOW_A = (tuple(map(float, c)) for c in T.butterworth(3, 5.0, 50.0))
REST = tuple(map(float, T.steady_state(np.array(LOW_B), np.array(LOW_A))))


def pass_sql(name, source):
    """One pass of the filter over source (id, k from 0, x), sample by sample, from the state that its first sample would leave."""
    step = lambda z0, z1, z2: f"{LOW_B[0]} * s.x + {z0} AS y, {LOW_B[1]} * s.x - {LOW_A[1]} * ({LOW_B[0]} * s.x + {z0}) + {z1} AS z0, {LOW_B[2]} * s.x - {LOW_A[2]} * ({LOW_B[0]} * s.x + {z0}) + {z2} AS z1, {LOW_B[3]} * s.x - {LOW_A[3]} * ({LOW_B[0]} * s.x + {z0}) AS z2"
    rest = step(*[f"{z} * s.x" for z in REST])
    return f"{name} AS (SELECT s.id, s.k, {rest} FROM {source} s WHERE s.k = 0 UNION ALL SELECT s.id, s.k, {step('p.z0', 'p.z1', 'p.z2')} FROM {name} p JOIN {source} s ON s.id = p.id AND s.k = p.k + 1)"


@query("wn8_lowpass", f"""WITH RECURSIVE {FRAMES}, n AS (SELECT anatomy_id AS id, count(*) AS n, arg_min(x, frame_no) AS x0, arg_max(x, frame_no) AS x1 FROM frames GROUP BY 1), good AS (SELECT * FROM n WHERE n > 12),
ext AS MATERIALIZED (SELECT id, frame_no + 12 AS k, x FROM frames JOIN good ON id = anatomy_id UNION ALL SELECT id, 12 - frame_no, 2 * x0 - x FROM frames JOIN good ON id = anatomy_id WHERE frame_no BETWEEN 1 AND 12 UNION ALL SELECT id, 12 + n + (n - 2 - frame_no), 2 * x1 - x FROM frames JOIN good ON id = anatomy_id WHERE frame_no BETWEEN n - 13 AND n - 2),
{pass_sql("f1", "ext")}, back AS MATERIALIZED (SELECT id, n + 23 - k AS k, y AS x FROM f1 JOIN good USING (id)), {pass_sql("f2", "back")}
SELECT anatomy_id, frame_no, x, CASE WHEN n > 12 THEN round(y, 6) ELSE 'nan'::DOUBLE END AS filtered FROM frames JOIN n ON n.id = anatomy_id LEFT JOIN f2 ON f2.id = anatomy_id AND f2.k = n + 11 - frame_no""")
def _(t):
    return B.lowpass(t.frames(), "x", by=BY, order="frame_no", rate=50.0, block=16).withColumn("filtered", r6("filtered"))


def beats(t):
    return t.vectors().withColumn("beat_id", F.col("anatomy_id") * 1000 + F.floor(F.col("frame_no") / 10))


def shown(d, key):
    return d.select(key, F.round(A.norm("template"), 5).alias("norm"), weighted("template").alias("weighted"))


def leading_sql(name, rows):
    """The leading left vector u of each group of rows (g, f from 1, i, x): its products matrix, squared 24 times, is a multiple of u u'."""
    return f"""{name}_g AS (SELECT a.g, a.f AS f1, b.f AS f2, sum(a.x * b.x) AS x FROM {rows} a JOIN {rows} b ON a.g = b.g AND a.i = b.i GROUP BY 1, 2, 3), {name}_r AS (SELECT g, f1, list(x ORDER BY f2) AS r FROM {name}_g GROUP BY 1, 2), {name}_m AS (SELECT g, list(r ORDER BY f1) AS m FROM {name}_r GROUP BY 1),
{name}_p AS (SELECT g, 0 AS k, m FROM {name}_m UNION ALL SELECT g, k + 1, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / greatest(tr * tr, 1e-300))) FROM (SELECT *, list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS tr FROM {name}_p WHERE k < 24)),
{name}_j AS (SELECT g, m, list_position(d, list_max(d)) AS j FROM (SELECT g, m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {name}_p WHERE k = 24)), {name}_u AS (SELECT g, unnest(list_transform(m[j], lambda x: x / greatest(sqrt(m[j][j]), 1e-150))) AS u, unnest(range(1, len(m) + 1)) AS f FROM {name}_j)"""


def template_sql(group, peak):
    """Templates of beats: with u signed so that X'u has its largest loading positive, they are u at the chosen frame times X'u."""
    return f"""b AS (SELECT {group} AS g, anatomy_id, row_number() OVER (PARTITION BY anatomy_id * 1000 + frame_no // 10 ORDER BY frame_no) AS f, v FROM vectors), e AS (SELECT g, f, i, v[i] - avg(v[i]) OVER (PARTITION BY g, i) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM b)),
{leading_sql("le", "e")}, w AS (SELECT g, i, sum(x * u) AS w FROM e JOIN le_u USING (g, f) GROUP BY 1, 2), sg AS (SELECT g, CASE WHEN arg_max(w, (abs(round(w, 12)), -i)) >= 0 THEN 1 ELSE -1 END AS s FROM w GROUP BY 1), pk AS (SELECT g, {peak} AS p FROM le_u JOIN sg USING (g) GROUP BY 1), te AS (SELECT g, i, p * s * w AS x FROM w JOIN sg USING (g) JOIN pk USING (g))"""


BEAT_ID = "anatomy_id * 1000 + frame_no // 10"
PEAK = {"positive": "max(s * u)", "absolute": "arg_max(s * u, (round(abs(u), 12), -f))", "row": "arg_max(s * u, (round(abs(u), 12), -f))"}

for _name, _mode in (("wn14_beat_templates", "positive"), ("wn15_templates_absolute", "absolute"), ("wn15_templates_row", "row")):
    query(_name, f"WITH RECURSIVE {VECTORS}, {template_sql(BEAT_ID, PEAK[_mode])} SELECT g AS beat_id, round(sqrt(sum(x * x)), 5) AS norm, round(sum(x * i), 5) AS weighted FROM te GROUP BY 1")(
        lambda t, mode=_mode: shown(T.beat_templates(beats(t), "v", by=["beat_id"], order="frame_no", mode=mode), "beat_id")
    )


@query("wn16_group_templates", f"WITH RECURSIVE {VECTORS}, {template_sql(BEAT_ID, PEAK['positive'])}, sz AS (SELECT g, sqrt(sum(x * x)) AS n FROM te GROUP BY 1), un AS (SELECT te.g // 1000 AS g, dense_rank() OVER (PARTITION BY te.g // 1000 ORDER BY te.g) AS f, i, x / greatest(n, 1e-12) AS x FROM te JOIN sz USING (g)), {leading_sql('lu', 'un')}, gw AS (SELECT g, i, sum(x * u) AS w, sum(x) AS t FROM un JOIN lu_u USING (g, f) GROUP BY 1, 2), gs AS (SELECT g, CASE WHEN sum(w * t) >= 0 THEN 1 ELSE -1 END / sqrt(sum(w * w)) AS s FROM gw GROUP BY 1), gm AS (SELECT g // 1000 AS g, quantile_cont(n, 0.5) AS m FROM sz GROUP BY 1) SELECT g AS anatomy_id, round(sqrt(sum(pow(w * s * m, 2))), 5) AS norm, round(sum(w * s * m * i), 5) AS weighted FROM gw JOIN gs USING (g) JOIN gm USING (g) GROUP BY 1")
def _(t):
    b = T.beat_templates(beats(t), "v", by=["anatomy_id", "beat_id"], order="frame_no")
    return shown(T.group_templates(b, "anatomy_id"), "anatomy_id")


@query("wn17_centre_stability", f"WITH {FRAMES}, c AS (SELECT beat_id, least(x, 50) AS x0, CASE WHEN x < 50 OR x = 50 AND frame_no % 7 <= frame_no % 5 THEN frame_no % 7 ELSE frame_no % 5 END AS y0, greatest(x, 50) AS x1, CASE WHEN x < 50 OR x = 50 AND frame_no % 7 <= frame_no % 5 THEN frame_no % 5 ELSE frame_no % 7 END AS y1 FROM frames), s AS (SELECT beat_id, ((stddev_pop(x0) + stddev_pop(y0)) / 2 + (stddev_pop(x1) + stddev_pop(y1)) / 2) / 2 AS s FROM c GROUP BY 1) SELECT round(avg(s), 6) AS mean, round(max(s), 6) AS max FROM s")
def _(t):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    d = t.frames().withColumn("centres", F.array(point(F.col("x"), F.col("frame_no") % 7), point(F.lit(50), F.col("frame_no") % 5)))
    return rounded(T.centre_stability(d, beat="beat_id", centres="centres"))
