"""Queries of corpus building, sparse operators, meshes and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatframe.functions import arrays as A
from beatframe.operators import acquisition as Q
from beatframe.operators import corpus as C
from beatframe.operators import mesh as M
from beatframe.operators import select as S
from beatframe.plans.bindings import FPB, FRAMES, VECTORS
from beatframe.plans.check_queries import COO, coo
from beatframe.plans.frame_queries import COMPLETE, r6
from beatframe.plans.linear_queries import INVERSE
from beatframe.plans.metric_queries import mesh8, rounded
from beatframe.plans.registry import query

# -- corpus


@query("cb1_shard_compatibility", "WITH m AS (SELECT o_orderpriority AS shard, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderpriority, 'schema', 'v2' FROM orders) SELECT key, count(DISTINCT value) AS \"values\", count(DISTINCT shard) AS shards, count(DISTINCT value) = 1 AND count(DISTINCT shard) = (SELECT count(DISTINCT shard) FROM m) AS compatible FROM m GROUP BY key")
def _(t):
    o = t("orders")
    m = o.select(F.col("o_orderpriority").alias("shard"), F.lit("status").alias("key"), F.col("o_orderstatus").alias("value")).unionByName(o.select(F.col("o_orderpriority").alias("shard"), F.lit("schema").alias("key"), F.lit("v2").alias("value")))
    return C.shard_compatibility(m, ["status", "schema"])


@query("cb1_union_shards", "SELECT c_nationkey AS nation, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, s_suppkey FROM supplier")
def _(t):
    return C.union_shards(t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")), t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


IDS = "ids AS (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM orders), g AS (SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, o_custkey) - 1 AS global_id FROM ids)"


def ids(t):
    return C.global_ids(t("orders"), rank="o_orderstatus", shard="o_orderpriority", local="o_custkey")


@query("cb2_global_ids", f"WITH {IDS} SELECT * FROM g")
def _(t):
    return ids(t)


@query("cb3_remap_beats", f"WITH {IDS} SELECT o_orderkey, global_id AS anatomy_id, global_id * 5 + o_orderkey % 5 AS beat_id FROM orders JOIN g USING (o_orderstatus, o_orderpriority, o_custkey)")
def _(t):
    d = t("orders").withColumn("beat_id", F.col("o_orderkey")).withColumn("anatomy_id", F.col("o_custkey"))
    return C.remap_beats(d, ids(t), ["o_orderstatus", "o_orderpriority", "o_custkey"]).select("o_orderkey", "anatomy_id", "beat_id")


def gates(t):
    c = F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") < 24).alias("ok"))
    return t("nation").groupBy(F.col("n_regionkey").alias("shard")).agg(F.bool_and(F.col("n_nationkey") < 24).alias("verified"), F.collect_list(c).alias("comparisons"))


@query("cb4_merged_gate", "SELECT bool_and(n_nationkey < 24) AS verified FROM nation")
def _(t):
    return C.merged_gate(gates(t))[0]


@query("cb4_merged_comparisons", "SELECT n_regionkey AS shard, n_name AS name, n_nationkey < 24 AS ok FROM nation")
def _(t):
    return C.merged_gate(gates(t))[1]


def source(t):
    """Two components as one source: sigma is 3 v, the voltage its first eight values, the augmented voltage the next eight."""
    v = t.vectors().withColumn("beat_id", F.col("anatomy_id") * 1000 + F.floor(F.col("frame_no") / FPB)).withColumn("split", F.when(F.col("anatomy_id") < 3, "test").otherwise("train"))
    part = v.withColumn("volt", F.slice("v", 1, 8)).withColumn("other", F.slice("v", 9, 8))
    lp = part.withColumns({c: A.scaled(c, 2.0) for c in ("v", "volt", "other")})
    return C.summed_components(part, lp, ["key", "split", "anatomy_id", "beat_id", "frame_no"], {"sigma": "v", "voltage": "volt", "augmented": "other"})


def cohort_shown(d):
    return d.select("key", "split", r6(A.total("sigma")).alias("s"), r6(A.total("sigma_baseline")).alias("baseline"), F.round(A.sum_of("newton", F.abs), 5).alias("newton"))


NEWTON = "b AS (SELECT r, c, ((c * 5 + r * 3) % 7 - 3) / 20 AS b FROM range(8) x(r), range(64) y(c)), nw AS (SELECT key, round(sum(abs(y)), 5) AS newton FROM (SELECT key, c, sum(b * -3 * v[r + 1 + {}]) AS y FROM vectors, b WHERE anatomy_id < 3 GROUP BY 1, 2) GROUP BY 1)"


@query("cb5_differential_cohort", f"WITH {VECTORS}, {NEWTON.format(0)} SELECT key, CASE WHEN anatomy_id < 3 THEN 'test' ELSE 'train' END AS split, round(3 * list_sum(v), 6) AS s, CAST(round(0.7 * 64, 6) AS DOUBLE) AS baseline, newton FROM vectors LEFT JOIN nw USING (key)")
def _(t):
    return cohort_shown(C.differential_cohort(source(t), INVERSE, order="frame_no"))


@query("cb5_augmented_test", f"WITH {VECTORS}, {NEWTON.format(8)} SELECT key, 'test' AS split, round(3 * list_sum(v), 6) AS s, CAST(round(0.7 * 64, 6) AS DOUBLE) AS baseline, newton FROM vectors JOIN nw USING (key)")
def _(t):
    return cohort_shown(C.differential_cohort(source(t), INVERSE, order="frame_no", augmented=True))


@query("cb5_split_summary", f"WITH {VECTORS} SELECT CASE WHEN anatomy_id < 3 THEN 'test' ELSE 'train' END AS split, count(*) AS frames, count(DISTINCT anatomy_id) AS anatomies, count(DISTINCT anatomy_id * 1000 + frame_no // {FPB}) AS beats, round(3 * sqrt(sum(list_dot_product(v, v)) / (64 * count(*))), 6) AS truth_rms, round(3 * sqrt(sum(list_dot_product(v[1:8], v[1:8])) / (8 * count(*))), 6) AS voltage_rms, round(3 * sqrt(sum(list_dot_product(v[9:16], v[9:16])) / (8 * count(*))), 6) AS augmented_rms FROM vectors GROUP BY 1")
def _(t):
    return rounded(C.split_summary(source(t)), "split")


@query("cb6_one_anatomy_pack", f"WITH {FRAMES}, {COMPLETE} SELECT beat_id, frame_no, x FROM frames JOIN cb USING (anatomy_id, beat_id) WHERE anatomy_id = 5")
def _(t):
    return C.one_anatomy_pack(t.frames(), 5, fpb=FPB).select("beat_id", "frame_no", "x")


@query("cb7_replicate", f"WITH {FRAMES} SELECT frame_no, x, split FROM frames, (VALUES ('train'), ('validation'), ('test')) s(split) WHERE beat_id = 3001")
def _(t):
    return C.replicate(t.frames().filter("beat_id = 3001"), ["train", "validation", "test"]).select("frame_no", "x", "split")


@query("cb8_frame_records", f"WITH {FRAMES} SELECT anatomy_id, frame_no // 10 AS beat, frame_no % 10 AS sample_index, x AS amplitude FROM frames")
def _(t):
    a = A.wide(t.frames().select("anatomy_id", "frame_no", "x"), ["anatomy_id"], index="frame_no", vector="amplitudes")
    return C.frame_records(a, fpb=FPB).withColumn("sample_index", F.col("sample_index").cast("long"))


@query("cb9_combined_index", "SELECT c_custkey AS id, 'US060' AS ring FROM customer UNION ALL SELECT s_suppkey, 'US065' FROM supplier")
def _(t):
    return C.combined_index({"US060": t("customer").select(F.col("c_custkey").alias("id")), "US065": t("supplier").select(F.col("s_suppkey").alias("id"))})


@query("cb10_attach_prior", "SELECT p_partkey, CAST(0.6 AS DOUBLE) AS s, 'prior-v1' AS prior_meta FROM part")
def _(t):
    return C.attach_prior(t("part"), [0.1, 0.2, 0.3], "prior-v1").select("p_partkey", r6(A.total("prior")).alias("s"), "prior_meta")


def share(at, *place):
    """A number in [0, 1) from 13 hex digits of a draw's hash."""
    return f"(('0x' || substr(md5(concat_ws('|', '11', name, {', '.join(map(str, place))})), {at}, 13))::BIGINT / 4503599627370496.0)"


def normal(*place):
    return f"(sqrt(-2 * ln({share(1, *place)} + 1 / 4503599627370496.0)) * cos(2 * pi() * {share(14, *place)}))"


def curve_sql(name, effect, n):
    return f"""{name}_r AS (SELECT k, i, {normal(f"'{effect}'", 'i')} AS h FROM ks, range({n}) t(i)), {name}_m AS (SELECT k, i, h - avg(h) OVER (PARTITION BY k) AS h FROM {name}_r), {name} AS (SELECT k, list(h / p ORDER BY i) AS h FROM (SELECT *, greatest(max(abs(h)) OVER (PARTITION BY k), 1e-12) AS p FROM {name}_m) GROUP BY 1)"""


def height_sql(name, n):
    return f"{name}.h[lo_{name} + 1] + ({name}.h[lo_{name} + 2] - {name}.h[lo_{name} + 1]) * (p * {n - 1} - lo_{name})"


ACQUIRED = f"""{VECTORS}, el AS (SELECT anatomy_id AS k, '=' || anatomy_id AS name, frame_no, i - 1 AS c, v[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors)),
st AS (SELECT k, name, c, sqrt(avg(x * x)) AS rms, greatest(stddev_pop(x), 1e-7) AS sp, min(frame_no) AS f0, max(frame_no) AS f1 FROM el GROUP BY 1, 2, 3), ks AS (SELECT k, name, min(f0) AS f0, max(f1) AS f1, max(sp) AS sp, sqrt(sum(sp * sp)) AS size FROM st GROUP BY 1, 2),
ch AS (SELECT k, name, c, exp(0.02 * {normal("'gain'", 'c')}) AS gain, 1e-3 * rms * {normal("'offset'", 'c')} AS offs, {normal("'contact'", 'c')} AS contact, {normal("'common'", 'c')} AS raw, rms, sp FROM st),
cc AS (SELECT ch.*, raw / greatest(sqrt(sum(raw * raw) OVER (PARTITION BY k)), 1e-12) AS spatial FROM ch), cu AS (SELECT k, exp(0.01 * {normal("'current'")}) AS cur FROM ks),
{curve_sql("dr", "drift", 9)}, {curve_sql("co", "curve", 13)},
ev AS (SELECT k, name, sp, e, f0 + floor((f1 - f0 + 1) * {share(1, "'frame'", 'e')}) AS frame, 1 + floor(4 * {share(1, "'channels'", 'e')}) AS n FROM ks, range(3) t(e) WHERE {share(1, "'jumps'")} < 0.5 AND e < 1 + floor(3 * {share(1, "'how many'")})),
pk AS (SELECT ev.*, c, row_number() OVER (PARTITION BY ev.k, e ORDER BY {share(1, "'pick'", 'e', 'c').replace('name', 'ev.name')}, c) AS place FROM ev JOIN (SELECT k, c FROM st) s ON s.k = ev.k),
ju AS (SELECT k, e, frame, c, place, 3.0 * greatest(sp, 1e-12) * {normal("'jump'", 'e', 'c')} AS inc FROM pk WHERE place <= n)"""


def acquired(t):
    return Q.augment(t.vectors(), "v", key="anatomy_id", order="frame_no", seed=11, instrument=Q.Instrument(jump_chance=0.5))


def by_place(vector):
    return F.aggregate(F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


@query("cb11_augment", f"""WITH {ACQUIRED}, po AS (SELECT el.*, f1 > f0 AS many, coalesce((frame_no - f0) / nullif(f1 - f0, 0), 0) AS p, size FROM el JOIN ks USING (k, name)), lo AS (SELECT *, least(floor(p * 8), 7)::INTEGER AS lo_dr, least(floor(p * 12), 11)::INTEGER AS lo_co FROM po),
jf AS (SELECT k, frame AS frame_no, c, sum(inc) AS inc FROM ju GROUP BY 1, 2, 3),
y AS (SELECT lo.k, lo.frame_no, lo.c, cur * gain * x + offs + 1e-3 * rms * contact * ({height_sql("dr", 9)}) + 0.01 * size * spatial * ({height_sql("co", 13)}) + (0.02 * sp + 1e-7) * {normal("'white'", 'frame_no', 'c').replace('name', 'lo.name').replace("frame_no", "lo.frame_no").replace(", c)", ", lo.c)")} + coalesce(inc, 0) AS y
FROM lo JOIN cc ON cc.k = lo.k AND cc.c = lo.c JOIN cu ON cu.k = lo.k JOIN dr ON dr.k = lo.k JOIN co ON co.k = lo.k LEFT JOIN jf ON jf.k = lo.k AND jf.frame_no = lo.frame_no AND jf.c = lo.c)
SELECT k AS anatomy_id, frame_no, round(sum(y), 5) AS total, round(sum(y * (c + 1)), 4) AS weighted FROM y GROUP BY 1, 2""")
def _(t):
    return acquired(t)[0].select("anatomy_id", "frame_no", F.round(A.total("augmented"), 5).alias("total"), F.round(by_place("augmented"), 4).alias("weighted"))


@query("cb11_clean_part", f"WITH {ACQUIRED}, n AS (SELECT el.k, frame_no, el.c, cur * gain * x + offs AS y FROM el JOIN cc ON cc.k = el.k AND cc.c = el.c JOIN cu ON cu.k = el.k) SELECT k AS anatomy_id, frame_no, round(sum(y * (c + 1)), 5) AS weighted FROM n GROUP BY 1, 2")
def _(t):
    """What gains and offsets of the metadata make of the voltages: the part without noise, rebuilt from what was told."""
    d = t.vectors().join(acquired(t)[1], "anatomy_id")
    y = F.zip_with(F.zip_with("v", "channel_gain", lambda x, g: F.col("current_gain") * g * x), "static_offset", lambda x, o: x + o)
    return d.select("anatomy_id", "frame_no", F.round(by_place(y), 5).alias("weighted"))


@query("cb11_effects", f"WITH {ACQUIRED}, m AS (SELECT k, sum(gain * (c + 1)) AS gain, sum(offs * (c + 1)) AS offs, sum(contact * (c + 1)) AS contact, sum(spatial * (c + 1)) AS spatial FROM cc GROUP BY 1), j AS (SELECT k, count(DISTINCT e) AS events, sum(frame) FILTER (WHERE place = 1) AS frames, sum((e + 1) * (c + 1) * inc) AS inc FROM ju GROUP BY 1) SELECT k AS anatomy_id, round(cur, 6) AS current_gain, round(gain, 5) AS channel_gain, round(offs, 6) AS static_offset, round(contact, 4) AS drift_spatial, round(spatial, 5) AS correlated_spatial, coalesce(events, 0) AS events, coalesce(frames, 0)::BIGINT AS frames, round(coalesce(inc, 0), 4)::DOUBLE AS increments FROM cu JOIN m USING (k) LEFT JOIN j USING (k)")
def _(t):
    e = acquired(t)[1]
    jump = F.transform("artifact_events", lambda v, i: (i + 1) * F.aggregate(F.zip_with(v["channels"], v["increments"], lambda c, x: (c + 1) * x), F.lit(0.0), lambda s, x: s + x))
    return e.select(
        "anatomy_id", r6("current_gain").alias("current_gain"), F.round(by_place("channel_gain"), 5).alias("channel_gain"), r6(by_place("static_offset")).alias("static_offset"), F.round(by_place("drift_spatial"), 4).alias("drift_spatial"),
        F.round(by_place("correlated_spatial"), 5).alias("correlated_spatial"), F.size("artifact_events").cast("long").alias("events"), F.aggregate("artifact_events", F.lit(0).cast("long"), lambda s, v: s + v["frame"]).alias("frames"), F.round(A.total(jump), 4).alias("increments"),
    )


# -- sparse operators

X = "x AS (SELECT vec_id AS key, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS col FROM embeddings)"


@query("io6_zero_based", "SELECT l_partkey % 64 - 1 AS row, l_orderkey % 64 - 1 AS col, round(sum(CAST(l_discount AS DOUBLE)), 6) AS value FROM lineitem GROUP BY 1, 2")
def _(t):
    d = t("lineitem").select((F.col("l_orderkey") % 64).alias("row"), (F.col("l_partkey") % 64).alias("col"), F.col("l_discount").cast("double").alias("value"))
    return M.zero_based(d).withColumn("value", r6("value"))


@query("mg1_apply_sparse", f"WITH {COO}, {X} SELECT key, row, round(sum(value * x), 5) AS y FROM coo JOIN x USING (col) GROUP BY 1, 2")
def _(t):
    return M.apply_sparse(coo(t), t.vectors(), ["key"], "v").withColumn("y", F.round("y", 5))


#: Matrices of four rings with a null and a NaN entry, and frames of five rings: some hold a NaN or a null, some are short, some null.
RINGS = f"""{VECTORS}, coo AS (SELECT l_suppkey % 4 AS ring, l_orderkey % 48 AS row, l_partkey % 64 AS col, CASE WHEN l_orderkey % 48 = 7 AND l_partkey % 64 = 9 THEN 'nan'::DOUBLE WHEN l_orderkey % 48 = 11 AND l_partkey % 64 = 5 THEN NULL ELSE round(sum(CAST(l_discount AS DOUBLE)), 6) END AS value FROM lineitem GROUP BY 1, 2, 3),
x AS (SELECT key, ring, i - 1 AS col, CASE WHEN key % 11 = 0 AND i = 3 THEN 'nan'::DOUBLE WHEN key % 13 = 0 AND i IN (5, 6) THEN NULL ELSE v[i] END AS x FROM (SELECT key, key % 5 AS ring, v, unnest(range(1, CASE WHEN key % 17 = 0 THEN 4 ELSE 65 END)) AS i FROM vectors WHERE key % 19 <> 0))"""


def ring_coo(t):
    d = t("lineitem").groupBy((F.col("l_suppkey") % 4).alias("ring"), (F.col("l_orderkey") % 48).alias("row"), (F.col("l_partkey") % 64).alias("col")).agg(r6(F.sum(F.col("l_discount").cast("double"))).alias("value"))
    value = F.when((F.col("row") == 7) & (F.col("col") == 9), float("nan")).when((F.col("row") == 11) & (F.col("col") == 5), F.lit(None)).otherwise(F.col("value"))
    return d.withColumn("value", value)


def ring_frames(t):
    k = F.col("key")
    v = F.transform(F.slice("v", 1, F.when(k % 17 == 0, 3).otherwise(64)), lambda x, i: F.when((k % 11 == 0) & (i == 2), float("nan")).when((k % 13 == 0) & i.isin(4, 5), F.lit(None)).otherwise(x))
    return t.vectors().select("key", (k % 5).alias("ring"), F.when(k % 19 != 0, v).alias("v"))


@query("mg1_all_rings", f"WITH {RINGS} SELECT ring, key, row, round(sum(value * x), 5) AS y FROM coo JOIN x USING (ring, col) GROUP BY 1, 2, 3")
def _(t):
    return M.apply_sparse(ring_coo(t), ring_frames(t), ["ring", "key"], "v", ring="ring").withColumn("y", F.round("y", 5))


@query("mg2_all_rings", f"WITH {RINGS}, y AS (SELECT key, row AS p, sum(value * x) AS y FROM coo JOIN x USING (ring, col) GROUP BY 1, 2) SELECT k.key, p.p % 7 AS row, p.p // 7 AS col, round(coalesce(y, 'nan'::DOUBLE), 5) AS y FROM vectors k CROSS JOIN range(49) p(p) LEFT JOIN y ON y.key = k.key AND y.p = p.p")
def _(t):
    return M.raster(ring_coo(t), ring_frames(t), ["key"], "v", side=7, ring="ring").withColumn("y", F.round("y", 5)).withColumn("row", F.col("row").cast("long"))


@query("mg12_all_rings", f"WITH {RINGS}, un AS (SELECT ring, row, col, CASE WHEN row % 9 = 0 THEN value ELSE 1.0 / count(*) OVER (PARTITION BY ring, row) END AS value FROM coo), ok AS (SELECT ring, row FROM un GROUP BY 1, 2 HAVING abs(sum(value) - 1) <= 1e-9) SELECT ring, key, row, round(sum(value * x), 5) AS y FROM un JOIN ok USING (ring, row) JOIN x USING (ring, col) GROUP BY 1, 2, 3")
def _(t):
    from pyspark.sql import Window

    c = ring_coo(t)
    c = c.withColumn("value", F.when(F.col("row") % 9 == 0, F.col("value")).otherwise(1.0 / F.count("*").over(Window.partitionBy("ring", "row"))))
    return M.to_fine(c, ring_frames(t), ["ring", "key"], "v", atol=1e-9, ring="ring").withColumn("y", F.round("y", 5))


@query("mg2_raster", f"WITH {COO}, {X}, y AS (SELECT key, row AS p, sum(value * x) AS y FROM coo JOIN x USING (col) GROUP BY 1, 2) SELECT k.key, p.p % 9 AS row, p.p // 9 AS col, round(coalesce(y, 'nan'::DOUBLE), 5) AS y FROM (SELECT DISTINCT key FROM x) k CROSS JOIN range(81) p(p) LEFT JOIN y ON y.key = k.key AND y.p = p.p")
def _(t):
    return M.raster(coo(t), t.vectors(), ["key"], "v", side=9).withColumn("y", F.round("y", 5)).withColumn("row", F.col("row").cast("long"))


@query("mg3_categorical_raster", f"WITH {COO}, c AS (SELECT row AS p, col % 7 AS label, sum(value) AS w FROM coo GROUP BY 1, 2 HAVING sum(value) > 0), n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(w, 9) DESC, label) AS n FROM c) SELECT p.p, coalesce(label, 99) AS label FROM range(81) p(p) LEFT JOIN n ON n.p = p.p AND n.n = 1")
def _(t):
    labels = t.spark.range(64).select(F.col("id").alias("elem_id"), (F.col("id") % 7).alias("label"))
    return M.categorical_raster(coo(t), labels, background=99, pixels=81)


@query("mg4_gram", f"WITH {COO} SELECT a.col AS i, b.col AS j, round(sum(a.value * b.value), 4) AS value FROM coo a JOIN coo b USING (row) GROUP BY 1, 2")
def _(t):
    return M.gram(coo(t)).withColumn("value", F.round("value", 4))


#: A mesh on a grid of 50 nodes a row: a node and two elements for each part.
ELEMENTS = "el AS (SELECT 2 * p_partkey AS elem_id, p_partkey AS n0, p_partkey + 1 AS n1, p_partkey + 50 AS n2 FROM part UNION ALL SELECT 2 * p_partkey + 1, p_partkey + 1, p_partkey + 50, p_partkey + 51 FROM part), nd AS (SELECT p_partkey AS node_id, p_partkey % 50 / 10.0 AS x, p_partkey // 50 / 10.0 AS y, p_partkey % 3 = 0 AS is_boundary FROM part)"


def elements(t):
    p = F.col("p_partkey")
    low = t("part").select((2 * p).alias("elem_id"), p.alias("n0"), (p + 1).alias("n1"), (p + 50).alias("n2"))
    return low.unionByName(t("part").select((2 * p + 1).alias("elem_id"), (p + 1).alias("n0"), (p + 50).alias("n1"), (p + 51).alias("n2")))


def nodes(t):
    p = F.col("p_partkey")
    return t("part").select(p.alias("node_id"), (p % 50 / 10.0).alias("x"), (F.floor(p / 50) / 10.0).alias("y"), (p % 3 == 0).alias("is_boundary"))


PAIR = f"WITH {ELEMENTS}, n AS (SELECT elem_id, unnest([n0, n1, n2]) AS node FROM el), g AS (SELECT a.elem_id AS src, b.elem_id AS dst, count(DISTINCT node) AS k FROM n a JOIN n b USING (node) WHERE a.elem_id <> b.elem_id GROUP BY 1, 2)"


@query("mg5_adjacency_node", f"{PAIR} SELECT src, dst FROM g")
def _(t):
    return M.adjacency(elements(t))


@query("mg5_adjacency_edge", f"{PAIR} SELECT src, dst FROM g WHERE k = 2")
def _(t):
    return M.adjacency(elements(t), shared=2)


GEO = f"{ELEMENTS}, geo AS (SELECT elem_id, abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2 AS area, least(a.x, b.x, c.x) AS x0, greatest(a.x, b.x, c.x) AS x1, least(a.y, b.y, c.y) AS y0, greatest(a.y, b.y, c.y) AS y1, (a.x + b.x + c.x) / 3 AS cx, (a.y + b.y + c.y) / 3 AS cy FROM el JOIN nd a ON a.node_id = n0 JOIN nd b ON b.node_id = n1 JOIN nd c ON c.node_id = n2)"


@query("mg9_geometry", f"WITH {GEO} SELECT elem_id, round(area, 6) AS area, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1, round(cx, 6) AS cx, round(cy, 6) AS cy FROM geo")
def _(t):
    return rounded(M.geometry(nodes(t), elements(t)).drop("corners"), "elem_id")


@query("mg8_pixel_grid", f"WITH {ELEMENTS}, m AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM nd) SELECT p, round(a + (p // 6) * (b - a) / 6, 6) AS x0, round(a + (p // 6 + 1) * (b - a) / 6, 6) AS x1, round(d - (p % 6 + 1) * (d - c) / 6, 6) AS y0, round(d - (p % 6) * (d - c) / 6, 6) AS y1 FROM m, range(36) r(p)")
def _(t):
    return rounded(M.pixel_grid(nodes(t), 6).withColumn("p", F.col("p").cast("long")), "p")


@query("mg6_image_map", f"""WITH {ELEMENTS}, m AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM nd), px AS (SELECT p, a + (p // 12) * (b - a) / 12 AS x0, a + (p // 12 + 1) * (b - a) / 12 AS x1, d - (p % 12 + 1) * (d - c) / 12 AS y0, d - (p % 12) * (d - c) / 12 AS y1 FROM m, range(144) r(p)),
tr AS (SELECT elem_id, abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2 AS area, [a.x, b.x, c.x] AS xs, [a.y, b.y, c.y] AS ys FROM el JOIN nd a ON a.node_id = n0 JOIN nd b ON b.node_id = n1 JOIN nd c ON c.node_id = n2),
ed AS (SELECT elem_id, area, xs[i] AS xa, ys[i] AS ya, xs[i % 3 + 1] AS xb, ys[i % 3 + 1] AS yb FROM (SELECT *, unnest([1, 2, 3]) AS i FROM tr)),
st AS (SELECT elem_id, area, p, y0, y1, xa, ya, xb, yb, least(greatest(xa, x0), x1) AS u, least(greatest(xb, x0), x1) AS w FROM ed JOIN px ON greatest(xa, xb) > x0 AND least(xa, xb) < x1 WHERE xa <> xb),
hh AS (SELECT *, ya + (yb - ya) * (u - xa) / (xb - xa) AS h, ya + (yb - ya) * (w - xa) / (xb - xa) AS k FROM st),
lh AS (SELECT *, least(h, k) AS lo, greatest(h, k) AS hi FROM hh),
pc AS (SELECT elem_id, area, p, (w - u) * (CASE WHEN hi > lo THEN (greatest(least(hi, y0) - lo, 0) * y0 + greatest(least(hi, y1) - greatest(lo, y0), 0) * (greatest(lo, y0) + least(hi, y1)) / 2 + greatest(hi - greatest(lo, y1), 0) * y1) / (hi - lo) ELSE least(greatest(lo, y0), y1) END - y0) AS q FROM lh),
sh AS (SELECT p, elem_id, abs(sum(q)) / any_value(area) AS w FROM pc GROUP BY 1, 2 HAVING abs(sum(q)) / any_value(area) > 1e-9)
SELECT p AS row, elem_id AS col, round(w / sum(w) OVER (PARTITION BY p), 6) AS value FROM sh""")
def _(t):
    return M.image_map(nodes(t), elements(t), 12, cell=1.0).withColumn("value", r6("value"))


@query("mg7_outside", f"WITH {COO}, c AS (SELECT row FROM coo GROUP BY 1 HAVING sum(value) <> 0) SELECT p FROM range(81) r(p) WHERE p NOT IN (SELECT row FROM c)")
def _(t):
    return M.outside(coo(t), 81)


CIRCLE = "ct AS (SELECT avg(x) AS center_x, avg(y) AS center_y FROM nd WHERE is_boundary), ci AS (SELECT center_x, center_y, avg(sqrt(pow(x - center_x, 2) + pow(y - center_y, 2))) AS radius, quantile_cont(sqrt(pow(x - center_x, 2) + pow(y - center_y, 2)), 0.5) AS median FROM nd, ct WHERE is_boundary GROUP BY 1, 2)"


@query("mg10_domain_circle", f"WITH {ELEMENTS}, {CIRCLE} SELECT round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(radius, 6) AS radius FROM ci")
def _(t):
    return rounded(M.domain_circle(nodes(t)))


@query("mg10_domain_circle_median", f"WITH {ELEMENTS}, {CIRCLE} SELECT round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(median, 6) AS radius FROM ci")
def _(t):
    return rounded(M.domain_circle(nodes(t), median=True))


@query("mg11_element_positions", f"WITH {GEO}, {CIRCLE} SELECT elem_id, round((cx - center_x) / radius, 6) AS x, round((cy - center_y) / radius, 6) AS y, round(sqrt(pow((cx - center_x) / radius, 2) + pow((cy - center_y) / radius, 2)), 6) AS r FROM geo, ci")
def _(t):
    return rounded(M.element_positions(nodes(t), elements(t)), "elem_id")


UNIT = "un AS (SELECT row, col, CASE WHEN row % 9 = 0 THEN value ELSE 1.0 / count(*) OVER (PARTITION BY row) END AS value FROM coo)"


@query("mg12_to_fine", f"WITH {COO}, {UNIT}, ok AS (SELECT row FROM un GROUP BY 1 HAVING abs(sum(value) - 1) <= 1e-9), {X} SELECT key, row, round(sum(value * x), 5) AS y FROM un JOIN x USING (col) WHERE row IN (SELECT row FROM ok) GROUP BY 1, 2")
def _(t):
    from pyspark.sql import Window

    c = coo(t)
    c = c.withColumn("value", F.when(F.col("row") % 9 == 0, F.col("value")).otherwise(1.0 / F.count("*").over(Window.partitionBy("row"))))
    return M.to_fine(c, t.vectors(), ["key"], "v", atol=1e-9).withColumn("y", F.round("y", 5))


@query("mg13_chain_jacobian", f"WITH {COO}, f AS (SELECT l_linenumber AS channel, l_orderkey % 64 AS row, round(sum(CAST(l_tax AS DOUBLE)), 6) AS a FROM lineitem GROUP BY 1, 2) SELECT channel, col, round(sum(a * value), 4) AS value FROM f JOIN coo USING (row) GROUP BY 1, 2")
def _(t):
    f = t("lineitem").groupBy(F.col("l_linenumber").alias("channel"), (F.col("l_orderkey") % 64).alias("row")).agg(r6(F.sum(F.col("l_tax").cast("double"))).alias("value"))
    return M.chain_jacobian(f, coo(t)).withColumn("value", F.round("value", 4))


POS = f"{GEO}, {CIRCLE}, ps AS (SELECT elem_id, (cx - center_x) / radius AS x, (cy - center_y) / radius AS y, row_number() OVER (ORDER BY elem_id) - 1 AS i FROM geo, ci), es AS (SELECT s_suppkey, s_suppkey % 3 AS frame, s_suppkey // 3 % 2 AS slot, (s_suppkey % 9 - 4) / 8.0 AS ex, (s_suppkey % 7 - 3) / 8.0 AS ey, (s_suppkey % 5) / 5.0 AS an, 3 + s_suppkey % 4 AS lab FROM supplier)"
R2 = "pow((cos(an) * ({x} - ex) + sin(an) * ({y} - ey)) / 0.2, 2) + pow((cos(an) * ({y} - ey) - sin(an) * ({x} - ex)) / 0.1, 2)"
R2_AT = R2.format(x="x", y="y")


def ellipses(t):
    k = F.col("s_suppkey")
    return t("supplier").select(
        k.alias("order"), (k % 3).alias("frame"), (F.floor(k / 3) % 2).alias("slot"), ((k % 9 - 4) / 8.0).alias("center_x"), ((k % 7 - 3) / 8.0).alias("center_y"), F.lit(0.2).alias("radius_x"), F.lit(0.1).alias("radius_y"),
        (k % 5 / 5.0).alias("angle"), (3 + k % 4).cast("int").alias("ellipse_label"), (k % 4 / 10.0).alias("value"), F.lit(0.01).alias("delta"), F.lit(0.5).alias("amplitude"), F.lit(0.4).alias("diffusion_fraction"), F.lit(0.05).alias("diffusion_length"),
    )


@query("mg14_layered_field", f"""WITH {POS}, tu AS (SELECT elem_id, cos(0.3) * x + sin(0.3) * y AS x, cos(0.3) * y - sin(0.3) * x AS y FROM ps), rr AS (SELECT *, sqrt(x * x + y * y) AS r FROM tu),
h AS (SELECT elem_id, arg_max(lab, s_suppkey) AS lab, arg_max(s_suppkey % 4 / 10.0, s_suppkey) AS val, count(*) * 0.01 AS d FROM tu JOIN es ON {R2_AT} <= 1 GROUP BY 1)
SELECT elem_id, coalesce(lab, CASE WHEN r >= 0.8 THEN 3 WHEN r >= 0.5 THEN 2 ELSE 1 END)::INTEGER AS label, round(coalesce(val, CASE WHEN r >= 0.8 THEN 0.35 WHEN r >= 0.5 THEN 0.2 ELSE 0.5 END), 6)::DOUBLE AS baseline, round(coalesce(d, 0), 6)::DOUBLE AS delta, round(coalesce(val, CASE WHEN r >= 0.8 THEN 0.35 WHEN r >= 0.5 THEN 0.2 ELSE 0.5 END) + coalesce(d, 0), 6)::DOUBLE AS dynamic FROM rr LEFT JOIN h USING (elem_id)""")
def _(t):
    d = M.layered_field(M.element_positions(nodes(t), elements(t)), [(0.0, 1, 0.5), (0.5, 2, 0.2), (0.8, 3, 0.35)], ellipses(t), rotation=0.3)
    return rounded(d, "elem_id", "label")


@query("mg15_vessel_targets", f"WITH {POS}, d AS (SELECT frame, slot, elem_id, {R2_AT} AS r2 FROM ps, es) SELECT frame, elem_id, bool_or(r2 <= 1) AS hard, coalesce(bool_or(r2 <= 1) FILTER (WHERE slot = 0), false) AS core_0, coalesce(bool_or(r2 <= 1) FILTER (WHERE slot = 1), false) AS core_1, round(coalesce(max(exp(-0.5 * r2 / 1.5625)) FILTER (WHERE slot = 0), 0), 6) AS soft_0, round(coalesce(max(exp(-0.5 * r2 / 1.5625)) FILTER (WHERE slot = 1), 0), 6) AS soft_1 FROM d WHERE r2 <= 9 GROUP BY 1, 2")
def _(t):
    d = M.vessel_targets(M.element_positions(nodes(t), elements(t)), ellipses(t), "frame")
    return d.select("frame", "elem_id", "hard", *[F.col("cores")[i].alias(f"core_{i}") for i in (0, 1)], *[r6(F.col("soft")[i]).alias(f"soft_{i}") for i in (0, 1)])


@query("mg15_vessel_centres", f"WITH {POS} SELECT frame, count(*) AS n, round(sum(ex), 6)::DOUBLE AS x, round(sum(ey), 6)::DOUBLE AS y FROM es GROUP BY 1")
def _(t):
    add = lambda c: r6(F.aggregate("centres", F.lit(0.0), lambda s, v: s + v[c]))
    return M.vessel_centres(ellipses(t), "frame").select("frame", F.size("centres").cast("long").alias("n"), add("x").alias("x"), add("y").alias("y"))


def masks_shown(d):
    return d.select("frame", "first", F.posexplode("conductivity").alias("i", "conductivity")).select("frame", (F.col("first") + F.col("i")).alias("i"), r6("conductivity").alias("conductivity"))


@query("mg16_slot_masks", f"WITH {POS} SELECT frame, i, round(sum(0.5 / (1 + exp(least((({R2_AT}) - 1) / 0.05, 700)))), 6) AS conductivity FROM ps, es GROUP BY 1, 2")
def _(t):
    return masks_shown(M.slot_masks(M.element_positions(nodes(t), elements(t)), ellipses(t), "frame", parts=False))


@query("mg16_diffusion_masks", f"WITH {POS}, q AS (SELECT frame, i, elem_id, sqrt({R2_AT} + 1e-12) AS r FROM ps, es), c AS (SELECT *, 1 / (1 + exp(least((r * r - 1) / 0.05, 700))) AS core FROM q) SELECT frame, i, round(sum(0.5 * (core + 0.4 * (1 - core) * exp(-0.5 * pow(greatest(r - 1, 0) * sqrt(0.2 * 0.1) / 0.05, 2)) * CAST(elem_id % 2 = 0 AS INTEGER))), 6) AS conductivity FROM c GROUP BY 1, 2")
def _(t):
    p = M.element_positions(nodes(t), elements(t)).withColumn("gate", (F.col("elem_id") % 2 == 0).cast("double"))
    return masks_shown(M.slot_masks(p, ellipses(t), "frame", diffusion=True, parts=False))


@query("mg17_vessel_parameters", "WITH v AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 6)::DOUBLE AS rot, (l_partkey % 10) / 10.0 AS cx, (l_suppkey % 10) / 10.0 AS cy, (l_linenumber + 2)::DOUBLE AS angle, CAST(l_quantity AS DOUBLE) AS a FROM lineitem) SELECT l_orderkey, l_linenumber, false AS two, round(cx * cos(rot) - cy * sin(rot), 6) + 0.0 AS x, round(cx * sin(rot) + cy * cos(rot), 6) + 0.0 AS y, 0.3::DOUBLE AS axis_a, 0.2::DOUBLE AS axis_b, round(angle + rot - 2 * pi() * floor((angle + rot + pi()) / (2 * pi())), 6) AS angle, a / 50 AS amplitude, 0.25::DOUBLE AS diffusion_fraction, round(2.5 * sqrt(0.3 * 0.2) / (sqrt((l_linenumber + 1) * 2.0) * 0.8), 6) AS diffusion_length FROM v")
def _(t):
    d = t("lineitem")
    one = lambda **c: F.struct(*[(v if not isinstance(v, float) else F.lit(v)).cast("double").alias(k) for k, v in c.items()])
    v = one(center_x=F.col("l_partkey") % 10 / 10.0, center_y=F.col("l_suppkey") % 10 / 10.0, axis_a=0.3, axis_b=0.2, angle=F.col("l_linenumber") + 2)
    m = F.struct(F.array(one(radius_x_mm=F.col("l_linenumber") + 1, radius_y_mm=2.0, lumen_fraction=0.8)).alias("arteries"), F.lit(0.25).alias("muscle_diffusion_fraction"), F.lit(2.5).alias("muscle_diffusion_length_mm"))
    r = d.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 6).cast("double").alias("rotation"), F.array(v).alias("vessels"), F.array(F.col("l_quantity").cast("double")).alias("vessel_delta"), m.alias("simulator"))
    d = rounded(M.vessel_parameters(r, rotation="rotation", scale=50.0, diffusion=True).drop("slot"), "l_orderkey", "l_linenumber", "two")
    return d.withColumn("x", F.col("x") + 0.0).withColumn("y", F.col("y") + 0.0)


@query("mg18_ellipse_fit", "WITH g AS (SELECT l_returnflag, avg(x) AS center_x, avg(y) AS center_y, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x, (l_partkey % 31)::DOUBLE AS y FROM lineitem) GROUP BY 1) SELECT l_returnflag, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(sqrt(2 * ((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b))), 6) AS major, round(sqrt(2 * ((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b))), 6) AS minor, round(atan2(2 * b, a - c) / 2, 6) AS angle FROM g")
def _(t):
    d = t("lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), (F.col("l_partkey") % 31).cast("double").alias("y"))
    return rounded(M.ellipse_fit(d, ["l_returnflag"]), "l_returnflag")


COMPONENTS = """reach AS (SELECT frame, row, col, row AS r, col AS c FROM cells UNION SELECT a.frame, b.row, b.col, a.r, a.c FROM reach a JOIN cells b ON b.frame = a.frame AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1),
heads AS (SELECT frame, r AS row, c AS col, min(row * 1000 + col) AS head FROM reach GROUP BY 1, 2, 3), parts AS (SELECT frame, head, count(*) AS size, avg(row) AS row_mean, avg(col) AS col_mean FROM heads GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY size DESC, head) AS rank FROM parts)"""


@query("mg19_grid_components", f"WITH RECURSIVE cells AS (SELECT DISTINCT l_orderkey AS frame, l_partkey % 6 AS row, l_suppkey % 6 AS col FROM lineitem), {COMPONENTS} SELECT frame, CAST(rank AS INTEGER) AS rank, size, round(row_mean, 6) AS row_mean, round(col_mean, 6) AS col_mean FROM ranked WHERE rank <= 2")
def _(t):
    d = t("lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey") % 6, F.col("l_suppkey") % 6).toDF("frame", "row", "col")
    return rounded(M.grid_components(d, "frame"), "frame", "rank", "size")


@query("se12_visibility", f"""WITH RECURSIVE {VECTORS}, {COO}, cells AS (SELECT a.anatomy_id AS frame, p % 8 AS row, p // 8 AS col FROM (SELECT DISTINCT anatomy_id FROM vectors) a, range(64) r(p) WHERE (p * 7 + a.anatomy_id * 3) % 9 < 4), {COMPONENTS},
fb AS (SELECT *, sqrt(list_dot_product(v, v) / 64) AS rms FROM vectors WHERE frame_no < 10), pk AS (SELECT anatomy_id, arg_max(key, (rms, -frame_no)) AS key, arg_max(frame_no, (rms, -frame_no)) AS sample FROM fb GROUP BY 1 HAVING count(*) = 10),
im AS (SELECT pk.anatomy_id AS frame, coo.row AS p, abs(sum(coo.value * x.v[coo.col + 1])) AS y FROM pk JOIN vectors x USING (key), coo GROUP BY 1, 2), cr AS (SELECT h.frame, k.rank, max(y) AS peak FROM heads h JOIN ranked k USING (frame, head) JOIN im ON im.frame = h.frame AND im.p = h.col * 8 + h.row GROUP BY 1, 2),
l AS (SELECT k.*, peak FROM ranked k JOIN cr USING (frame, rank)), j AS (SELECT a.frame AS anatomy_id, a.size AS s1, b.size AS s2, sqrt(pow(a.row_mean - b.row_mean, 2) + pow(a.col_mean - b.col_mean, 2)) AS far, least(a.peak, b.peak) AS peak FROM l a JOIN l b ON a.frame = b.frame AND a.rank = 1 AND b.rank = 2)
SELECT anatomy_id, sample + 1 AS peak_sample, s1 AS lumen_1_pixels, s2 AS lumen_2_pixels, round(far, 6) AS centroid_distance, round(peak, 5) AS minimum_peak, round((100000.0 * s2 * peak + 100.0 * (anatomy_id + 1) + 10.0 * far) / 100000, 5) AS score FROM j JOIN pk USING (anatomy_id) WHERE peak >= 0.01""")
def _(t):
    v = t.vectors().select("anatomy_id", (F.col("anatomy_id") * 1000 + F.floor(F.col("frame_no") / FPB)).alias("beat_id"), (F.col("frame_no") % FPB).alias("sample_index"), F.col("v").alias("sigma"))
    ids = v.select("anatomy_id").distinct()
    p = ids.select("anatomy_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    labels = p.select("anatomy_id", (F.col("p") % 8).alias("row"), F.floor(F.col("p") / 8).cast("int").alias("col"), F.when((F.col("p") * 7 + F.col("anatomy_id") * 3) % 9 < 4, 6).otherwise(1).alias("label"))
    d = S.visibility(v, labels, coo(t), ids.select("anatomy_id", (F.col("anatomy_id") + 1.0).alias("least_area")), side=8, fpb=FPB)
    return d.select("anatomy_id", "peak_sample", "lumen_1_pixels", "lumen_2_pixels", r6("centroid_distance").alias("centroid_distance"), F.round("minimum_peak", 5).alias("minimum_peak"), F.round(F.col("score") / 100_000, 5).alias("score"))


@query("mg20_propagate", f"{PAIR}, f AS (SELECT elem_id AS node, fr.f AS frame, (elem_id * (fr.f + 1) % 17)::DOUBLE AS x FROM el, range(3) fr(f)), e AS (SELECT src, dst FROM g UNION SELECT elem_id, elem_id FROM el), dg AS (SELECT dst AS n, count(*) AS d FROM e GROUP BY 1) SELECT frame, e.dst AS node, round(sum(x / sqrt(a.d * b.d)), 5) AS y FROM e JOIN dg a ON a.n = e.dst JOIN dg b ON b.n = e.src JOIN f ON f.node = e.src GROUP BY 1, 2")
def _(t):
    e = elements(t)
    f = e.select(F.col("elem_id").alias("node"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("frame")).withColumn("x", (F.col("node") * (F.col("frame") + 1) % 17).cast("double"))
    return M.propagate(M.adjacency(e), f, "frame").withColumn("y", F.round("y", 5))


@query("mg21_node_features", f"""WITH {VECTORS}, m AS (SELECT key, v, list_transform(v, lambda x: CASE WHEN abs(x) > 0.1 THEN x / 0.25 ELSE 0.0 END) AS y, list_transform(range(1, 65), lambda i: CASE WHEN i % 4 = 0 THEN v[i] / 0.25 ELSE 0.0 END) AS r FROM vectors), z AS (SELECT *, list_transform(range(1, 65), lambda i: abs(y[i] - r[i])) AS d FROM m),
q AS (SELECT key, quantile_cont(a, 0.5) AS med FROM (SELECT key, unnest(list_filter(d, lambda x: x > 0)) AS a FROM z) GROUP BY 1)
SELECT z.key, round(list_sum(list_transform(range(1, 65), lambda i: v[i] / 0.25 * ((i - 1) % 8 - 3.5) / 4)), 5) AS state_x, round(list_sum(list_transform(range(1, 65), lambda i: -v[i] / 0.25 * ((i - 1) // 8 - 3.5) / 4)), 5) AS direction_y, round(list_sum(list_transform(d, lambda x: 1 + 3 * least(x / greatest(med, 1e-8), 2.0))), 5) AS weight, len(list_filter(d, lambda x: x <= 1e-8)) AS background, round(list_sum(y), 5) AS y, round(list_sum(v[1:8]) / 0.5, 5) AS voltage FROM z JOIN q ON z.key = q.key""")
def _(t):
    d = t.vectors().withColumn("y0", F.transform("v", lambda x: F.when(F.abs(x) > 0.1, x).otherwise(0.0))).withColumn("d", A.scaled("v", -1.0)).withColumn("r", F.transform("v", lambda x, i: F.when(i % 4 == 3, x).otherwise(0.0))).withColumn("volt", F.slice("v", 1, 8))
    f = M.node_features(d, mesh8(t), state="v", direction="d", target="y0", scale=0.25, alpha=3.0, reference="r", voltage="volt", voltage_scale=0.5)
    fold = lambda a, b: F.round(F.aggregate("features", F.lit(0.0), lambda s, e: s + e[a] * e[b]), 5)
    return f.select("key", fold("state", "x").alias("state_x"), fold("direction", "y").alias("direction_y"), F.round(A.total("weight"), 5).alias("weight"), F.size(F.filter("background", lambda b: b)).cast("long").alias("background"), F.round(A.total("y"), 5).alias("y"), F.round(A.total("voltage_scaled"), 5).alias("voltage"))


@query("mg22_beat_features", f"""WITH {VECTORS}, m AS (SELECT key, v, v[1:16] AS u, v[17:32] AS w, v[1:64] AS c FROM vectors), n AS (SELECT *, greatest(sqrt(list_dot_product(u, u) / 16), 1e-12) AS ru, greatest(sqrt(list_dot_product(w, w) / 16), 1e-12) AS rw FROM m), q AS (SELECT key, greatest(quantile_cont(abs(a), 0.95), 1e-12) AS p FROM (SELECT key, unnest(v) AS a FROM m) GROUP BY 1)
SELECT n.key, round(list_sum(list_transform(u, lambda x: greatest(least(x / ru, 8), -8))), 5) AS voltage, round(list_sum(list_transform(w, lambda x: greatest(least(x / rw, 8), -8))), 5) AS template, round(greatest(least(ln(ru / 1e-4), 5), -5), 6) AS log_rms, round(list_sum(list_transform(range(1, 65), lambda i: least(abs(v[i]) / p, 5) * ((i - 1) % 8 - 3.5) / 4)), 5) AS context_x, round(list_sum(list_transform(range(1, 65), lambda i: v[i] / 0.25 * 2)), 5) AS direction, CAST(len(list_filter(range(64), lambda i: i % 5 = 3)) AS DOUBLE) AS muscle FROM n JOIN q ON n.key = q.key""")
def _(t):
    d = t.vectors().withColumn("u", F.slice("v", 1, 16)).withColumn("w", F.slice("v", 17, 16)).withColumn("d", A.scaled("v", 2.0)).withColumn("tissue", F.transform("v", lambda x, i: i % 5))
    f = M.beat_features(d, mesh8(t), state="v", direction="d", voltage="u", template="w", context="v", tissue="tissue", scale=0.25, rms_reference=1e-4)
    fold = lambda c: F.round(F.aggregate("features", F.lit(0.0), lambda s, e: s + c(e)), 5)
    return f.select("key", F.round(A.total("voltage_input"), 5).alias("voltage"), F.round(A.total("template_input"), 5).alias("template"), r6("log_rms").alias("log_rms"), fold(lambda e: e["context"] * e["x"]).alias("context_x"), fold(lambda e: e["direction"]).alias("direction"), A.total("muscle_gate").alias("muscle"))


@query("mg22_global_features", f"WITH {VECTORS} SELECT key, round(list_sum(v[1:16]) / 0.5, 5) AS voltage, CAST(0 AS DOUBLE) AS log_rms, round(list_sum(list_transform(range(1, 65), lambda i: abs(v[i]) / 0.25 * ((i - 1) // 8 - 3.5) / 4)), 5) AS geometry_y, CAST(64 AS DOUBLE) AS muscle FROM vectors")
def _(t):
    d = t.vectors().withColumn("u", F.slice("v", 1, 16)).withColumn("d", F.col("v"))
    f = M.beat_features(d, mesh8(t), state="v", direction="d", voltage="u", scale=0.25, voltage_scale=0.5)
    return f.select("key", F.round(A.total("voltage_input"), 5).alias("voltage"), "log_rms", F.round(F.aggregate("geometry", F.lit(0.0), lambda s, e: s + e["direction"] * e["y"]), 5).alias("geometry_y"), A.total("muscle_gate").alias("muscle"))
