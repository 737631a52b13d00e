"""Queries of sources, sinks, scalar functions and the batch side of streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatframe.functions import arrays as A
from beatframe.operators import rollup as R
from beatframe.plans.bindings import FRAMES, PAIRS, VECTORS
from beatframe.plans.frame_queries import BY, r6
from beatframe.plans.metric_queries import rounded
from beatframe.plans.registry import query
from beatframe.sources import io as S
from beatframe.streaming import frames as ST


@query("io2_defaulted", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus END AS template FROM orders")
def _(t):
    d = t("orders").withColumn("template", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return S.defaulted(d, "template", "o_orderpriority").select("o_orderkey", "template")


@query("io5_preferred_file", "WITH f AS (SELECT o_custkey AS root, '/r/' || o_custkey || '/' || CASE o_orderstatus WHEN 'F' THEN 'summary.json' WHEN 'O' THEN 'a' || o_orderkey || '.json' ELSE 'report.json' END AS path, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS k FROM orders), n AS (SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY k, path) AS n FROM f) SELECT root, path FROM n WHERE n = 1")
def _(t):
    name = F.when(F.col("o_orderstatus") == "F", "summary.json").when(F.col("o_orderstatus") == "O", F.concat(F.lit("a"), "o_orderkey", F.lit(".json"))).otherwise("report.json")
    return S.preferred_file(t("orders").select(F.col("o_custkey").alias("root"), F.concat(F.lit("/r/"), "o_custkey", F.lit("/"), name).alias("path")))


@query("io10_frame_slice", f"WITH {FRAMES} SELECT anatomy_id, frame_no, x FROM frames WHERE frame_no BETWEEN 5 AND 24")
def _(t):
    return S.frame_slice(t.frames(), order="frame_no", start=5, n=20, by=BY)[0].select("anatomy_id", "frame_no", "x")


@query("io10_short_slices", f"WITH {FRAMES}, n AS (SELECT anatomy_id, count(*) FILTER (WHERE frame_no BETWEEN 50 AND 69) AS frames FROM frames GROUP BY 1) SELECT * FROM n WHERE frames < 20")
def _(t):
    return S.frame_slice(t.frames(), order="frame_no", start=50, n=20, by=BY)[1]


FINGERPRINT = "sha256(concat_ws(',', CAST(count(*) AS VARCHAR), " + ", ".join(f"CAST(coalesce(sum(('0x' || substr(h, {1 + 6 * i}, 6))::BIGINT), 0) AS VARCHAR)" for i in range(10)) + "))"


@query("io11_value_fingerprint", f"WITH h AS (SELECT sha256(concat_ws('|', length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey, length(o_orderstatus) || ':' || o_orderstatus, length(o_orderpriority) || ':' || o_orderpriority)) AS h FROM orders) SELECT {FINGERPRINT} AS fingerprint, count(*) AS rows FROM h")
def _(t):
    return S.value_fingerprint(t("orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("io12_sessions", "WITH f AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'Exercise' ELSE 'other' END AS s FROM orders WHERE o_orderkey % 3 <> 0) SELECT o_orderkey, 'subject' || (o_orderkey % 100) AS subject, lower(s) AS session, CAST(o_orderkey % 5 AS INTEGER) AS number, CASE lower(s) WHEN 'baseline' THEN 0 WHEN 'exercise' THEN 2 ELSE 4 END AS session_rank FROM f")
def _(t):
    s = F.when(F.col("o_orderstatus") == "F", "baseline").when(F.col("o_orderstatus") == "O", "Exercise").otherwise("other")
    good = F.concat(F.lit("/data/Subject"), F.col("o_orderkey") % 100, F.lit("_"), s, F.col("o_orderkey") % 5, F.lit(".h5"))
    d = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("/data/notes.txt")).otherwise(good).alias("path"))
    return S.sessions(d).drop("path")


@query("io14_transpose", f"WITH {VECTORS} SELECT key // 32 AS session, i - 1 AS frame_no, count(*) AS channels, round(sum(v[i] * (key % 32 + 1)), 5) AS s FROM (SELECT key, v, unnest(range(1, 65)) AS i FROM vectors) GROUP BY 1, 2")
def _(t):
    d = t.vectors().select(F.floor(F.col("key") / 32).alias("session"), (F.col("key") % 32).alias("channel"), "v")
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return S.transpose(d, by=["session"], channel="channel", vector="v").select("session", F.col("frame_no").cast("long").alias("frame_no"), F.size("v").cast("long").alias("channels"), F.round(weighted, 5).alias("s"))


@query("fn1_strings", "SELECT c_custkey, lower(regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 1)) AS head, CAST(regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) AS VARCHAR) AS tail, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded FROM customer")
def _(t):
    part = lambda i: F.regexp_extract("c_name", "([A-Za-z]+)#0*([0-9]+)", i)
    return t("customer").select("c_custkey", F.lower(part(1)).alias("head"), part(2).alias("tail"), F.format_string("%04d", F.col("c_nationkey").cast("int")).alias("padded"))


@query("fn2_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def _(t):
    return t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


@query("fn3_math", "SELECT event_id, round(sqrt(value), 6) AS a, round(exp(-value / 100), 6) AS b, round(ln(value + 1), 6) AS c, round(atan2(sin(value), cos(value)), 6) AS wrapped, round(sqrt(value * value + 9), 6) AS h, least(greatest(value, 5), 80) AS clipped FROM events")
def _(t):
    v = F.col("value")
    return t("events").select("event_id", r6(F.sqrt(v)).alias("a"), r6(F.exp(-v / 100)).alias("b"), r6(F.log(v + 1)).alias("c"), r6(F.atan2(F.sin(v), F.cos(v))).alias("wrapped"), r6(F.hypot(v, F.lit(3.0))).alias("h"), F.least(F.greatest(v, F.lit(5.0)), F.lit(80.0)).alias("clipped"))


@query("fn4_arrays", f"WITH {PAIRS} SELECT key, round(sum(p * t), 6) AS dot, round(sqrt(sum(p * p)), 6) AS norm, CAST(arg_max(i, (p, -i)) - 1 AS INTEGER) AS argmax, CAST(arg_min(i, (p, i)) - 1 AS INTEGER) AS argmin FROM el GROUP BY 1")
def _(t):
    return t.pairs().select("key", r6(A.dot("pred", "truth")).alias("dot"), r6(A.norm("pred")).alias("norm"), A.argmax("pred").alias("argmax"), A.argmin("pred").alias("argmin"))


@query("fn5_json", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), -1) AS missing, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS dumped FROM events")
def _(t):
    j = F.from_json("props", "k bigint, missing bigint")
    return t("events").select("event_id", F.coalesce(j["k"], F.lit(-1)).alias("k"), F.coalesce(j["missing"], F.lit(-1)).alias("missing"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("dumped"))


@query("fn6_maps", "WITH g AS (SELECT event_type, count(*)::DOUBLE AS n, max(value) AS top FROM events GROUP BY 1) SELECT event_type, 'n' AS metric, n AS value FROM g UNION ALL SELECT event_type, 'top', top FROM g")
def _(t):
    g = t("events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.max("value").alias("top"))
    m = g.select("event_type", F.create_map(F.lit("n"), "n", F.lit("top"), "top").alias("m"))
    return m.select("event_type", F.explode("m").alias("metric", "value"))


@query("st5_paired_outputs", f"WITH {FRAMES} SELECT anatomy_id AS session, frame_no, x AS value_a, 2 * x AS value_b FROM frames WHERE frame_no % 2 = 0")
def _(t):
    f = t.frames().select(F.col("anatomy_id").alias("session"), "frame_no", F.col("x").alias("value"))
    moved = F.col("frame_no") + F.when(F.col("frame_no") % 2 == 0, 0).otherwise(1_000_000)  # odd frames have no partner
    return ST.paired(f, f.withColumn("value", F.col("value") * 2).withColumn("frame_no", moved))


@query("st5_pairs_and_missing", f"WITH {FRAMES}, b AS (SELECT anatomy_id, frame_no + CASE WHEN frame_no % 3 = 1 THEN 1000000 ELSE 0 END AS frame_no, 2 * x AS x FROM frames) SELECT coalesce(a.anatomy_id, b.anatomy_id) AS session, coalesce(a.frame_no, b.frame_no) AS frame_no, a.x AS value_a, b.x AS value_b, CASE WHEN b.anatomy_id IS NULL THEN 'b' WHEN a.anatomy_id IS NULL THEN 'a' END AS missing FROM frames a FULL JOIN b ON a.anatomy_id = b.anatomy_id AND a.frame_no = b.frame_no")
def _(t):
    f = t.frames().select(F.col("anatomy_id").alias("session"), "frame_no", F.timestamp_seconds("frame_no").alias("ts"), F.col("x").alias("value"))
    b = f.withColumn("value", F.col("value") * 2).withColumn("frame_no", F.col("frame_no") + F.when(F.col("frame_no") % 3 == 1, 1_000_000).otherwise(0))
    return ST.live_pairs(f, b).select("session", "frame_no", "value_a", "value_b", "missing")


@query("st6_buffer_monitor", f"WITH {FRAMES}, b AS (SELECT anatomy_id AS session, frame_no // 10 AS b, count(*) AS n, sum(x) / 3700 AS s FROM frames GROUP BY 1, 2) SELECT session, round(avg(n / 50 + s), 6) AS first_output_s, round(avg(s), 6) AS compute_s, round(max(s), 6) AS worst_s, max(s / (n / 50)) <= 1 AS keeps_up FROM b GROUP BY 1")
def _(t):
    b = t.frames().groupBy(F.col("anatomy_id").alias("session"), F.floor(F.col("frame_no") / 10).alias("b")).agg(F.count("*").alias("frames"), (F.sum("x") / 3700).alias("compute_s"))
    return rounded(ST.buffer_monitor(b), "session")


@query("ag12_gate_table", "SELECT o_orderpriority AS architecture, 'clean' AS variant, count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_orderpriority, 'augmented', count(*)::DOUBLE FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def _(t):
    o = t("orders").withColumn("variant", F.when(F.col("o_orderstatus") == "F", "clean").otherwise("augmented"))
    g = o.groupBy(F.col("o_orderpriority").alias("architecture"), "variant").agg(F.count("*").cast("double").alias("n"))
    r = g.groupBy("architecture").agg(F.collect_list(F.struct(F.col("variant").alias("stage"), F.struct("n").alias("metrics"))).alias("stages"))
    return R.comparison_table(r, "architecture", "stages").withColumnRenamed("stage", "variant")
