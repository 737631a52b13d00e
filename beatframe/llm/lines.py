"""Line dedup by how many distinct sites a line spreads over."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatframe.llm.common import stored, table


def spread_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10, lg_k: int = 11) -> DataFrame:
    """row (struct of all columns of docs), kept (the text that is left), n_lines and n_removed.

    A line's HyperLogLog sketch of sites is made by aggregation on its hash (two 64-bit hashes). An estimate
    within five standard errors of min_sites is replaced by an exact count of distinct sites; other
    estimates decide alone. A line on min_sites sites or more is boilerplate: every occurrence goes but the
    first (least key, then least text hash, then least position), so that no content is lost.

    Lines are parts between newlines, with spaces trimmed for comparison; blank lines always stay.
    Null sites are one site. Null texts stay null, with no lines; empty texts have one blank line; texts of
    any length are read whole. Repeated rows share their fate. Null keys come first. Columns of docs can have
    any names. Empty table: no rows.
    """
    k = F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63)))
    lines = docs.select(k.alias("k"), F.xxhash64(docs[text]).alias("t"), F.coalesce(docs[site].cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(docs[text], "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter(F.col("line") != "").select("k", "t", "pos", "site", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("line"), "line").alias("g"))
    found = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("k", "t", "pos")).alias("first"))
    band = 5 * 1.04 / math.sqrt(1 << lg_k)
    found = found.filter(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).filter(F.col("sites") >= math.floor(min_sites * (1 - band))).drop("sketch")
    found = stored(found)  # a table of its own, so that the joins can split a line that a third of all texts have
    near = F.col("sites") <= math.ceil(min_sites * (1 + band))
    exact = lines.join(found.filter(near).select("h", "g"), ["h", "g"]).groupBy("h", "g", "site").count().groupBy("h", "g").agg(F.count("*").alias("exact"))
    spread = stored(found.join(exact, ["h", "g"], "left").filter(F.coalesce("exact", "sites") >= min_sites).select("h", "g", "first"))
    gone = lines.join(spread, ["h", "g"]).filter(F.struct("k", "t", "pos") != F.col("first")).groupBy("k", "t").agg(F.collect_set("pos").alias("gone"))
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), k.alias("k"), F.xxhash64(docs[text]).alias("t")).join(gone, ["k", "t"], "left")
    parts = F.split(F.col(f"row.{text}"), "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(F.col("gone"), i))
    # array_contains over a null array is null, hence the two cases
    return row.select(
        "row",
        F.when(F.col("gone").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(kept, "\n")).alias("kept"),
        F.when(F.col(f"row.{text}").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op7_lines(spark, sf_dir: str) -> DataFrame:
    """spread_lines over all documents; see there."""
    out = spread_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
