"""Chat formatting in budgeted windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.llm.common import stored, table

#: Each control character of the template, and what stands for it inside roles and texts.
ESCAPES = {"\\": "\\e", "<": "\\l", "[": "\\b", "|": "\\p"}
END, CLOSE = "</s>", "|>\n"


def escape(c: Column) -> Column:
    for raw, code in ESCAPES.items():
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES.items()):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def words(c: Column) -> Column:
    """A turn's length: its words, and two for its marks."""
    return F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")) + 2


def format_chat(conversations: DataFrame, *, budget: int = 512, history_turns: int = 2, history_tokens: int = 128, tokens=words, turns_per_block: int = 256) -> DataFrame:
    """Windows of at most budget tokens: conv_id, window_no, formatted, loss_spans (start and length in
    code points), n_tokens, n_turns, over_budget.

    Prefix sums of turn tokens cut a conversation into cells of what the budget leaves beside the system
    turn and the history. The turns that lie whole in a cell are a window; a turn that crosses a cell's
    border is a window alone, so that no turn is cut. Later windows repeat the system turn and, within
    history_turns and history_tokens, the turns before them; repeated turns are marked r and have no loss.
    Every assistant text is a target once. over_budget marks windows whose one turn exceeds the budget.

    Prefix sums are taken over blocks of turn numbers and then inside each, so a very long conversation
    doesn't go through one task. Null texts and roles are empty; null turns come first; ties go by role,
    then text; repeated rows are turns of their own; rows with null conv_id are one conversation. Texts
    of any length are whole in one window. Extra columns are ignored. Empty table: no rows.
    """
    key, far = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")), -(1 << 62)
    t = conversations.select(
        key.alias("k"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / turns_per_block), F.lit(far)).alias("block"),
    ).withColumn("tok", tokens(F.col("text")).cast("long"))
    past = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("k", "block").agg(F.count("*").alias("n"), F.sum("tok").alias("s")).select("k", "block", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(past), F.lit(0)).alias("s0"))
    inside = Window.partitionBy("k", "block").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(blocks, ["k", "block"]).withColumn("idx", F.col("n0") + F.row_number().over(inside) - 1).withColumn("pre", F.col("s0") + F.coalesce(F.sum("tok").over(before), F.lit(0))).withColumn("next_tok", F.lead("tok").over(inside))
    t = stored(t)  # four branches read it
    system = t.filter((F.col("idx") == 0) & (F.col("role") == "system")).select("k", F.col("tok").alias("sys_tok"), F.col("text").alias("sys_text"))
    t = t.join(system.drop("sys_text"), "k", "left").withColumn("has_sys", F.col("sys_tok").isNotNull()).withColumn("sys_tok", F.coalesce("sys_tok", F.lit(0)))
    room = F.greatest(F.lit(budget) - F.col("sys_tok") - history_tokens, F.lit(1))
    start = F.floor((F.col("pre") - F.col("sys_tok")) / room)
    end = F.greatest(start, F.floor((F.col("pre") + F.col("tok") - F.col("sys_tok") - 1) / room))
    is_sys = F.col("has_sys") & (F.col("idx") == 0)
    t = t.withColumn("cell", start * 2 + (end > start).cast("long")).withColumn("cell", F.when(is_sys, F.coalesce((F.floor((F.col("next_tok") - 1) / room) > 0).cast("long"), F.lit(0))).otherwise(F.col("cell")))  # the system turn stays with the next
    own = t.select("k", "conv_id", "cell", "idx", F.lit("t").alias("kind"), "role", "text", "tok")
    spans = t.groupBy("k", "cell").agg(F.min("conv_id").alias("conv_id"), F.min("idx").alias("first"), F.min("pre").alias("first_pre"), F.max("has_sys").alias("has_sys"), F.max("sys_tok").alias("sys_tok"))
    parts = [own]
    if history_turns:
        before_first = F.explode(F.sequence(F.col("first") - history_turns, F.col("first") - 1)).alias("idx")
        near = t.filter(~is_sys).select("k", "idx", "pre", "role", "text", "tok").join(spans.select("k", before_first, "cell", "conv_id", "first_pre"), ["k", "idx"]).filter(F.col("pre") >= F.col("first_pre") - history_tokens)
        parts.append(near.select("k", "conv_id", "cell", "idx", F.lit("r").alias("kind"), "role", "text", "tok"))
    again = spans.filter(F.col("has_sys") & (F.col("first") > 0)).join(system.select("k", "sys_text"), "k")
    parts.append(again.select("k", "conv_id", "cell", F.lit(0).cast("long").alias("idx"), F.lit("r").alias("kind"), F.lit("system").alias("role"), F.col("sys_text").alias("text"), F.col("sys_tok").alias("tok")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("head", F.concat(F.lit("<|"), "kind", F.lit(":"), escape(F.col("role")), F.lit(CLOSE))).withColumn("body", escape(F.col("text")))
    turns = F.array_sort(F.collect_list(F.struct("idx", "kind", "role", "head", "body", "tok")))
    out = rows.groupBy("k", "cell").agg(F.min("conv_id").alias("conv_id"), turns.alias("turns"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def add(acc, x):
        after = acc["at"] + F.length(x["head"])
        target = (x["kind"] == "t") & (x["role"] == "assistant")
        span = F.array(F.struct(after.alias("start"), F.length(x["body"]).alias("length")))
        return F.struct((after + F.length(x["body"]) + len(END)).alias("at"), F.when(target, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    used = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tok"])
    return out.select(
        "conv_id", F.col("cell").alias("window_no"), F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", zero, add)["spans"].alias("loss_spans"), used.alias("n_tokens"), F.size("turns").alias("n_turns"), (used > budget).alias("over_budget"),
    )


def read_chat(windows: DataFrame) -> DataFrame:
    """What the formatted windows hold, by conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Reads the strings and loss spans alone. A conversation's digest needs its text in order in one row, so
    the last grouping gathers a conversation's windows; nothing else does.
    """
    block = F.filter(F.split("formatted", END, -1), lambda b: b != "")
    turn = F.transform(block, lambda b: F.struct(
        F.substring(b, 3, 1).alias("kind"),
        unescape(F.substring_index(F.substring(b, 5, 1 << 30), CLOSE, 1)).alias("role"),
        unescape(b.substr(F.length(F.substring_index(b, CLOSE, 1)) + len(CLOSE) + 1, F.lit(1 << 30))).alias("text"),
    ))
    own = F.filter("parsed", lambda x: x["kind"] == "t")
    w = windows.select("conv_id", "window_no", "loss_spans", "formatted", turn.alias("parsed")).select(
        "conv_id", "window_no", F.size(own).alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform(own, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "").alias("loss"),
    )
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window_no", "said", "loss"))).alias("ws"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("loss")).alias("loss_chars"))
    joined = lambda f: F.array_join(F.transform("ws", lambda x: x[f]), "")
    return g.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"), F.col("loss_chars").cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """format_chat over all conversations and one that says the marks of other templates, read back from the strings; see there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_chat(format_chat(c.unionByName(added)))
