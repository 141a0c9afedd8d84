"""Operator 5: quotation linking of conversations, with DataFrame functions only.

Quote levels are parsed from the marks at the beginning of lines.  A passage is a run of lines of one level without a
blank line; it and each of its lines are normalised (lower case, letters and digits of words joined by single spaces) and hashed, and a message's
quoted passages are joined to the unquoted passages of earlier messages of its conversation.  A message replies to
the latest message that its shallowest linked quote comes from; threads are what replies connect.  Sorting by
``thread_root, turn`` gives each conversation in reply order, originals before replies.

Work is done for conversations with quotes only, passages are made distinct before they are joined, and the join is an
as-of lookup by a running maximum, so a passage that a thousand messages share costs a thousand rows, not a million.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

QUOTED = r"^\\s*>"


def _normal(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def _passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, unit``: distinct passages and lines, normalised."""
    parsed = messages.select("conv_id", "turn", "key", F.posexplode(F.split("text", "\n")).alias("n", "line")).select(
        "conv_id",
        "turn",
        "key",
        "n",
        F.length(F.regexp_replace(F.regexp_extract("line", r"^((?:\s*>)*)", 1), r"\s", "")).alias("level"),
        F.regexp_replace("line", r"^(?:\s*>)*\s*", "").alias("body"),
    )
    blank = "(body rlike '^\\\\s*$')"
    order = Window.partitionBy("conv_id", "turn", "key").orderBy("n")
    begins = F.expr(f"{blank} or lag(level) over (partition by conv_id, turn, key order by n) <> level or coalesce(lag(body) over (partition by conv_id, turn, key order by n) rlike '^\\\\s*$', true)")
    runs = parsed.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(order)).where(f"not {blank}")
    whole = runs.groupBy("conv_id", "turn", "key", "level", "run").agg(F.sort_array(F.collect_list(F.struct("n", "body"))).alias("lines"))
    whole = whole.select("conv_id", "turn", "level", F.expr(_normal("array_join(transform(lines, x -> x.body), ' ')")).alias("unit"))
    lines = runs.select("conv_id", "turn", "level", F.expr(_normal("body")).alias("unit"))
    return whole.unionByName(lines).where("unit <> ''").distinct()


def link(messages: DataFrame) -> DataFrame:
    """Every row of ``messages`` (conv_id, turn, role, text) with its quotes taken out and its place in the thread.

    Columns: ``conv_id, turn, role, text`` (without quoted lines; null stays null), ``quoted_lines``, ``quote_depth``,
    ``linked_passages``, ``reply_to`` (a turn, or null) and ``thread_root`` (the turn that replies lead back to; its own for
    messages that reply to none).  Quotes without an original are removed and counted but link nothing.  Messages with a null
    conv_id or turn keep their quote counts and link nothing.  Repeated rows each get the same result; of messages that share a
    turn, a quote refers to the turn.  An empty table gives no rows; other columns are not read.
    """
    source = messages.select("conv_id", "turn", "role", "text")
    quoted = f"filter(split(text, '\\n'), x -> x rlike '{QUOTED}')"
    rows = source.select(
        "*",
        F.expr(f"coalesce(size({quoted}), 0)").alias("quoted_lines"),
        F.expr(f"coalesce(array_max(transform({quoted}, x -> length(regexp_replace(regexp_extract(x, '^((?:\\\\s*>)*)', 1), '\\\\s', '')))), 0)").alias("quote_depth"),
        F.expr(f"array_join(filter(split(text, '\\n'), x -> not x rlike '{QUOTED}'), '\\n')").alias("clean"),
    )
    usable = rows.where("conv_id is not null and turn is not null and text is not null")
    talks = usable.where("quoted_lines > 0").select(F.col("conv_id").alias("c_")).distinct()
    within = usable.join(talks, F.col("conv_id") == F.col("c_"), "left_semi")
    within = within.select("conv_id", "turn", F.xxhash64("role", "text").alias("key"), "text").distinct()
    units = stage(_passages(within).withColumn("hash", F.sha2("unit", 256)).select("conv_id", "turn", "level", "hash"), "passages")
    quotes = units.where("level > 0").select("conv_id", "hash").distinct()
    asked = units.join(quotes.withColumnsRenamed({"conv_id": "c_", "hash": "h_"}), (F.col("conv_id") == F.col("c_")) & (F.col("hash") == F.col("h_")), "left_semi")
    # The latest earlier turn that has the passage as its own words.
    order = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = asked.withColumn("origin", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(order)).where("level > 0 and origin is not null")
    best = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("linked_passages"), F.expr("min_by(origin, struct(level, -origin))").alias("reply_to")
    )
    best = stage(best, "replies")
    roots = _roots(best.select("conv_id", "turn", F.col("reply_to").alias("root")))
    found = best.join(roots, ["conv_id", "turn"]).select(F.col("conv_id").alias("c_"), F.col("turn").alias("t_"), "linked_passages", "reply_to", "root")
    joined = rows.join(found, (F.col("conv_id") == F.col("c_")) & (F.col("turn") == F.col("t_")), "left")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.col("clean").alias("text"),
        F.col("quoted_lines").cast("long").alias("quoted_lines"),
        F.col("quote_depth").cast("long").alias("quote_depth"),
        F.coalesce("linked_passages", F.lit(0)).cast("long").alias("linked_passages"),
        "reply_to",
        F.coalesce("root", "turn").alias("thread_root"),
    )


def _roots(replies: DataFrame) -> DataFrame:
    """Follow replies to their ends, twice as far in each round."""
    now = replies
    while True:
        onward = now.select(F.col("conv_id").alias("c_"), F.col("turn").alias("t_"), F.col("root").alias("next"))
        joined = now.join(onward, (F.col("conv_id") == F.col("c_")) & (F.col("root") == F.col("t_")), "left")
        now = stage(joined.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")
