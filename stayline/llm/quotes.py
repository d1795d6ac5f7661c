"""Quotation linking: conversations in reply order, without quotes, in DataFrame operations only.

Lines are parsed into a quote level (the leading ``>`` marks) and a body. Quoted passages (runs of lines of
one level) and their single lines are normalised and hashed, and joined, within the conversation, to the
first message that has the same passage or line as its own words. A message answers the earlier message that
most of its quotes of the lowest level come from (the later one at a tie); a message without a linked quote
stands for itself. Replies stand after what they answer.

No step gathers a conversation: lines are windowed by message, links are joined on (conversation, hash) with
one original for each hash, and positions come from counts of blocks of turns.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, spread_join, table

MARKS = r"^[ \t]{0,3}(?:>[ \t]?)+"
# The lines that mail programs put before a quote.
ATTRIBUTION = r"^(?:On .{1,200} wrote:|Le .{1,200} a écrit ?:|Am .{1,200} schrieb .{0,100}:|El .{1,200} escribió:)\s*$"
#: Turns that make a block when positions are counted.
BLOCK_TURNS = 1024


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">")))


def normalised(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse_lines(messages: DataFrame) -> DataFrame:
    """``(message columns, line_no, level, body)`` of every line; attribution lines are left out."""
    lines = messages.select("*", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).drop("text")
    return lines.where(~F.col("line").rlike(ATTRIBUTION)).select(
        *(c for c in lines.columns if c != "line"),
        quote_level(F.col("line")).alias("level"),
        F.regexp_replace("line", MARKS, "").alias("body"),
    )


def passages(lines: DataFrame, key: list[str]) -> DataFrame:
    """``(key, level, hash, words)``: runs of lines of one level as a whole, and their lines."""
    w = Window.partitionBy(*key).orderBy("line_no")
    runs = lines.withColumn("new", F.coalesce((F.lag("level").over(w) != F.col("level")).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(w))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), "\n")
    whole = runs.groupBy(*key, "level", "run").agg(ordered.alias("body"))
    both = whole.select(*key, "level", "body").union(lines.select(*key, "level", "body"))
    return (
        both.withColumn("body", normalised(F.col("body")))
        .where("body != ''")
        .select(*key, "level", F.xxhash64("body").alias("hash"), F.size(F.split("body", " ")).alias("words"))
        .distinct()
    )


def own_text(text: Column) -> Column:
    """The message without quoted and attribution lines; blank lines at its ends go."""
    kept = F.filter(F.split(text, "\n"), lambda x: (quote_level(x) == 0) & ~x.rlike(ATTRIBUTION))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, message, reply_to, n_passages, n_linked, max_level)`` of the messages that quote."""
    key = ["conv_id", "turn", "message"]
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]{0,3}>")).select("conv_id").distinct()
    # only conversations in which somebody quotes are taken apart
    lines = parse_lines(messages.join(quoting, "conv_id", "left_semi"))
    units = materialize(passages(lines, key), "passages")
    first = units.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quotes = units.where("level > 0").join(first, ["conv_id", "hash"], "left")
    quotes = quotes.withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    by_origin = quotes.groupBy(*key, "origin", "level").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    best = F.max(
        F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("near"), "words", "origin"))
    )
    return by_origin.groupBy(*key).agg(
        best["origin"].alias("reply_to"),
        F.sum("n").alias("n_passages"),
        F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
        F.max("level").cast("long").alias("max_level"),
    )


def thread_roots(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(conv_id, turn, root)``: the first turn of each reply chain, by doubling the jumps.

    ``links`` has one row for each (conv_id, turn). A turn that a whole conversation answers is a hot key of the join,
    which is therefore spread over pieces of files.
    """
    jumps = materialize(links.select("conv_id", "turn", F.col("reply_to").alias("root")), "threads")
    for _ in range(max_rounds):
        further = jumps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"))
        targets = jumps.select("conv_id", "root").distinct().join(further, ["conv_id", "root"], "left")
        moved = materialize(spread_join(jumps, ["conv_id", "root"], targets), "threads")
        jumps = moved.select("conv_id", "turn", F.coalesce("further", "root").alias("root"))
        if moved.where("further is not null").limit(1).count() == 0:
            return jumps
        jumps = materialize(jumps, "threads")
    raise RuntimeError("reply chains did not settle; raise max_rounds")


def rows_before(placed: DataFrame) -> DataFrame:
    """``(conv_id, root, block, before)``: how many rows of the conversation come before each block.

    A block holds the turns of one root inside BLOCK_TURNS turns, so a root that a whole conversation answers is many
    blocks. Blocks are summed inside sections of BLOCK_TURNS roots, and the sections inside the conversation.
    """
    blocks = placed.groupBy("conv_id", "root", "block").agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("section", F.floor(F.col("root") / BLOCK_TURNS))
    sections = blocks.groupBy("conv_id", "section").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("section")) - F.col("n")
    sections = sections.select("conv_id", "section", earlier.alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("conv_id", "section").orderBy("root", "block")) - F.col("n")
    blocks = blocks.withColumn("inside", inside)
    same = blocks["conv_id"].eqNullSafe(sections["conv_id"]) & blocks["section"].eqNullSafe(sections["section"])
    return blocks.join(sections, same).select(
        blocks["conv_id"], "root", "block", (F.col("earlier") + F.col("inside")).alias("before")
    )


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, reply_to, root, position, n_passages, n_linked, max_level, text, copies)``.

    One row for each different (conv_id, turn, role, text); ``copies`` says how often it came. Null texts count
    as empty. Null conversation ids or turns are messages without place: they stay, unlinked, and are ordered
    as Spark orders nulls. Messages of one turn are ordered by role and text; each has the links of its own quotes, and
    whoever answers such a turn follows the earliest link of its messages. ``position`` counts from 0
    within the conversation. An empty table gives an empty result; other columns are ignored.
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    messages = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    messages = materialize(messages.withColumn("message", F.xxhash64("role", "text")), "messages")
    links = materialize(link_quotes(messages.drop("copies", "role")), "quotes")
    answers = links.where("reply_to is not null")
    roots = thread_roots(answers.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to")))
    targets = answers.select("conv_id", "reply_to").distinct().join(roots.withColumnRenamed("turn", "reply_to"), ["conv_id", "reply_to"], "left")
    rooted = spread_join(answers, ["conv_id", "reply_to"], targets).select("conv_id", "turn", "message", "root")
    key = ["conv_id", "turn", "message"]
    placed = (
        messages.join(links, key, "left")
        .join(rooted, key, "left")
        .drop("message")
        .withColumn("root", F.coalesce("root", "reply_to", "turn"))
        .withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
        .withColumn("role_order", F.coalesce("role", F.lit("")))
    )
    before = rows_before(placed)
    within = Window.partitionBy("conv_id", "root", "block").orderBy("turn", "role_order", "role", "text")
    placed = placed.withColumn("place", F.row_number().over(within) - 1)
    same = reduce(and_, (placed[c].eqNullSafe(before[c]) for c in ("conv_id", "root", "block")))
    return placed.join(before, same).select(
        placed["conv_id"],
        "turn",
        "role",
        "reply_to",
        placed["root"],
        (F.col("before") + F.col("place")).cast("long").alias("position"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"),
        own_text(F.col("text")).alias("text"),
        "copies",
    )


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))
