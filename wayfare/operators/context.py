"""Prompt contexts and conversation histories.

A history is kept in blocks of a fixed number of turns. A turn carries the messages of its own
block up to itself and the number of that block; earlier blocks are stored once, so sizes stay
linear and a very long conversation spreads over many tasks. The whole history of the turns that
are asked for is put together from these; the size of a block never shows in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.text import sentence, strip

# Word that ends a conversation, separator of context passages, result sizes.
STOP_WORD = "exit"
PASSAGE_BREAK = "\n\n"
CONTEXT_K = 5
BLOCK = 64

# Default wording of the planning request; callers may pass their own.
PLANNER_PROMPT = """Plan a Hong Kong trip day by day: sights and events, transport, costs and local
tips. Use the passages below.

Wanted: {query}

Passages:
{context}
"""


def join_ordered(df: DataFrame, by, order: list[str], body: str, sep: str, out: str) -> DataFrame:
    """Texts of a bounded group (top-k hits, pieces of one text) joined in order."""
    keys = [by] if isinstance(by, str) else list(by)
    pieces = F.sort_array(F.collect_list(F.struct(*order, F.col(body).alias("_t"))))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(pieces, lambda p: p["_t"]), sep).alias(out)
    )


def prompts(
    hits: DataFrame, queries: DataFrame, template: str = PLANNER_PROMPT, k: int = CONTEXT_K
) -> DataFrame:
    """(query_id, prompt): the texts of the first k hits put into a template with the query."""
    context = join_ordered(
        hits.filter(F.col("rank") <= k), "query_id", ["rank"], "text", PASSAGE_BREAK, "context"
    )
    filled = sentence(template, query=F.col("query"), context=F.col("context"))
    asked = queries.select("query_id", F.col("text").alias("query"))
    return asked.join(context, "query_id", "left").select("query_id", filled.alias("prompt"))


def split_oversize(df: DataFrame, keys: list[str], body: str, size: int) -> DataFrame:
    """(*keys, pos, piece): texts longer than ``size`` cut into pieces, others whole."""
    # One pass of the pattern; the pieces are exploded without the text beside them.
    pieces = F.regexp_extract_all(F.col(body), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    whole = F.when(F.col(body) == "", F.array(F.lit(""))).otherwise(pieces)
    whole = F.coalesce(whole, F.array(F.lit(None).cast("string")))
    return df.select(*keys, F.posexplode(whole).alias("pos", "piece"))


def rejoin(pieces: DataFrame, keys: list[str], sep: str = "") -> DataFrame:
    """Pieces of each text joined in position order."""
    return join_ordered(pieces, keys, ["pos"], "piece", sep, "text")


def block_number(block: int) -> Column:
    """Block of a turn; a system turn set before turn 0 belongs to the first block."""
    return F.floor(F.greatest(F.col("turn"), F.lit(0)) / F.lit(block)).cast("bigint")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    return turns.withColumn("block", block_number(block))


def history(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each turn with ``block`` and ``messages``: its block's messages up to and with itself."""
    upto = (
        Window.partitionBy("conv_id", "block")
        .orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    messages = F.collect_list(F.struct("role", "text")).over(upto)
    return _blocks(turns, block).withColumn("messages", messages)


def history_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, first_turn, messages): every block once, at most ``block`` messages."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return (
        _blocks(turns, block)
        .groupBy("conv_id", "block")
        .agg(F.min("turn").alias("first_turn"), ordered.alias("m"))
        .select(
            "conv_id",
            "block",
            "first_turn",
            F.transform("m", lambda x: F.struct(x["role"], x["text"])).alias("messages"),
        )
    )


def latest_blocks(fragments: DataFrame) -> DataFrame:
    """(conv_id, block, messages) from the turns of ``history`` or its stream: the longest of each."""
    seen = fragments.filter(F.col("messages").isNotNull())
    return seen.groupBy("conv_id", "block").agg(F.max_by("messages", "turn").alias("messages"))


def tree_nodes(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, level, node): the nodes that hold exactly the blocks before ``block``.

    Node n of level l stands for blocks n * 2^l to (n + 1) * 2^l - 1. One node for each binary digit 1
    of the block's number, so the logarithm of the length of a history.
    """
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(F.col("block"), i) == 1)
    at = blocks.select("conv_id", "block").distinct().select("conv_id", "block", F.explode(digits).alias("level"))
    return at.withColumn("node", F.expr("shiftright(block, level)") - 1)


def history_tree(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, level, node, messages): each of ``nodes`` that holds any block, once.

    Blocks learn first, without their messages, in which asked nodes they stand: in at most one of each
    level, and no level beyond the highest one asked for in their conversation.
    """
    asked = nodes.select("conv_id", "level", "node").distinct()
    top = asked.groupBy("conv_id").agg(F.max("level").alias("top"))
    levels = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")
    places = blocks.select("conv_id", F.col("block").alias("b")).join(top, "conv_id").select("conv_id", "b", levels)
    places = places.withColumn("node", F.expr("shiftright(b, level)"))
    places = places.join(asked, ["conv_id", "level", "node"])
    texts = blocks.select("conv_id", F.col("block").alias("b"), "messages")
    parts = F.array_sort(F.collect_list(F.struct("b", "messages")))
    held = places.join(texts, ["conv_id", "b"]).groupBy("conv_id", "level", "node").agg(parts.alias("parts"))
    whole = F.flatten(F.transform("parts", lambda p: p["messages"])).alias("messages")
    return held.select("conv_id", "level", "node", whole)


def with_earlier(fragments: DataFrame, blocks: DataFrame) -> DataFrame:
    """``fragments`` with ``messages`` from the first turn of the conversation on.

    The blocks before a block are joined once for all its turns, as nodes of a binary tree of blocks: as
    many rows as the logarithm of their number.
    """
    nodes = tree_nodes(fragments)
    parts = F.array_sort(F.collect_list(F.struct(F.expr("shiftleft(node, level)").alias("b"), "messages")))
    before = (
        nodes.join(history_tree(blocks, nodes), ["conv_id", "level", "node"])
        .groupBy("conv_id", "block")
        .agg(parts.alias("parts"))
        .select("conv_id", "block", F.flatten(F.transform("parts", lambda p: p["messages"])).alias("before"))
    )
    joined = fragments.join(before, ["conv_id", "block"], "left")
    none = F.array().cast(fragments.schema["messages"].dataType)
    whole = F.concat(F.coalesce("before", none), "messages")
    return joined.withColumn("messages", whole).select(*fragments.columns)


def whole_history(turns: DataFrame, asked: Column | None = None, block: int = BLOCK) -> DataFrame:
    """The turns for which ``asked`` holds (default: all), each with its whole history."""
    own = history(turns, block)
    own = own if asked is None else own.filter(asked)
    return with_earlier(own, history_blocks(turns, block))


def render(messages) -> Column:
    """``role: text`` lines of a message array."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n"
    )


def until_stop(turns: DataFrame, stop: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Turns before the first stop turn of their conversation.

    The first stop is found per block, carried forward over the blocks of a conversation, and
    joined back by block, so no task handles a whole conversation.
    """
    if stop is None:
        stop = F.lower(strip("text")) == STOP_WORD
    blocks = _blocks(turns, block)
    stops = blocks.groupBy("conv_id", "block").agg(
        F.min(F.when(stop, F.col("turn"))).alias("stop")
    )
    before = (
        Window.partitionBy("conv_id")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    first = stops.withColumn("stop", F.min("stop").over(before))
    kept = blocks.join(first, ["conv_id", "block"]).filter(
        F.col("stop").isNull() | (F.col("turn") < F.col("stop"))
    )
    return kept.select(*turns.columns)


def with_system_turn(turns: DataFrame, system_text: str) -> DataFrame:
    """A system turn -1 for every conversation that has no system turn."""
    lacking = turns.groupBy("conv_id").agg(
        F.max((F.col("role") == "system").cast("int")).alias("has")
    )
    added = lacking.filter("has = 0").select(
        "conv_id",
        F.lit(-1).cast("bigint").alias("turn"),
        F.lit("system").alias("role"),
        F.lit(system_text).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(added)
