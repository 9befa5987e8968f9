"""Questions to prompts: retrieve passages, join them, fill the template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import context, search


def dense_prompts(
    docs: DataFrame, questions: DataFrame, k: int = context.CONTEXT_K, template: str | None = None
) -> DataFrame:
    """(query_id, prompt) from docs (doc_id, text, embedding), questions (query_id, text,
    embedding)."""
    hits = search.dense_topk(docs, questions, k)
    found = search.payload_for(hits, docs.select("doc_id", "text"), k * questions.count())
    return context.prompts(found, questions, template or context.PLANNER_PROMPT, k)


def chat_requests(
    turns: DataFrame, system_text: str, asked=None, block: int = context.BLOCK
) -> DataFrame:
    """The whole history at each asked turn (default: user turns) as ``messages``.

    The system turn comes first, nothing from the stop turn on. ``block`` is the size of the
    pieces that histories are stored in; it does not change the result.
    """
    ready = context.with_system_turn(context.until_stop(turns, block=block), system_text)
    asked = F.col("role") == "user" if asked is None else asked
    return context.whole_history(ready, asked, block).drop("block")
