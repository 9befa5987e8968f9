"""Caption texts to records: drop empty, ask the model, parse, flatten."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wayfare.operators import curate, extract


def records_from_captions(
    captions: DataFrame, model, answer: str = "answer"
) -> tuple[DataFrame, DataFrame]:
    """(records with ``path`` and ``pos``, rejects) from (path, transcript).

    ``model`` turns pandas batches of (path, prompt) into batches of (path, answer). Empty
    transcripts never reach it; they and unparseable answers are the rejects.
    """
    filled, empty = curate.split_filled(captions, "transcript")
    asked = extract.extraction_prompts(filled).select("path", "prompt")
    answers = extract.run_model(asked, model, f"path string, {answer} string")
    parsed, bad = extract.parse_outputs(answers, answer)
    rejects = bad.unionByName(empty.select("path"), allowMissingColumns=True)
    return extract.flatten_records(parsed, ["path"]), rejects
