import random

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def messy() -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, copies, repeated rows, repeated and null ids."""
    passage, line = prose(1, 60), "  Shared LINE é of many  "
    rows = [(i, f"{line}\n{prose(100 + i, 40)}\nown {i}") for i in range(14)]
    rows += [(20, None), (21, ""), (22, " \t\n "), (23, "word"), (24, "a b c d")]
    rows += [(30, prose(7, 30_000)), (31, f"{prose(8, 50)} {passage} {prose(9, 50)}"), (32, f"{passage}\n\n  {prose(10, 40)}")]
    rows += [(40, prose(11, 200)), (41, prose(11, 200)), (42, prose(11, 200) + " more"), (43, prose(11, 200))]
    rows += [(50, "x " * 100), (51, "a" * 5000), (52, prose(12, 30) + " " + prose(12, 30))]
    rows += [(60, "twice the row"), (60, "twice the row"), (61, prose(13, 80)), (61, prose(14, 80))]
    rows += [(None, prose(15, 50)), (None, prose(16, 50)), (None, None)]
    rows += [(70, "ünïcode   ça va 日本語 " * 20), (71, "\x00nul\x00 and \x1c odd\x85 blanks　here")]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(messy(), "doc_id long, text string").repartition(5)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with columns of the names that operators use inside or return."""
    from pyspark.sql import functions as F

    names = ["d", "th", "z", "a", "b", "id", "ids", "n_lines", "n_words", "score", "shard", "slot", "spans", "kept"]
    return documents.withColumns({n: F.lit("given") for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
