from pyspark.sql import functions as F

from wayfare.operators import context, encode, extract
from wayfare.plans import answer, extraction

TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_blocks_and_turns_give_the_whole_history(frame):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{c}-{t}") for c in (1, 2) for t in range(11)]
    turns = frame(rows, TURNS)
    blocks = {}
    for r in context.history_blocks(turns, 4).collect():
        blocks[(r["conv_id"], r["block"])] = [m["text"] for m in r["messages"]]
    assert all(len(b) <= 4 for b in blocks.values())
    for r in context.history(turns, 4).collect():
        earlier = [x for b in range(r["block"]) for x in blocks[(r["conv_id"], b)]]
        seen = earlier + [m["text"] for m in r["messages"]]
        assert seen == [f"m{r['conv_id']}-{t}" for t in range(r["turn"] + 1)]


def test_nothing_from_the_stop_turn_on(frame):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 5, "user", "　EXIT "), (1, 6, "user", "x")]
    rows += [(2, 0, "user", "exit now"), (2, 9, "user", "exit"), (2, 10, "user", "exit")]
    got = context.until_stop(frame(rows, TURNS), block=2)
    assert sorted((r["conv_id"], r["turn"]) for r in got.collect()) == [(1, 0), (1, 1), (2, 0)]


def test_system_turn_first_and_once(frame):
    rows = [(1, 0, "user", "hi"), (2, 0, "system", "own"), (2, 1, "user", "ho"), (2, 2, "assistant", "x")]
    got = answer.chat_requests(frame(rows, TURNS), "Be brief.").collect()
    seen = {(r["conv_id"], r["turn"]): [m["text"] for m in r["messages"]] for r in got}
    assert seen == {(1, 0): ["Be brief.", "hi"], (2, 1): ["own", "ho"]}


def test_long_conversations_keep_their_whole_history(frame):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(130)]
    rows += [(2, t, "user", f"n{t}") for t in (0, 5, 70, 200)]
    for block in (2, 64):
        got = answer.chat_requests(frame(rows, TURNS), "Be brief.", block=block).collect()
        seen = {(r["conv_id"], r["turn"]): [m["text"] for m in r["messages"]] for r in got}
        assert len(seen) == 65 + 4
        for t in range(0, 130, 2):
            assert seen[(1, t)] == ["Be brief.", *[f"m{x}" for x in range(t + 1)]]
        assert seen[(2, 200)] == ["Be brief.", "n0", "n5", "n70", "n200"]


def test_chunks_rejoin_in_position_order(frame):
    rows = [(1, "x" * 7 + "茶" * 6), (2, ""), (3, "abc"), (4, "y" * 25)]
    df = frame(rows, "id bigint, text string")
    pieces = context.split_oversize(df, ["id"], "text", 5)
    assert pieces.filter("id = 4").count() == 5
    assert sorted(map(tuple, context.rejoin(pieces.orderBy(F.rand(1)), ["id"]).collect())) == rows


def test_prompt_keeps_rank_order(frame):
    hits = frame(
        [(1, 2, "second {query}"), (1, 1, "first"), (1, 6, "sixth")],
        "query_id bigint, rank int, text string",
    )
    asked = frame([(1, "q"), (2, "lonely")], "query_id bigint, text string")
    got = dict(map(tuple, context.prompts(hits, asked, "{context}|{query}").collect()))
    assert got == {1: "first\n\nsecond {query}|q", 2: "|lonely"}


def test_captions_to_records(frame):
    def model(batches):
        for pdf in batches:
            out = pdf[["path"]].copy()
            out["answer"] = [
                'Sure: [{"Name": "九龍冰室", "Cost Estimate": "HKD 40"}, {"Name": "b"}] bye'
                if "tea" in p
                else "sorry"
                for p in pdf["prompt"]
            ]
            yield out

    df = frame([("a.vtt", "tea time"), ("b.srt", "nothing"), ("c.srt", "")], "path string, transcript string")
    rows, bad = extraction.records_from_captions(df, model)
    assert [(r["path"], r["pos"], r["Name"]) for r in rows.orderBy("pos").collect()] == [
        ("a.vtt", 0, "九龍冰室"),
        ("a.vtt", 1, "b"),
    ]
    assert sorted((r["path"], r["answer"]) for r in bad.collect()) == [("b.srt", "sorry"), ("c.srt", None)]


def test_parse_split_loses_nothing(frame):
    df = frame([(1, '[{"Name": "x"}]'), (2, "[{]"), (3, None), (4, "[]")], "id bigint, answer string")
    good, bad = extract.parse_outputs(df, "answer")
    assert sorted(r["id"] for r in good.collect()) == [1, 4]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]
    assert extract.flatten_records(good, ["id"]).count() == 1


def test_hashed_vectors_are_unit_and_repeatable(frame):
    df = frame([(1, "dim sum"), (2, "Dim  SUM"), (3, "   ")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["embedding"] for r in encode.hashed_vectors(df, 32).collect()}
    assert got[1] == got[2] and 3 not in got
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and len(got[1]) == 32


def test_model_plug_point(frame):
    def make():
        import numpy as np

        def encode_batch(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype="float32")

        return encode_batch

    df = frame([("ab",), ("abcd",)], "text string")
    got = encode.model_vectors(df, make, batch=1).collect()
    assert {r["text"]: r["embedding"] for r in got} == {"ab": [2.0, 1.0], "abcd": [4.0, 1.0]}


def test_a_request_joins_the_logarithm_of_its_history(frame):
    rows = [(1, t, "user", f"t{t}") for t in range(1000) if t not in range(100, 140)] + [(2, 0, "user", "only")]
    turns = frame(rows, "conv_id bigint, turn bigint, role string, text string")
    for block in (1, 64):
        own = context.history(turns, block)
        nodes = context.tree_nodes(own)
        per_block = {(r["conv_id"], r["block"]): r["count"] for r in nodes.groupBy("conv_id", "block").count().collect()}
        assert all(n == b.bit_count() <= 10 for (_, b), n in per_block.items())
        # Each block stands at most once in every level of the stored tree.
        tree = context.history_tree(context.history_blocks(turns, block), nodes)
        held = tree.groupBy("level").agg(F.sum(F.size("messages")).alias("n")).collect()
        assert all(r["n"] <= len(rows) for r in held)
        asked = context.whole_history(turns, F.col("turn").isin(0, 63, 64, 99, 140, 777, 999), block).collect()
        for r in asked:
            want = [x[3] for x in rows if x[0] == r["conv_id"] and x[1] <= r["turn"]]
            assert [m["text"] for m in r["messages"]] == want
        assert len(asked) == 8
