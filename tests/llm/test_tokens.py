import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfare.llm import rans, tokens
from wayfare.llm.units import PLAIN, Known, Recent, gathered, slices, units

from .conftest import messy


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=600), st.integers(1, 9), st.integers(1, 20))
def test_codec_round_trip(ids, lanes, steps):
    ids = np.array(ids, np.int64)
    table = rans.Table.fit(np.bincount(ids, minlength=41), 8)
    block = rans.encode(ids, table, lanes, steps)
    assert (rans.decode(block, table) == ids).all()
    parts = [rans.decode(block, table, p) for p in range(rans.parts(block))]
    assert (np.concatenate(parts) == ids).all()


def test_skewed_counts_keep_rare_symbols():
    counts = np.concatenate([[10**9], np.ones(200, int)])
    table = rans.Table.fit(counts, 8)
    assert table.freqs.sum() == 256 and (table.freqs >= 1).all()
    with pytest.raises(ValueError):
        rans.Table.fit(np.ones(300, int), 8)


def test_damage_is_found():
    ids = np.arange(50)
    table = rans.Table.fit(np.bincount(ids), 10)
    block = bytearray(rans.encode(ids, table))
    block[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)
    with pytest.raises(ValueError):
        rans.decode(rans.encode(ids, table), rans.Table.fit(np.bincount(ids) + np.arange(50), 10))


@settings(max_examples=200, deadline=None)
@given(st.text("ab, .\n\t \x1c\0'é", max_size=40))
def test_units_put_together_are_the_text(text):
    assert "".join(units(text)) in (text, text.replace("\0", "")) or "\0" not in text
    assert "".join(units(text)) == text


def test_units_joined_are_units_one_by_one():
    from tokenizers import Tokenizer

    tool, coder = Tokenizer.from_file(tokens.VOCABULARY), tokens.Encoder(tokens.VOCABULARY)
    some = [" a", " don't", " <|endoftext|>", " 日本", " x <|endoftext|>y", "\n", "a", " ", "  b", " c ", " \u00a0d", " é" * 40, " !?", " 12345", ""]
    some += [f" w{i}" for i in range(3000)]
    assert coder._new(some) == [np.array(tool.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in some]
    texts = ["end of doc <|endoftext|> next<|endoftext|>", "a <|endoftext|>", "<|endoftext|> b  c"]
    ids, ends = coder(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tool.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_units_cost_no_python_objects():
    texts = pa.array([" ".join(f"w{i:x}{i % 7}" for i in range(n, n + 2000)) for n in range(0, 100_000, 2000)])
    coder = tokens.Encoder(tokens.VOCABULARY)
    coder(texts.slice(0, 1))
    tracemalloc.start()
    held = pa.total_allocated_bytes()
    ids = coder(texts)[0].tolist()
    again, ends = coder(texts)
    assert again.tolist() == ids and len(ends) == len(texts) + 1
    del again, ids
    python, arrow = tracemalloc.get_traced_memory()[0], pa.total_allocated_bytes() - held
    tracemalloc.stop()
    assert python + arrow < 9_000_000  # 100,000 units and their codes


@pytest.mark.parametrize("most", [1, 2, 50, 10_000])
def test_known_units_are_bounded_and_give_the_same_codes(most):
    asked = []

    def make(some):
        asked.extend(some)
        return [u.encode("utf-32-le") for u in some]

    known, recent = Known(most), Recent(most)
    rng = np.random.default_rng(most)
    for n in range(30):
        words = [f"w{i}" for i in rng.zipf(1.3, 40) % 3000] + ["x" * 150, "é日本", "two  blanks", "", "nul\0"]
        texts = pa.array([" ".join(rng.permutation(words)), "", "\n", "hot hot", f"own{n}\ngone"])
        (ids, ends), (ids_r, ends_r) = known.coded(texts, make), recent.coded(texts, lambda some: [u.encode("utf-32-le") for u in some])
        assert ids.tolist() == ids_r.tolist() and ends.tolist() == ends_r.tolist()
        assert len(known.keys) == len(known.codes) == len(known.used) <= most
        assert "".join(map(chr, ids[ends[3] : ends[4]])) == "hot hot"
    if most == 10_000:  # nothing had to go: each short unit was asked once
        short = [u for u in asked if len(u) <= 100]
        assert len(short) == len(set(short))
    ids, ends = known.coded(pa.array(["", ""]), make)
    assert not len(ids) and ends.tolist() == [0, 0, 0]


def test_plain_units_by_every_blank():
    some = [f"{a}{chr(c)}{b}" for c in (*range(0xD800), *range(0xE000, 0x11000)) for a, b in ((" ", ""), (" ", "z"), (" z", ""), ("", "z"))]
    some += ["", " ", " a b", " a\nb", " a\n", "a b"]
    want = [re.fullmatch(r" \S(?:.*\S)?", u, re.S) is not None for u in some]
    assert pc.match_substring_regex(pa.array(some), PLAIN).to_pylist() == want


def test_small_batches_are_joined():
    rows = [["a" * 10], [], [None, "b"], ["c" * 500], ["d", "e"], ["f" * 90], [""]]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x, pa.string())], ["doc_id", "text"]) for x in rows]
    out = list(gathered(iter(batches), 1, 120))
    assert [t for b in out for t in b.column(1).to_pylist()] == [t for x in rows for t in x]
    assert len(out) < len(batches) and all(b.column(1).nbytes <= 130 or b.num_rows == 1 for b in out)
    assert list(gathered(iter([]), 1, 120)) == []


def test_slices_cover_all():
    texts = ["a" * n for n in (0, 5, 0, 9, 1, 1)]
    assert [i for a, b in slices(texts, 4) for i in range(a, b)] == list(range(6))


def test_files_hold_the_ids_of_the_library(spark, documents, clashing, empty, tmp_path):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokens.VOCABULARY)
    expected = sorted(
        (i is not None, i or 0, np.array(tool.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
        for i, t in messy()
    )
    for name, docs in (("plain", documents), ("clash", clashing)):
        tokens.write(docs, str(tmp_path / name), block_ids=500)
        got = tokens.read(spark, str(tmp_path / name)).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == expected
        got.sort(key=lambda r: r.start)
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert ids == sorted(ids)
        assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
        assert all(r.n_tokens * 4 == len(r.ids) for r in got)
        assert all(zlib.crc32(r.ids) >= 0 for r in got)
    tokens.write(empty, str(tmp_path / "empty"))
    assert tokens.read(spark, str(tmp_path / "empty")).count() == 0


def test_literals_of_added_tokens_are_as_by_the_plain_call(spark, tmp_path):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokens.VOCABULARY)
    texts = ["end of doc <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|>\n\n <|endoftext|>  c", "<|endof text|>", "abc\n\n<|endoftext|>\t<|\na", "a\tb\tc\n\n"]
    tokens.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "ids"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.read(spark, str(tmp_path / "ids")).collect()}
    assert got == {i: tool.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert got[0] == [437, 286, 2205, 220, 50256, 1306, 2]
