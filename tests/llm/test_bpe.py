import random
import time
from collections import Counter

import public_tokenizers
import pyarrow as pa
import tiktoken

from wayfare.llm import bpe

from .conftest import messy


def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={}
    )


def test_ids_and_bytes_equal_the_library(documents, clashing):
    tool = library()
    expected = Counter((i, t or "", tuple(tool.encode_ordinary(t or ""))) for i, t in messy())
    for docs in (documents, clashing):
        got = bpe.decode(bpe.encode(docs)).collect()
        assert Counter((r.doc_id, bytes(r.decoded).decode(), tuple(r.ids)) for r in got) == expected


def test_long_words_and_odd_blanks():
    coder, tool = bpe.Coder(bpe.RANKS, public_tokenizers.PATTERN), library()
    texts = ["a" * 3000, "abcab" * 200, "thethingsing" * 90, "あ" * 300, " ", "\n\n a  b", "don't I'LL 12 345"]
    assert coder.encode(pa.array(texts)).to_pylist() == [tool.encode_ordinary(t) for t in texts]
    assert coder.decode(coder.encode(pa.array(texts))).to_pylist() == [t.encode() for t in texts]
    coder.units.most = coder.words.most = 3  # generations change, results do not
    for _ in range(3):
        assert coder.encode(pa.array(texts)).to_pylist() == [tool.encode_ordinary(t) for t in texts]


def test_long_random_words_take_time_in_proportion():
    """100,000 random letters without a blank, and other alphabets, within seconds."""
    coder, tool = bpe.Coder(bpe.RANKS, public_tokenizers.PATTERN), library()
    rng = random.Random(1)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "éüß日本語中文字кирилл", "!?.,;:-_=+*#", "ab"]
    for alphabet, n in zip(alphabets, (100_000, 30_000, 30_000, 30_000), strict=True):
        word = "".join(rng.choice(alphabet) for _ in range(n))
        start = time.time()
        got = coder.encode(pa.array([word])).to_pylist()[0]
        assert time.time() - start < 20 and got == tool.encode_ordinary(word)


def test_seams_of_words_of_any_length():
    coder, tool = bpe.Coder(bpe.RANKS, public_tokenizers.PATTERN), library()
    rng, words = random.Random(2), []
    for _ in range(1500):
        alphabet = rng.choice(["ab", "abc", "thequick", "aeioutnsr", "日本語中", "!?.", "ABCabc", "éüß", "ationgerscht"])
        words.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(40, 400))))
    assert coder.encode(pa.array(words)).to_pylist() == [tool.encode_ordinary(w) for w in words]


def test_both_steps_in_one(documents, clashing):
    for docs in (documents, clashing):
        apart, together = bpe.decode(bpe.encode(docs)), bpe.encode_and_decode(docs)
        assert sorted(apart.columns) == sorted(together.columns)
        columns = apart.columns
        assert Counter(map(str, apart.collect())) == Counter(map(str, together.select(*columns).collect()))


def test_null_ids_and_empty_tables(spark, empty):
    rows = spark.createDataFrame([(None,), ([],), ([72, 73],)], "ids array<int>")
    assert sorted(bytes(r.decoded) for r in bpe.decode(rows).collect())[:2] == [b"", b""]
    assert bpe.decode(bpe.encode(empty)).count() == 0
