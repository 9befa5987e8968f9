"""The registered queries: SQL counterparts, and the pipeline against a brute-force version."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from checks.compare import connect, difference
from wayfare.llm import bpe, quality, shards, weighted
from wayfare.llm.common import table
from wayfare.llm.oracles import ORACLES
from wayfare.llm.queries import QUERIES

from . import test_decontam, test_lines, test_weighted
from .conftest import prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toArrow()
    assert difference(got, connect(SF).sql(ORACLES[name]).to_arrow_table()) is None


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]


def test_tokens_and_bytes(spark, rows):
    from .test_bpe import library

    tool, sha = library(), lambda b: hashlib.sha256(b).hexdigest()
    expected = set()
    for i, t in rows:
        ids = tool.encode_ordinary(t or "")
        expected.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert {tuple(r) for r in QUERIES["op8_duckdb_bpe"](spark, SF).collect()} == expected


def test_token_files(spark, rows):
    from tokenizers import Tokenizer

    from wayfare.llm.tokens import VOCABULARY

    tool = Tokenizer.from_file(VOCABULARY)
    expected, start = [], 0
    for i, t in sorted(rows):
        ids = np.array(tool.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op5_rans_token_blocks"](spark, SF).collect()) == expected


def test_shards(spark, rows):
    got = QUERIES["op9_hypergeometric_shards"](spark, SF).collect()
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.doc_id, r.size) for r in got} == {(i, len((t or "").encode()) + 1) for i, t in rows}
    assert {(r.doc_id, r.text_crc32) for r in got} == {(i, zlib.crc32((t or "").encode())) for i, t in rows}
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    assert {r.grown_shard for r in got} == {None}
    assert {r.law for r in got} == {"rows"} and shards.blocks_of(17, 8, 4)[2].sum() == 17


def test_near_duplicates(spark, rows):
    got = QUERIES["op10_weighted_near_duplicates"](spark, SF).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == test_weighted.brute(rows)


def test_embedding_links(spark):
    from .test_itq import brute

    vectors = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    expected = brute(vectors)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in QUERIES["op4_itq_embedding_links"](spark, SF).collect()), key=str)
    links = sum(n for _, n, _ in expected)
    assert links >= sum(n for _, n, _ in got) >= 0.9 * links


def test_personal_data(spark, rows):
    from wayfare.llm import pii

    from .test_pii import base

    def spelled(spans):
        return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)

    got = {r.doc_id: r for r in QUERIES["op2_boosted_personal_data"](spark, SF).collect()}
    for i, t in rows:
        spans = base(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(spelled(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in spans) for k in range(4)]
        assert set(filter(None, spelled(spans).split(","))) <= set(r.spans.split(","))


def test_pipeline_equals_brute_force(spark, rows):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    scores = model.scores([t for _, t in rows])
    kept = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    kept = [(i, t) for i, t, _, _ in test_lines.brute(kept, 10).elements()]
    classes = dict(test_weighted.brute(kept, weighted.SIMILARITY))
    kept = [(i, t) for i, t in kept if classes[str(i)] == str(i)]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {i for i, _, _, _, bad in test_decontam.brute(kept, items) if bad}
    from .test_bpe import library

    tool = library()
    expected = {i: (t, len(t), tool.encode_ordinary(t)) for i, t in kept if i not in hit}
    got = {r.doc_id: (r.text, r.n_chars, r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert 0 < len(expected) < len(rows) and got == expected


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes, name
    assert bpe.RANKS.endswith(".tiktoken")


def _stage(spark, monkeypatch, stage, rows, items=()):
    """(doc_id, text) that ``stage`` keeps of rows of (doc_id, text), repeated and null ids included."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame(list(items), "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: benchmark)
    return Counter((r.doc_id, r.text) for r in stage(spark, docs.repartition(3), SF).collect())


def test_a_contaminated_row_takes_no_other_row_of_its_id(spark, monkeypatch):
    item, clean = prose(1, 12), [prose(10 + k, 30) for k in range(4)]
    rows = [(None, f"x {item} y"), (None, clean[0]), (None, None), (5, item), (5, clean[1]), (5, clean[1]), (6, clean[2]), (7, item)]
    got = _stage(spark, monkeypatch, corpus_pipeline.keep_clean_of_benchmark, rows, [(1, item)])
    assert got == Counter([(None, clean[0]), (None, None), (5, clean[1]), (5, clean[1]), (6, clean[2])])


def test_one_row_of_a_repeated_document_stays(spark, monkeypatch):
    a, b, c = prose(20, 60), prose(21, 60), prose(22, 60)
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (3, c), (None, a), (None, a), (4, ""), (4, ""), (5, None), (5, None)]
    got = _stage(spark, monkeypatch, corpus_pipeline.keep_one_of_near_duplicates, rows)
    assert got == Counter([(1, a), (3, b), (3, c), (None, a), (None, a), (4, ""), (4, ""), (5, None), (5, None)])
