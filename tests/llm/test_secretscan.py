"""Secrets: base spans against Python's patterns, tests against numpy, planted strings of every encoding."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from wayfare.llm import secretscan as scan
from wayfare.llm.common import table
from wayfare.llm.queries import QUERIES

from .conftest import messy, prose

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def spelled(spans):
    return ",".join(f"{scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def made(alphabet, length, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(length))


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": DIGITS + "ABCDEF",
    "base32": LOWER.upper() + "234567",
    "base36": DIGITS + LOWER,
    "base64": DIGITS + LOWER + LOWER.upper() + "+/",
    "base64url": DIGITS + LOWER + LOWER.upper() + "-_",
}


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs.selectExpr("*", "'x' as m", "1 as kind", "2 as start", "'y' as base")


def found(spark, rows, **options):
    return [
        (r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans])
        for r in scan.secrets(frame(spark, rows), **options).collect()
    ]


TRICKY = [
    "token=abc then token = \"abcdef\"", "secret=token: abcdefgh", "token==abcdef", "api_key : 'x1x1x1'", "APIKEY=ZZZZZZ password:123456",
    "paſſword=abcdef toKen=abcdef", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B7" * 9 + "c", "f" * 23, "g" + "f" * 24 + "g" + "0" * 30,
    "日本 token=abcdef " + "a1" * 12, "𝒳𝒳 password='hunter2222'" + "é" + "0f" * 15, "passwd=a.b.c=d==", "secret : = abcdef", "token=\nabcdef",
    "token=" + "ab12" * 8, "x" * 100_000 + " token=abcdef " + "deadbeef" * 40_000,
]


def test_base_spans_equal_python(spark):
    rows = [(500 + i, t) for i, t in enumerate(TRICKY)] + messy() + [(500, TRICKY[0])] * 3 + [(None, TRICKY[0])]
    got = found(spark, rows)
    assert sorted(((i, b) for i, b, _ in got), key=str) == sorted(((i, base(t)) for i, t in rows), key=str)
    for _, own, spans in got:
        more = [s for s in spans if s not in own]
        assert sorted(own + more) == spans and {k for _, k, _ in more} <= {3}
        ends = sorted((a, b) for a, _, b in more)
        assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:]))
        assert not any(a < y and x < b for a, _, b in more for x, _, y in own)


def test_query_equals_python(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op13_randomness_battery_secrets"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        own = base(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spelled(own).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in own) for x in range(3)]
        assert set(filter(None, spelled(own).split(","))) <= set(r.spans.split(","))


BENIGN = [
    "internationalization-and-localization", "src/main/java/org/example/service/UserRepository", "a" * 40, "ab" * 30, "2024-01-15_2024-02-15_2024-03-15",
    "0123456789ABCDEF0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "1234567890" * 4,
    "Donaudampfschifffahrtsgesellschaft", "this_is_a_rather_long_identifier_name", "AbstractUserRepositoryServiceFactoryBean", "=" * 30, "-" * 60,
]


def test_planted_strings_are_added_and_ordinary_ones_are_not(spark):
    planted = [
        (name, made(alphabet, length, 1000 * length + 10 * k + j))
        for k, (name, alphabet) in enumerate(ALPHABETS.items())
        for length in (32, 40, 44, 64, 128)
        for j in range(6)
    ]
    rows = [(i, f"{prose(i, 30)} {s} {prose(i + 1, 30)}") for i, (_, s) in enumerate(planted)]
    plain = [(10_000 + i, f"{prose(i, 30)} {s}\n{prose(i + 5, 30)} {s}") for i, s in enumerate(BENIGN)]
    corpus = [(-1 - r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {i: [s for s in spans if s not in own] for i, own, spans in found(spark, rows + plain + corpus)}
    caught = [bool(got[i]) or bool(base(t)) for i, t in rows]
    assert sum(caught) >= 0.9 * len(rows)
    for i, (name, s) in enumerate(planted):
        for a, _, b in got[i]:
            assert rows[i][1][a:b] == s.rstrip("=")[: b - a] or s in rows[i][1][a:b]
    assert [t for i, t in plain if got[i]] == []


def test_more_short_candidates_do_not_hide_a_long_one(spark):
    long = made(ALPHABETS["base64"], 80, 5)
    crowd = [(i, f"{prose(i, 20)} {'-'.join(prose(i, 4).split())}-{'x' * 12}") for i in range(300)]
    got = {i: spans for i, _, spans in found(spark, [*crowd, (999, f"see {long} here")])}
    assert [k for _, k, _ in got[999]] == [3] and sum(map(len, got.values())) == 1


def test_a_third_of_all_rows_with_one_string(spark):
    s = made(ALPHABETS["base64"], 64, 8)
    rows = [(i, f"{prose(i, 20)} {s}") for i in range(200)] + [(7, f"{prose(7, 20)} {s}")] * 100 + [(1000 + i, prose(i, 40)) for i in range(300)]
    got = found(spark, rows)
    assert len(got) == len(rows) and sum(bool(x) for _, _, x in got) == 300


def test_tests_equal_numpy(spark):
    laws = {e: (0.07, 0.008, 0.25) for e in scan.ENCODINGS}
    strings = [made(a, n, n) for a in ALPHABETS.values() for n in (20, 33, 64, 3000)] + ["a" * 30, "ab" * 15]
    rows = spark.createDataFrame([(s,) for s in strings], "m string")
    got = {r.m: r for r in rows.select("m", scan._serial(rows["m"]).alias("r")).collect()}
    for s in strings:
        x = np.array([(scan._SYMBOLS.find(c) + 1) for c in s], float)
        d = x - x.mean()
        expected = float((d * np.roll(d, 1)).sum() / (d * d).sum()) if d.any() else 1.0
        assert math.isclose(got[s].r, expected, abs_tol=1e-9)
    tested = {r.m: r for r in scan.battery(rows, laws).collect()}
    assert not tested["a" * 30].plausible and not tested["ab" * 15].plausible
    for s in strings[:-2]:
        r = tested[s]
        assert r.encoding == {"base64url": "base64"}.get(next(n for n, a in ALPHABETS.items() if set(s) <= set(a)), r.encoding)
        assert r.band == math.floor(2 * math.log2(len(s.replace("-", "") if r.encoding == "hex" else s) / 20))


@pytest.mark.parametrize("share", [0.01, 0.05, 0.5])
def test_discoveries_equal_a_plain_rule(spark, share):
    rng = random.Random(3)
    rows = [(b, -rng.expovariate(0.15 if rng.random() < 0.3 else 1)) for b in (0, 1, 2) for _ in range(200)] + [(3, 0.0)]
    got = scan.discoveries(spark.createDataFrame(rows, "band int, log_p double"), share)
    for b in range(4):
        up = sorted(math.ceil(p * 200) / 200 for x, p in rows if x == b)
        good = [p for k, p in enumerate(up, 1) if p <= math.log(share * k / len(up))]
        # Of tied values the last has the largest rank.
        good = [p for p in good if p <= math.log(share * sum(q <= p for q in up) / len(up))]
        assert got.get(b) == (max(good) if good else None)


def test_empty_and_plain_tables(spark, empty, clashing):
    assert scan.secrets(empty).count() == 0
    assert found(spark, [(1, None), (2, ""), (None, "plain")]) is not None
    assert scan.secrets(clashing).count() == clashing.count()


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op13_randomness_battery_secrets"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
