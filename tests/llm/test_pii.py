import random
import re
from collections import Counter

import pytest

from wayfare.llm import pii

from .conftest import messy, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [
        (k, m.start(), m.end())
        for k, kind in enumerate(pii.KINDS)
        for m in re.finditer(PLAIN[kind], text or "")
        if passes(kind, m.group())
    ]


def noise(seed, n=60):
    rng = random.Random(seed)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "10.0.256.1", "255.255.255.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (555) 123-4567", "+12", "555-123-4567", "me [at] home.org", "é", "@", ".", "+", "-", " ", "_", "0", "9", "12345",
             "日本", "00000255.0.0.1", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "3782 822463 10005"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    return [*messy(), *[(1000 + i, noise(i)) for i in range(60)]]


def test_base_spans_equal_the_plain_patterns_and_stay(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = docs.selectExpr("*", "'x' as base", "'x' as kind", "'x' as spans", "'x' as th")
    got = pii.personal_data(docs).collect()
    found = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base)) for r in got)
    assert found == Counter((i, tuple(base(t))) for i, t in rows)
    added = 0
    for r in got:
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert spans == sorted(spans) and {(s.kind, s.start, s.end) for s in r.base} <= set(spans)
        more = [s for s in spans if s not in {(b.kind, b.start, b.end) for b in r.base}]
        for i, a in enumerate(more):
            others = [*more[:i], *[(b.kind, b.start, b.end) for b in r.base]]
            assert all(a[2] <= b[1] or b[2] <= a[1] for b in others)
        added += len(more)
    assert added > 0


def card(rng):
    body = [4] + [rng.randrange(10) for _ in range(14)]
    total = sum(d * 2 - 9 * (d * 2 > 9) if i % 2 == 0 else d for i, d in enumerate(body))
    return "".join(map(str, [*body, -total % 10]))


def test_trees_add_loose_forms_and_leave_look_alikes(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    name = lambda: rng.choice(["mia", "j.roe", "li_wei", "info"]) + digits(2)
    octets = lambda: [str(rng.randrange(1, 256)) for _ in range(4)]
    split = lambda c, sep: sep.join(c[i : i + 4] for i in range(0, 16, 4))
    strict = [
        lambda: f"{name()}@mail{digits(1)}.example.org", lambda: ".".join(octets()), lambda: split(card(rng), " "),
        lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
    ]
    loose = [
        lambda: f"{name()} (at) host{digits(1)}.example.net", lambda: f"{name()}[at]host(dot)org", lambda: f"{name()} @ web.example.com",
        lambda: "[.]".join(octets()), lambda: " . ".join(octets()), lambda: split(card(rng), "."), lambda: split(card(rng), "/"),
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}",
    ]
    alike = [
        lambda: f"{digits(1)} @ {digits(2)}.50", lambda: f"1{digits(1)}. 4{digits(1)}. 3{digits(2)}. 7", lambda: "1987/2004/2019",
        lambda: f"{digits(2)}.{digits(3)}.{digits(3)}", lambda: "1999-2003-2010", lambda: f"00{digits(2)}_{digits(3)}_{digits(4)}",
    ]
    rows, planted = [], {}
    for i in range(1200):
        made = strict[i % 4] if i < 800 else loose[i % 9] if i < 1000 else alike[i % 6]
        before, body = prose(5000 + i, 12), made()
        rows.append((i, f"{before} {body} {prose(9000 + i, 12)}"))
        planted[i] = (len(before) + 1, len(before) + 1 + len(body))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    added = {}
    for r in pii.personal_data(docs).collect():
        base = {tuple(s) for s in r.base}
        added[r.doc_id] = {(s.start, s.end) for s in r.spans if tuple(s) not in base}
    right = sum(planted[i] in added[i] for i in range(800, 1000))
    total = sum(len(x) for x in added.values())
    missed = Counter(i % 9 for i in range(800, 1000) if planted[i] not in added[i])
    assert right >= 180 and right >= 0.95 * total, (right, total, missed)
    assert sum(len(added[i]) for i in range(1000, 1200)) <= 4


def test_long_texts_are_linear(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "1 " * 150_000, "a@" * 100_000, "x@y." * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(texts)
    assert [tuple(s) for s in got[2].base] == base(texts[2])


def test_nothing_to_learn_and_empty_tables(spark, empty):
    one = spark.createDataFrame([(1, "mail a@b.cd"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in pii.personal_data(one).collect()} == {1: 1, 2: 0}
    assert pii.personal_data(empty).count() == 0


def test_plan_has_no_python(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = pii.personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = pii.planted(pii.candidates(docs), docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = pii.candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
