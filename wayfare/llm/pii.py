"""Personal data by candidates and boosted trees, in DataFrame functions only.

Four strict patterns give the base spans, which always stay. Loose patterns propose further spans,
which may overlap: addresses with written-out signs, numbers with other separators, newer address forms.
Boosted trees score every loose candidate by its format and its context; a threshold per kind,
calibrated on plants that the trees did not see, selects what is added. The trees are
translated to CASE expressions, so scoring is part of Spark's generated code.

There are no labelled spans, so labels are planted: base spans are written in loose forms, in their own
context or in that of any text, and beside them stand look-alikes (prices behind an at sign, versions,
years, amounts, order numbers, digits without a check digit). The generators run over these plants; a
candidate is positive if it is exactly a planted loose form, whatever its features say.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import staged

KINDS = ["email", "ip", "card", "phone"]
CONTEXT = 24
_NULL_ID = -(2**63)

# The four base patterns. Possessive and anchored at the start of a run, they match the
# same spans as their plain forms, in time linear in the text and without deep recursion.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The loose generators; every repeat is bounded or possessive.
_AT = r"(?:\s?(?:@|[\[({<]at[\])}>])\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({<](?:dot|\.)[\])}>]\s?|\sdot\s)"
_PART = r"(?:\s?\.\s?|\s?[\[({<](?:dot|\.)[\])}>]\s?)"
LOOSE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+{_AT}[{_LABEL}]++(?:{_DOT}[{_LABEL}]++){{1,6}}+",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_PART}[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9])"
    r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\s./_-]{1,2}[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[ -]?[1-9][0-9]{0,2}[ -])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])",
}
# Quick tests that a text must pass before a pattern is tried on it.
_MAY = {
    ("email", True): lambda t: t.contains("@"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("phone", True): lambda t: t.contains("+"),
    ("email", False): lambda t: t.contains("@") | t.rlike(r"[\[({<]at[\])}>]|\sdot\s"),
    ("ip", False): lambda t: t.rlike(rf"[0-9]{_PART}[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("card", False): lambda t: t.rlike(r"[0-9]{4}[\s./_-]{1,2}[0-9]{3}"),
    ("phone", False): lambda t: t.rlike(r"[0-9)][ ./-][0-9]{3,4}[ ./-][0-9]{3}"),
}
# Words that tell of a kind when they stand near.
_HINTS = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|address|log|port",
    "card": r"(?i)card|visa|credit|karte|tarjeta|carte|pay",
    "phone": r"(?i)phone|tel|call|fax|mobile|whatsapp|anruf|llam|appel",
}


def _matches(text: Column, kind: str, strict: bool) -> Column:
    """array<struct> of (kind, strict, i, gap, m, after): match i, the characters before it, what follows."""
    pattern = F.lit((BASE if strict else LOOSE)[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, (BASE if strict else LOOSE)[kind], -1)
    # Match i stands between pieces i and i + 1. The lambda sees its own element only: what it took
    # from outside would be computed again for every match.
    n = F.size(found)
    zipped = F.transform(
        F.arrays_zip(found, F.slice(pieces, 1, n), F.slice(pieces, 2, n)),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(strict).alias("strict"),
            i.alias("i"),
            F.char_length(x["1"]).alias("gap"),
            x["0"].alias("m"),
            F.right(x["1"], F.lit(CONTEXT)).alias("before"),
            F.left(x["2"], F.lit(CONTEXT)).alias("after"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,strict:boolean,i:int,gap:int,m:string,before:string,after:string>>")
    return F.when(_MAY[kind, strict](text), zipped).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.char_length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda s, i: s
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int"))
        ),
    )
    return F.coalesce(total % 10 == 0, F.lit(False))


def _octets(m: Column) -> Column:
    """Whether all parts between dots are at most 255, whatever their length."""
    parts = F.transform(F.split(F.regexp_replace(m, " ", ""), r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255"))
    return F.forall(parts, small)


def candidates(docs: DataFrame) -> DataFrame:
    """(d, th, kind, strict, start, end, m, before, after, ok): every match of every generator.

    Offsets are code points, end exclusive. ``ok`` says whether the match passes its kind's check.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64("text").alias("th")]
    found = F.concat(*[_matches(text, k, s) for k in KINDS for s in (True, False)])
    rows = docs.select(*keys, F.explode(found).alias("c")).select("d", "th", "c.*").distinct()
    order = Window.partitionBy("d", "th", "kind", "strict").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("m")).over(order)
    rows = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.char_length("m"))
    digits = _digits(F.col("m"))
    n = F.char_length(digits)
    ok = (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, F.when(F.col("m").contains(":"), F.lit(True)).otherwise(_octets(F.col("m"))))
        .when(F.col("kind") == 2, F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )
    return rows.select("d", "th", "kind", "strict", "start", "end", "m", "before", "after", ok.alias("ok"))


def _features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    m, digits = F.col("m"), _digits(F.col("m"))
    n = F.char_length(digits)
    hints = F.lit(False)
    for i, kind in enumerate(KINDS):
        near = F.concat_ws(" ", "before", "after").rlike(_HINTS[kind])
        hints = F.when(F.col("kind") == i, near).otherwise(hints)
    made = {
        "f_kind": F.col("kind"),
        "f_length": F.char_length(m),
        "f_digits": n,
        "f_separators": F.regexp_count(m, F.lit(r"[^0-9A-Za-z]")),
        "f_spaces": F.regexp_count(m, F.lit(" ")),
        "f_dots": F.regexp_count(m, F.lit(r"\.")),
        "f_luhn": F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False)),
        "f_octets": F.when(F.col("kind") == 1, _octets(m)).otherwise(F.lit(False)),
        "f_brackets": F.regexp_count(m, F.lit(r"[\[({<]")),
        "f_at": m.contains("@"),
        "f_plus": m.startswith("+"),
        "f_top": F.char_length(F.regexp_extract(m, r"([A-Za-z]+)$", 1)),
        "f_groups": F.regexp_count(m, F.lit("[0-9]+")),
        "f_runs_on": F.col("after").rlike(r"^[0-9A-Za-z]|^[.-][0-9]"),
        "f_runs_in": F.col("before").rlike(r"[0-9A-Za-z]$|[0-9][.-]$"),
        "f_quoted": F.col("before").rlike(r"""["'=/]\s*$"""),
        "f_hint": hints,
        "f_numbers_near": F.regexp_count(F.concat_ws(" ", "before", "after"), F.lit("[0-9]+")),
    }
    return rows.withColumns({k: v.cast("double") for k, v in made.items()}), list(made)


def _as_sql(lines: list[str], names: list[str], at: int = 0) -> tuple[str, int]:
    """A printed decision tree as a CASE expression, and the line after it."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return f"cast({float(line.split(':')[1])!r} as double)", at + 1
    feature, value = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", line).groups()
    yes, at = _as_sql(lines, names, at + 1)
    no, at = _as_sql(lines, names, at + 1)  # over the line of Else
    return f"case when {names[int(feature)]} <= {float(value)!r} then {yes} else {no} end", at


def _trees(model, names: list[str]) -> str:
    """The probability of a fitted ensemble as one SQL expression."""
    terms = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        lines = tree.toDebugString.strip().split("\n")[1:]
        terms.append(f"{float(weight)!r} * {_as_sql(lines, names)[0]}")
    return f"1 / (1 + exp(-2 * ({' + '.join(terms)})))"


def _number(m: Column, i: int, digits: int) -> Column:
    """A number of so many digits that a span decides, without meaning."""
    drawn = F.conv(F.substring(F.md5(F.concat(m, F.lit(f"/{i}"))), 1, 12), 16, 10)
    return F.right(F.concat(F.lit("0" * digits), drawn), F.lit(digits))


def _forms(m: Column) -> Column:
    """array<struct<form, good>> of a base span: loose forms of it, and look-alikes of its kind."""
    user, host = F.regexp_extract(m, "^(.*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
    # Hosts of other shapes: the last two parts, without digits.
    short = F.regexp_replace(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "[0-9]", "")
    digits = _digits(m)
    n = F.char_length(digits)
    dotted = lambda dot: F.array_join(F.split(m, r"\."), dot)
    by_four = lambda sep: F.regexp_replace(digits, "([0-9]{4})(?=[0-9]{3})", "$1" + sep)
    line = F.right(digits, F.lit(10))
    area = F.substring(line, F.lit(1), F.char_length(line) - 7)
    mid, last = F.substring(F.right(digits, F.lit(7)), 1, 3), F.right(digits, F.lit(4))
    abroad = F.when(n.between(11, 13), F.concat(F.lit("00"), F.substring(digits, F.lit(1), n - 10), F.lit(" ")))
    hexes = F.array_join(F.regexp_extract_all(F.md5(m), F.lit("[0-9a-f]{4}"), F.lit(0)), ":")
    word = F.regexp_extract(host, "^([A-Za-z]+)", 1)
    a, b, c, d = (_number(m, i, 4) for i in range(4))
    small = lambda i, least, among: (_number(m, i, 6).cast("long") % among + least).cast("string")
    year = lambda i: small(i, 1950, 90)
    good = {
        "email": [
            F.concat(user, F.lit(" [at] "), host),
            F.concat(user, F.lit("(at)"), F.array_join(F.split(host, r"\."), "(dot)")),
            F.concat(user, F.lit(" @ "), host),
            F.concat(user, F.lit(" at "), F.array_join(F.split(host, r"\."), " dot ")),
            F.concat(user, F.lit("[at]"), F.array_join(F.split(short, r"\."), "(dot)")),
            F.concat(user, F.lit(" @ "), short),
        ],
        "ip": [dotted(" . "), dotted("[.]"), dotted(" (dot) "), hexes],
        "card": [by_four("."), by_four("/"), by_four("\n"), by_four("--")],
        "phone": [
            F.concat(F.coalesce(abroad, F.lit("")), area, F.lit(" "), mid, F.lit(" "), last),
            F.concat(F.lit("("), area, F.lit(") "), mid, F.lit("-"), last),
            F.concat_ws(".", area, mid, last),
            F.concat_ws("-", area, mid, last),
        ],
    }
    bad = {
        "email": [
            F.concat(small(1, 1, 40), F.lit(" @ "), small(2, 1, 90), F.lit("."), small(3, 10, 90)),
            F.concat(word, F.lit(" at "), F.reverse(word), F.lit(" dot "), F.reverse(user)),
            F.concat(user, F.lit(" @ "), small(1, 1, 20), F.lit("."), small(2, 0, 60)),
        ],
        "ip": [
            F.concat_ws(". ", small(1, 1, 12), small(2, 0, 40), small(3, 256, 700), small(4, 0, 9)),
            F.concat_ws(" . ", small(1, 300, 600), small(2, 0, 999), small(3, 0, 999), small(4, 0, 999)),
            F.concat_ws(":", *[_number(m, i, 2) for i in range(8)]),
        ],
        "card": [
            F.concat_ws(".", a, b, c, d),
            F.concat_ws("/", year(1), year(2), year(3)),
            F.concat_ws("_", a, _number(m, 5, 3), _number(m, 6, 4)),
            F.concat_ws("--", a, b, c, d),
        ],
        "phone": [
            F.concat_ws(" ", small(1, 10, 900), _number(m, 2, 3), _number(m, 3, 3)),
            F.concat_ws("-", year(1), year(2), year(3)),
            F.concat_ws(".", small(1, 10, 900), _number(m, 2, 3), _number(m, 3, 3)),
            F.concat_ws("-", year(1), F.lpad(small(2, 101, 1100), 4, "0"), d),
        ],
    }
    made = lambda kind: F.array(
        *[F.struct(f.alias("form"), F.lit(ok).alias("good")) for ok, fs in ((True, good), (False, bad)) for f in fs[kind]]
    )
    forms = made(KINDS[-1])
    for i, kind in enumerate(KINDS[:-1]):
        forms = F.when(F.col("kind") == i, made(kind)).otherwise(forms)
    return forms


def _among_least(h: Column, n: int, total: int) -> Column:
    """Whether a 64-bit hash can be among the ``n`` least of ``total``: about 8 n rows pass, however many there are."""
    return h.isNotNull() if total <= 8 * n else h < F.lit(-(2**63) + 8 * n * 2**64 // total)


def planted(found: DataFrame, docs: DataFrame, spans: int = 1000) -> DataFrame:
    """(doc_id, text, pk, at, to, good, o): one short text for each loose form and each look-alike.

    At most ``spans`` base spans of each kind and as many pieces of texts are used, those of least hash. Of the
    loose forms two thirds keep the context of their span and the rest get a piece of any text; of the
    look-alikes it is one third and the rest. ``o`` is equal for all plants of a span.
    """
    order = F.xxhash64("d", "th", "kind", "start")
    base = found.filter("strict and ok").select("kind", "m", "before", "after", order.alias("o"))
    # Counts of four kinds and of the texts come to the driver.
    held = {r["kind"]: r["count"] for r in base.groupBy("kind").count().collect()}
    few = F.lit(False)
    for kind, n in held.items():
        few = few | ((F.col("kind") == kind) & _among_least(F.col("o"), spans, n))
    base = base.filter(few)
    base = base.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("o", "m"))).filter(f"r <= {spans}")
    size = F.char_length("text") - 2 * CONTEXT
    h = F.xxhash64("doc_id", "text")
    piece = F.substr("text", (F.pmod(h, size) + 1).cast("int"), F.lit(2 * CONTEXT))
    long = docs.filter(size > 0)
    pieces = long.select(h.alias("h"), piece.alias("piece")).filter(_among_least(F.col("h"), spans, long.count())).orderBy("h", "piece").limit(spans)
    # At most ``spans`` pieces are numbered.
    pieces = pieces.withColumn("at", F.row_number().over(Window.orderBy("h", "piece")).cast("long")).drop("h")
    rows = base.select("*", F.posexplode(_forms(F.col("m"))).alias("v", "f"))
    own = F.pmod(F.col("r") + F.col("v"), F.lit(3))
    rows = rows.withColumn("own", F.when(F.col("f.good"), own > 0).otherwise(own == 0))
    rows = rows.withColumn("at", F.when(~F.col("own"), (F.col("r") * 7 + F.col("v")) % spans + 1).cast("long"))
    rows = rows.join(F.broadcast(pieces), "at", "left")
    left = F.concat(F.left(F.coalesce("piece", F.lit("")), F.lit(CONTEXT)), F.lit(" "))
    right = F.concat(F.lit(" "), F.right(F.coalesce("piece", F.lit("")), F.lit(CONTEXT)))
    left, right = F.when(F.col("own"), F.col("before")).otherwise(left), F.when(F.col("own"), F.col("after")).otherwise(right)
    at = F.char_length(left)
    return rows.select(
        F.xxhash64("o", "kind", "m", "v").alias("doc_id"),
        F.concat(left, "f.form", right).alias("text"),
        F.col("kind").alias("pk"),
        at.alias("at"),
        (at + F.char_length("f.form")).alias("to"),
        F.col("f.good").alias("good"),
        "o",
    )


def fit(plants: DataFrame, sample_rows: int = 20_000, rounds: int = 12, precision: float = 0.95):
    """(SQL expression of the score, threshold per kind), or None without both labels.

    At most ``sample_rows`` candidates of the plants are fitted on, those of least hash. The plants of two thirds of
    the spans train the trees; on the rest the least threshold is sought per kind from which at least
    ``precision`` of the candidates are positive; a kind without such a threshold adds nothing.
    """
    rows, names = _features(candidates(plants).filter("not strict"))
    told = plants.select(F.col("doc_id").alias("d"), "pk", "at", "to", "good", "o").dropDuplicates(["d"])
    hit = F.col("good") & (F.col("kind") == F.col("pk")) & (F.col("start") == F.col("at")) & (F.col("end") == F.col("to"))
    rows = rows.join(told, "d").withColumn("label", F.when(hit, 1.0).otherwise(0.0))
    sample = staged(rows.orderBy("o", "d", "kind", "start").limit(sample_rows), "pii-sample")
    labels = {r["label"] for r in sample.filter("pmod(o, 3) > 0").select("label").distinct().collect()}
    if labels != {0.0, 1.0}:
        return None
    train = VectorAssembler(inputCols=names, outputCol="features").transform(sample.filter("pmod(o, 3) > 0"))
    model = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.3, seed=7, labelCol="label").fit(train)
    score = _trees(model, names)
    # At most 101 bins per kind reach the driver.
    bins = sample.filter("pmod(o, 3) = 0").select("kind", "label", F.floor(F.expr(score) * 100).alias("bin"))
    sums = bins.groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("all"))
    thresholds, seen = {}, {}
    for r in sorted(sums.collect(), key=lambda r: -r["bin"]):
        good, total = seen.get(r["kind"], (0, 0))
        seen[r["kind"]] = good, total = good + r["good"], total + r["all"]
        if good >= precision * total:
            thresholds[r["kind"]] = r["bin"] / 100
    return score, thresholds


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, spans) of every row of ``docs``: arrays of (kind, start, end) in order.

    ``kind`` is the number of the kind in ``KINDS``; offsets are code points, end exclusive. ``base`` are
    the strict matches that pass their check, ``spans`` these and what the trees add. Added
    spans overlap neither base spans nor each other; better scores go first, then earlier starts.
    Null and empty texts have no spans. Every row gives one row: rows equal in id and text get equal
    results, ids may repeat or be null. Other columns are ignored; an empty table gives an empty one. A
    table without base spans of a kind gives no plants of it, and nothing of that kind is added.
    """
    docs = docs.select("doc_id", "text")
    # Features are written with the candidates: the trees name each of them many times.
    found = staged(_features(candidates(docs))[0], "pii-candidates")
    fitted = fit(staged(planted(found, docs), "pii-plants"), **options)
    rows = found.withColumn("base", F.col("strict") & F.col("ok"))
    score, limit = F.lit(0.0), F.lit(2.0)
    if fitted:
        score = F.expr(fitted[0])
        for kind, least in fitted[1].items():
            limit = F.when(F.col("kind") == kind, F.lit(float(least))).otherwise(limit)
    rows = rows.withColumn("score", score).withColumn("added", ~F.col("strict") & (score >= limit))
    rows = rows.filter("base or added")
    # Added spans that overlap a base span go: the base spans up to here reach to ``reach``, those from
    # here on begin at ``next``.
    ahead = Window.partitionBy("d", "th").orderBy("start")
    behind = Window.partitionBy("d", "th").orderBy(F.col("start").desc())
    rows = rows.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(ahead))
    rows = rows.withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (
        F.coalesce("next", F.lit(2**31 - 1)) >= F.col("end")
    )
    rows = rows.filter(F.col("base") | clear)
    span = F.struct("kind", "start", "end")
    per_doc = rows.groupBy("d", "th").agg(
        F.array_sort(F.collect_set(F.when(F.col("base"), span))).alias("base"),
        F.array_sort(
            F.collect_set(F.when(F.col("added"), F.struct((-F.col("score")).alias("s"), "start", "kind", "end")))
        ).alias("more"),
    )

    def take(kept: Column, c: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"]))
        own = F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(own)))

    # Only added spans, which are few, are held against each other.
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    kept = F.aggregate("more", nothing, take)
    per_doc = per_doc.withColumn(
        "spans",
        F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", kept))),
    )
    kind = "array<struct<kind:int,start:int,end:int>>"
    none = F.array().cast(kind)
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64("text").alias("th")]
    return (
        docs.select("doc_id", *keys)
        .join(per_doc, ["d", "th"], "left")
        .select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    )


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(text, ",")
