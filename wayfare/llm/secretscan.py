"""Secret scan by patterns and a battery of randomness tests, in DataFrame functions only.

Three patterns give the base spans, which always stay. Runs of 20 and more characters of the usual
encodings are candidates for more. Each is tested as a string of its inferred encoding (hex, base32,
base36 or base64): a chi-squared test of how evenly its symbols are used, a test of the runs of one class
of symbols (lower case, upper case, digits), and the correlation of each symbol with the next.

Two questions are asked. Could the string be random? All three tests must allow it. Could it be an
ordinary word, name or path? Its symbols are held against those of the whole corpus, which prefers
some letters, and its changes of class against the rate of ordinary text; the two p-values are joined
by Fisher's rule. Both null laws depend on the length. Among the distinct candidates of similar length the
Benjamini-Hochberg rule then bounds the share of false discoveries, so that many short
candidates do not hide the long ones, and do not pass for them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import staged

KINDS = ["assign", "access", "hex", "random"]
LEAST = 20
FALSE_DISCOVERIES = 0.05
#: Standard deviations beyond which a test rejects randomness.
ODD = 3.3
#: Names and paths change class more often than prose: the least rate held against a candidate.
LEAST_RATE = 0.2
_NULL_ID = -(2**63)
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PIECE = 1024

# The three base patterns. A run of hex or access characters is taken whole, so a least
# length can stand in the pattern; group 1 of an assignment is checked afterwards.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "random": rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}",
}
ASSIGNED = 6
_MAY = {
    "assign": lambda t: t.rlike(r"(?i)passw|secret|token|api_?key"),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(r"[0-9a-f]{24}"),
    "random": lambda t: t.rlike(rf"[A-Za-z0-9+/_-]{{{LEAST}}}"),
}
#: name: (what it looks like, symbols, symbols of the class of digits, of upper case, of lower case)
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, (10, 0, 6)),
    "base32": (r"^[A-Z2-7]+$", 32, (6, 26, 0)),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 36, (10, 0, 26)),
    "base64": (r"", 64, (12, 26, 26)),
}


def _matches(text: Column, kind: str) -> Column:
    """array<struct> of (kind, i, gap, m): match i of a pattern, and the characters before it."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # Match i stands between pieces i and i + 1.
    pieces = F.split(text, PATTERNS[kind], -1)
    zipped = F.transform(
        F.arrays_zip(found, F.slice(pieces, 1, F.size(found))),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("i"),
            F.char_length(x["1"]).alias("gap"),
            x["0"].alias("m"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,m:string>>")
    return F.when(_MAY[kind](text), zipped).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """(d, th, kind, start, end, m): every match that passes its check; offsets are code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*[_matches(text, k) for k in KINDS])
    rows = docs.select(*_keys(), F.explode(found).alias("c")).select("d", "th", "c.*").distinct()
    order = Window.partitionBy("d", "th", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("m")).over(order)
    rows = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.char_length("m"))
    assigned = F.char_length(F.regexp_extract("m", _ASSIGN, 1)) >= ASSIGNED
    rows = rows.filter((F.col("kind") != KINDS.index("assign")) | assigned)
    return rows.select("d", "th", "kind", "start", "end", "m")


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("d"), F.xxhash64("text").alias("th")]


def corpus_symbols(docs: DataFrame) -> dict[str, int]:
    """Counts over all texts: of each symbol, and of changes of class from one symbol to the next.

    Tasks send one sum per symbol; the driver gets as many. Texts are cut into pieces first, so that
    a very long one is never an array of its characters.
    """
    pieces = F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))).alias("piece")
    symbols = docs.select(pieces).select(F.explode(F.split("piece", "")).alias("symbol"))
    counts = dict(symbols.filter(F.col("symbol").isin(*_SYMBOLS)).groupBy("symbol").count().collect())
    changes = {"digits": "[0-9][A-Za-z]|[A-Za-z][0-9]", "cases": "[a-z][A-Z]|[A-Z][a-z]"}
    row = docs.agg(*[F.sum(F.regexp_count("text", F.lit(p)).cast("long")).alias(n) for n, p in changes.items()]).first()
    return {**dict.fromkeys(_SYMBOLS, 0), **counts, **{n: row[n] or 0 for n in changes}}


def null_laws(counts: dict[str, int], least_rate: float = LEAST_RATE) -> dict[str, tuple[float, float, float]]:
    """(chance that two ordinary symbols agree, that three agree, rate of changes of class) by encoding."""
    seen = {c: counts[c] + 1 for c in _SYMBOLS}
    folded = {c: seen[c] + seen.get(c.upper(), 0) if c.islower() else seen[c] for c in seen if not c.isupper()}
    # Capitals alone are ordinary words in capitals: they share the letters of all words.
    upper = {c.upper(): n for c, n in folded.items() if c.islower() or c in "234567"}
    used = {
        "hex": {c: folded[c] for c in "0123456789abcdef"},
        "base32": upper,
        "base36": {c: n for c, n in folded.items() if c.isalnum()},
        "base64": seen,
    }
    total = sum(seen.values())
    rates = {n: counts["digits"] / total for n in used}
    rates["base64"] += counts["cases"] / total
    out = {}
    for name, symbols in used.items():
        total = sum(symbols.values())
        two, three = (sum((n / total) ** k for n in symbols.values()) for k in (2, 3))
        out[name] = two, three, min(0.9, max(least_rate, rates[name]))
    return out


def _by_encoding(values: dict[str, float]) -> Column:
    out = F.lit(float(values["base64"]))
    for name in ("hex", "base32", "base36"):
        out = F.when(F.col("encoding") == name, F.lit(float(values[name]))).otherwise(out)
    return out


def _normal_form(rows: DataFrame) -> DataFrame:
    """``rows`` with encoding, and body: the symbols of ``m`` without padding, in one spelling."""
    bare = F.regexp_replace("m", "=+$", "")
    plain = F.replace(bare, F.lit("-"), F.lit(""))
    rows = rows.withColumns({"__bare": bare, "__plain": plain})
    encoding, body = F.lit("base64"), F.translate("__bare", "-_", "+/")
    for name in ("base36", "base32", "hex"):
        # Hyphens part the groups of a hex string; elsewhere they are symbols.
        source = F.col("__plain" if name == "hex" else "__bare")
        fits = source.rlike(ENCODINGS[name][0])
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
        body = F.when(fits, source if name == "base32" else F.lower(source)).otherwise(body)
    return rows.withColumns({"encoding": encoding, "body": body}).drop("__bare", "__plain")


def _serial(body: Column) -> Column:
    """Correlation of each symbol's number with the next one's; 1 for a string of one symbol.

    The string is walked in pieces, so that a very long one is never an array of its characters.
    """

    def number(c):
        return F.instr(F.lit(_SYMBOLS), c).cast("double")

    def step(s, c):
        x = number(c)
        return F.struct(
            x.alias("last"),
            (s["n"] + 1).alias("n"),
            (s["sum"] + x).alias("sum"),
            (s["squares"] + x * x).alias("squares"),
            (s["products"] + F.coalesce(s["last"], F.lit(0.0)) * x).alias("products"),
            F.coalesce(s["first"], x).alias("first"),
        )

    zero = F.lit(0.0)
    none = F.lit(None).cast("double")
    start = F.struct(
        none.alias("last"), zero.alias("n"), zero.alias("sum"), zero.alias("squares"), zero.alias("products"), none.alias("first")
    )
    pieces = F.regexp_extract_all(body, F.lit(f".{{1,{_PIECE}}}"), F.lit(0))
    walked = F.aggregate(pieces, start, lambda s, piece: F.aggregate(F.split(piece, ""), s, step))

    def correlation(s):
        spread = s["squares"] * s["n"] - s["sum"] * s["sum"]
        # Closed to a ring, so that sums of both neighbours agree.
        shared = (s["products"] + s["last"] * s["first"]) * s["n"] - s["sum"] * s["sum"]
        return F.when(spread > 0, shared / spread).otherwise(F.lit(1.0))

    return F.transform(F.array(walked), correlation)[0]


def battery(rows: DataFrame, laws: dict[str, tuple[float, float, float]], odd: float = ODD) -> DataFrame:
    """``rows`` (m, ...) with encoding, band (of length), log_p and plausible.

    ``plausible``: no test rejects that the string is random. ``log_p``: the logarithm of the p-value of the
    law that it is an ordinary string, at least as large as the exact one.
    """
    rows = _normal_form(rows)
    squares = F.lit(0.0)
    for c in _SYMBOLS:
        n = (F.char_length("body") - F.char_length(F.replace(F.col("body"), F.lit(c), F.lit("")))).cast("double")
        squares = squares + n * n
    turns = F.regexp_count("body", F.lit(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9+/])[^0-9+/]"))
    rows = rows.withColumns(
        {
            "__n": F.char_length("body").cast("double"),
            "__squares": squares,
            "__turns": turns.cast("double"),
            "__serial": _serial(F.col("body")),
        }
    )
    n, symbols = F.col("__n"), _by_encoding({e: v[1] for e, v in ENCODINGS.items()})
    chi = symbols * F.col("__squares") / n - n
    # Under randomness: evenness, changes of class and correlation in standard deviations.
    uneven = (chi - (symbols - 1)) / F.sqrt(2 * (symbols - 1) * (n - 1) / n)
    change, spread = {}, {}
    for name, (_, k, classes) in ENCODINGS.items():
        shares = [c / k for c in classes]
        change[name] = 1 - sum(q * q for q in shares)
        spread[name] = sum(q * (1 - q) ** 2 for q in shares) - change[name] ** 2
    rate = _by_encoding(change)
    variance = (n - 1) * rate * (1 - rate) + 2 * (n - 2) * _by_encoding(spread)
    turned = (F.col("__turns") - (n - 1) * rate) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
    serial = (F.col("__serial") + 1 / n) * F.sqrt(n)
    plausible = (F.abs(uneven) <= odd) & (F.abs(turned) <= odd) & (F.abs(serial) <= odd)
    # Under the law of ordinary strings: equal pairs of symbols, and changes of class.
    two, three, common = (_by_encoding({e: v[i] for e, v in laws.items()}) for i in range(3))
    pairs = n * (n - 1) / 2
    expected = symbols * (1 + (n - 1) * two) - n
    scatter = (2 * symbols / n) * F.sqrt(
        pairs * (two - two * two) + n * (n - 1) * (n - 2) * F.greatest(three - two * two, F.lit(0.0))
    )
    short = F.greatest((expected - chi) / F.greatest(scatter, F.lit(1e-9)), F.lit(0.0))
    log_even = F.when(short > 0, -short * short / 2 - math.log(2)).otherwise(F.lit(0.0))
    # Chernoff's bound for so many changes.
    seen = F.least(F.col("__turns") / (n - 1), F.lit(1 - 1e-9))
    apart = seen * F.log(F.greatest(seen, F.lit(1e-9)) / common) + (1 - seen) * F.log((1 - seen) / (1 - common))
    log_turns = F.when(seen > common, -(n - 1) * apart).otherwise(F.lit(0.0))
    both = log_even + log_turns
    rows = rows.withColumns({"__both": both, "plausible": (n >= 2) & plausible})
    log_p = F.when(F.col("plausible"), F.col("__both") + F.log(1 - F.col("__both"))).otherwise(F.lit(0.0))
    band = F.floor(2 * F.log2(F.greatest(n, F.lit(1.0)) / LEAST)).cast("int")
    rows = rows.withColumns({"log_p": log_p, "band": band})
    return rows.drop("body", "__n", "__squares", "__turns", "__serial", "__both")


def discoveries(tested: DataFrame, share: float = FALSE_DISCOVERIES) -> dict[int, float]:
    """{band: largest log_p that is selected} by the rule of Benjamini and Hochberg within each band.

    ``tested`` has a row for each distinct candidate. p-values are rounded up to a grid of 1/200 of a natural logarithm
    down to exp(-100), so a band has at most 20,001 of them, however many candidates.
    """
    grid = F.greatest(F.ceil(F.col("log_p") * 200), F.lit(-20_000)).alias("grid")
    counts = tested.groupBy("band", grid).count()
    up = Window.partitionBy("band").orderBy("grid")
    counts = counts.withColumn("k", F.sum("count").over(up)).withColumn("m", F.sum("count").over(Window.partitionBy("band")))
    good = counts.filter(F.col("grid") / 200 <= F.log(share * F.col("k") / F.col("m")))
    return {r["band"]: r["grid"] / 200 for r in good.groupBy("band").agg(F.max("grid").alias("grid")).collect()}


def secrets(docs: DataFrame, share: float = FALSE_DISCOVERIES, least_rate: float = LEAST_RATE, odd: float = ODD) -> DataFrame:
    """(doc_id, base, spans) of every row of ``docs`` (doc_id, text): arrays of (start, kind, end) in order.

    ``kind`` is the number of the kind in ``KINDS``; offsets are code points, end exclusive. ``base`` are the
    matches of the three patterns that pass their checks, ``spans`` these and the candidates that
    the battery selects, of kind random. Added spans overlap neither base spans nor each other. ``share``
    bounds the expected share of ordinary strings among the added ones of each band of lengths.
    Null and empty texts have no spans. Every row gives one row: rows equal in id and text get equal
    results, ids may repeat or be null. A string counts once in the tests, however many copies
    it has. Other columns are ignored; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    found = staged(candidates(docs), "secret-candidates")
    laws = null_laws(corpus_symbols(docs), least_rate)
    random = F.col("kind") == KINDS.index("random")
    limits = discoveries(battery(found.filter(random).select("m").distinct(), laws, odd), share)
    limit = F.lit(None).cast("double")
    for band, value in limits.items():
        limit = F.when(F.col("band") == band, F.lit(float(value))).otherwise(limit)
    added = battery(found.filter(random), laws, odd).filter(F.ceil(F.col("log_p") * 200) / 200 <= limit)
    columns = ["d", "th", "kind", "start", "end"]
    rows = found.filter(~random).select(*columns).unionByName(added.select(*columns))
    rows = rows.withColumn("base", F.col("kind") != KINDS.index("random"))
    # Base spans up to here reach to ``reach``, those from here on begin at ``next``.
    ahead = Window.partitionBy("d", "th").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("d", "th").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(ahead))
    rows = rows.withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.lit(2**31 - 1)) >= F.col("end"))
    span = F.struct("start", "kind", "end")
    per_doc = (
        rows.filter(F.col("base") | clear)
        .groupBy("d", "th")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
            F.array_sort(F.collect_list(span)).alias("spans"),
        )
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (
        docs.select("doc_id", *_keys())
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
