"""Text expressions: trimming, tokens, character grams, captions, snippets, URLs."""

from __future__ import annotations

from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore in any script.
WORD = r"[\p{L}\p{N}_]+"
# Every blank character, the full-width one included.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A timing line of a caption file, and the extra lines of strict cleaning.
CUE_TIME = r"^\d{2}:\d{2}:\d{2}\.\d{3}\s+-->\s+\d{2}:\d{2}:\d{2}\.\d{3}$"
CUE_TIME_ANY = r"^(\d{2}:)?\d{2}:\d{2}[.,]\d{3}\s+-->\s+(\d{2}:)?\d{2}:\d{2}[.,]\d{3}(\s.*)?$"
CUE_EXTRA = r"^(WEBVTT.*|\d+|(Kind|Language):.*)$"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def strip(c) -> Column:
    """Trim every kind of blank (``trim`` knows U+0020 only); touches the ends of a text only."""
    return F.btrim(_col(c), F.lit(BLANKS))


def normal_key(c) -> Column:
    """Comparison key: trimmed and lower-cased."""
    return F.lower(strip(c))


def text_or_empty(c) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def tokens(c, pattern: str = WORD) -> Column:
    """All word tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(pattern), F.lit(0))


def token_count(c) -> Column:
    return F.size(tokens(text_or_empty(c)))


def words(c) -> Column:
    """Whitespace-separated pieces of the lower-cased text."""
    pieces = F.split(strip(F.lower(_col(c))), f"[{BLANKS}]+")
    return F.filter(pieces, lambda w: w != "")


def word_grams(word, low: int = 2, high: int = 4) -> Column:
    """Character grams of one word padded by a space on both sides.

    Sizes stop at the padded length, so a one-letter word gives its padded form once.
    """
    padded = F.concat(F.lit(" "), _col(word), F.lit(" "))
    length = F.length(_col(word)) + 2
    sizes = F.sequence(F.lit(low), F.least(F.lit(high), length))
    return F.flatten(
        F.transform(
            sizes,
            lambda n: F.transform(
                F.sequence(F.lit(1), length - n + 1), lambda i: F.substr(padded, i, n)
            ),
        )
    )


def char_grams(c, low: int = 2, high: int = 4) -> Column:
    """Character grams of a whole text; none crosses a word border."""
    return F.flatten(F.transform(words(c), lambda w: word_grams(w, low, high)))


def join_fields(*cols) -> Column:
    """Fields joined by one blank; a null field counts as empty but keeps its blank."""
    return strip(F.concat_ws(" ", *[text_or_empty(c) for c in cols]))


def query_text(text, district=None, budget=None) -> Column:
    """Query text followed by district and budget hints; blank hints are left out."""
    hints = [F.nullif(text_or_empty(h), F.lit("")) for h in (district, budget) if h is not None]
    return strip(F.concat_ws(" ", text_or_empty(text), *hints))


def sentence(template: str, **cols) -> Column:
    """Fill ``{field}`` places of a template; values are never scanned for places again."""
    parts, rest = [], template
    while rest:
        spot = {k: rest.find("{" + k + "}") for k in cols}
        spot = {k: v for k, v in spot.items() if v >= 0}
        if not spot:
            parts.append(F.lit(rest))
            break
        key = min(spot, key=spot.get)
        if spot[key]:
            parts.append(F.lit(rest[: spot[key]]))
        parts.append(text_or_empty(cols[key]))
        rest = rest[spot[key] + len(key) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def snippet(c, size: int = 100) -> Column:
    """Cut first, then put blanks for line breaks."""
    return F.replace(F.substring(text_or_empty(c), 1, size), F.lit("\n"), F.lit(" "))


def clean_captions(c, strict: bool = False) -> Column:
    """One paragraph from a caption file: timing lines and blank lines go.

    ``strict`` also drops the file header, cue numbers and looser timing lines.
    """
    drop = [CUE_TIME] if not strict else [CUE_TIME_ANY, CUE_EXTRA]

    def keep(line: Column) -> Column:
        line = F.rtrim(line) if strict else line
        ok = strip(line) != ""
        for pattern in drop:
            hit = line.rlike(pattern)
            # The cheap test spares most lines the timing pattern.
            ok = ok & ~(F.contains(line, F.lit("-->")) & hit if "-->" in pattern else hit)
        return ok

    return strip(F.array_join(F.filter(F.split(strip(c), r"\r\n|\r|\n"), keep), " "))


def url_parameter(c, name: str = "v") -> Column:
    """Text between ``name=`` and the next ``&``; empty when absent."""
    return F.split_part(F.split_part(_col(c), F.lit(f"{name}="), F.lit(2)), F.lit("&"), F.lit(1))


def folded(texts: pa.Array, step: int = 1 << 20) -> pa.Array:
    """Texts decomposed (NFKD), non-ASCII dropped, about ``step`` bytes of them as Python strings at a time.

    Texts of ASCII alone are as they were and stay in Arrow.
    """
    def fold(text: str) -> str:
        return normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")

    plain = pc.string_is_ascii(texts)
    other = texts.filter(pc.invert(plain))
    size = np.cumsum(pc.binary_length(other).to_numpy(zero_copy_only=False))
    ends = np.searchsorted(size, np.arange(step, size[-1] + step, step)).clip(max=len(other) - 1) + 1 if len(other) else []
    parts, begin = [pa.array([], texts.type)], 0
    for end in np.unique(ends).tolist():
        parts.append(pa.array((fold(x.as_py()) for x in other.slice(begin, end - begin)), texts.type))
        begin = end
    return pc.replace_with_mask(texts, pc.fill_null(pc.invert(plain), False), pa.concat_arrays(parts))


def fold_accents(c) -> Column:
    """Trimmed, lower-cased, decomposed (NFKD), non-ASCII dropped.

    Spark has no normalisation function, so this one expression crosses to Arrow batches.
    Scripts outside ASCII vanish: callers must skip empty keys.
    """
    @F.arrow_udf("string")
    def nfkd(texts: pa.Array) -> pa.Array:
        return folded(texts)

    return nfkd(normal_key(c))
