"""Text functions as column expressions; the few that Spark has no expression for are pandas UDFs on Arrow batches.

Every function takes and returns ``Column``; null goes in, null comes out, unless a docstring says otherwise.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the screening patterns mean it: ASCII and Unicode spaces, byte order mark included; for use inside brackets.
SPACES = r"\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CLASS = f"[{SPACES}]"
#: Next to a token that begins or ends with an ASCII word character: no other such character.
EDGE_BEFORE, EDGE_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: An ASCII word boundary on either side: between a word character and none.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TOKEN = r"[\p{L}\p{N}]+"
#: Control characters but tab and line feed.
UNSAFE = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"


def round6(x: Column) -> Column:
    """Six decimals, half up on the binary value; ``round(x, 6)`` differs on some ratios."""
    return F.floor(x * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0)


def prefixed_sha256(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def _composed(x: Column, compatible: str) -> Column:
    # The Unicode library that comes with Spark, called inside the JVM and only for rows that need it.
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(x, F.lit("")), F.lit(compatible == "KC"))).otherwise(x)


def nfc(x: Column) -> Column:
    return _composed(x, "C")


def nfkc(x: Column) -> Column:
    return _composed(x, "KC")


def unix_lines(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("\r")), F.regexp_replace(x, "\r\n?", "\n")).otherwise(x)


def tokens(x: Column, normalized: bool = True) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept. ``normalized``: the text is in form C already."""
    return F.regexp_extract_all(F.lower(x if normalized else nfc(x)), F.lit(TOKEN), F.lit(0))


def hangul_grams(words: Column, n: int) -> Column:
    """Distinct sorted n-grams of composed Hangul syllables inside each word of an array; other characters end a run."""
    runs = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("[가-힣]+"), F.lit(0))))
    grams = F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substr(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def _hangul_kind(c: str) -> str:
    """L, V, T, LV or LVT of the Unicode grapheme rules, or nothing."""
    p = ord(c)
    if 0x1100 <= p <= 0x115F or 0xA960 <= p <= 0xA97C:
        return "L"
    if 0x1160 <= p <= 0x11A7 or 0xD7B0 <= p <= 0xD7C6:
        return "V"
    if 0x11A8 <= p <= 0x11FF or 0xD7CB <= p <= 0xD7FB:
        return "T"
    if 0xAC00 <= p <= 0xD7A3:
        return "LVT" if (p - 0xAC00) % 28 else "LV"
    return ""


_JOINS = {"L": ("L", "V", "LV", "LVT"), "LV": ("V", "T"), "V": ("V", "T"), "LVT": ("T",), "T": ("T",)}


def hangul_clusters(word: str) -> list[list[str]]:
    """Runs of Hangul grapheme clusters of a word, conjoining jamo kept together."""
    runs: list[list[str]] = []
    last = ""
    for c in word:
        kind = _hangul_kind(c)
        if kind and last and kind in _JOINS[last]:
            runs[-1][-1] += c
        elif kind and last:
            runs[-1].append(c)
        elif kind:
            runs.append([c])
        last = kind
    return runs


def jamo_grams(words: Column, n: int) -> Column:
    """As ``hangul_grams``, for words that may hold conjoining or old jamo: n-grams of grapheme clusters."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def grams(rows: pd.Series) -> pd.Series:
        def of(row):
            if row is None:
                return None
            return sorted({"".join(run[i : i + n]) for w in row if w for run in hangul_clusters(w) for i in range(len(run) - n + 1)})

        return rows.map(of)

    return grams(words)


def feature_sets(x: Column, normalized: bool = True) -> Column:
    """A struct of the three sets of a text: words, bigrams and trigrams."""
    words = tokens(x, normalized)
    return F.struct(F.array_distinct(words).alias("word"), hangul_grams(words, 2).alias("bigram"), hangul_grams(words, 3).alias("trigram"))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(x) + F.regexp_count(x, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def code_unit_order(x: Column) -> Column:
    """A key that sorts texts by UTF-16 units, as scripts do: characters beyond the basic plane before U+E000, not after U+FFFF."""
    return F.encode(x, "UTF-16BE")


def utf16_head(x: Column, limit: int) -> Column:
    """The first ``limit`` UTF-16 units; a pair cut in half becomes U+FFFD."""
    head = F.call_function("java_method", F.lit("org.apache.commons.lang3.StringUtils"), F.lit("left"), F.coalesce(x, F.lit("")), F.lit(limit))
    # Half a pair comes out as a question mark that isn't in the text.
    halved = F.endswith(head, F.lit("?")) & (F.substr(x, F.length(head), F.lit(1)) != "?")
    whole = F.when(halved, F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit("\uFFFD"))).otherwise(head)
    return F.when(F.length(x) * 2 <= limit, x).otherwise(F.when(x.isNotNull(), whole))


def safe_text(x: Column, most: int, lines: bool = False) -> Column:
    """Not empty, at most ``most`` UTF-16 units and free of control characters (tab and line feed allowed by ``lines``)."""
    bad = UNSAFE if lines else r"[\x00-\x1F\x7F-\x9F]"
    return F.coalesce((F.length(x) > 0) & (utf16_length(x) <= most) & ~x.rlike(bad), F.lit(False))


def safe_reference(x: Column, most: int = 4096) -> Column:
    """A relative path of plain segments: not absolute, no drive, no backslash, no scheme, no empty or dot segment."""
    parts = F.forall(F.split(x, "/"), lambda p: ~p.isin("", ".", ".."))
    return safe_text(x, most) & ~x.rlike(r"\A[A-Za-z]:|\\|://") & parts


def page_id_like(x: Column) -> Column:
    return F.coalesce(x.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*/[a-z0-9]+(?:-[a-z0-9]+)*\z"), F.lit(False))


def slug_like(x: Column, most: int = 64) -> Column:
    return F.coalesce(x.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z") & (F.length(x) <= most), F.lit(False))


def plain_body(x: Column) -> Column:
    """Line ends as line feeds and none at the end; null if nothing but white space is left."""
    lines = unix_lines(x)
    body = F.when(F.endswith(lines, F.lit("\n")), F.regexp_replace(lines, r"\n+\z", "")).otherwise(lines)
    return F.when(body.rlike(r"\S"), body)


def bounded_body(x: Column, limit: int = 100_000, plain: bool = False, points: bool = False) -> Column:
    """A struct of ``body`` (at most ``limit`` UTF-16 units), ``truncated``, ``original_chars`` and ``valid``.

    Cut text whose end had to be stripped of line feeds no longer has the full length and is marked invalid.
    ``plain``: the text is a ``plain_body`` already. ``points``: code points are counted and cut in place of UTF-16 units.
    """
    body = x if plain else plain_body(x)
    length = F.length if points else utf16_length
    size = length(body)
    cut = F.regexp_replace(F.substr(body, F.lit(1), F.lit(limit)) if points else utf16_head(body, limit), r"\n+\z", "")
    return F.struct(
        F.when(size > limit, cut).otherwise(body).alias("body"), (size > limit).alias("truncated"),
        size.alias("original_chars"), F.when(size > limit, length(cut) == limit).otherwise(body.isNotNull()).alias("valid"),
    )


def shannon_entropy(x: Column) -> Column:
    """Bits a character; 0 for the empty string."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    size = F.length(x).cast("double")
    share = lambda c: (F.length(x) - F.length(F.replace(x, c))) / size
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def percent_encoded(x: Column) -> Column:
    """Like the URI component encoding of browsers: UTF-8 bytes but letters, digits and ``-_.!~*'()``."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, char in (("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def component_decoded(x: Column) -> Column:
    """The text of a percent-encoded URI component; null unless it is encoded in just the way of ``percent_encoded``."""
    text = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    return F.when(percent_encoded(text) == x, text)


def _in_order(x):
    """A decoded JSON value with sorted keys, arrays sorted by their members' own text, and whole numbers without a point."""
    if isinstance(x, dict):
        return {k: _in_order(x[k]) for k in sorted(x, key=_utf16)}
    if isinstance(x, list):
        return sorted(map(_in_order, x), key=lambda y: _utf16(json.dumps(y, separators=(",", ":"), ensure_ascii=False)))
    return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1e21 else x


def _utf16(x: str) -> bytes:
    return x.encode("utf-16-be", "surrogatepass")


def _rendered(v: str | None, indent: int | None, unordered: bool) -> str | None:
    try:
        found = json.loads(v, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except (TypeError, ValueError):
        return None
    if unordered:
        found = _in_order(found)
    if indent is None:
        return json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return json.dumps(found, sort_keys=not unordered, indent=indent, ensure_ascii=False) + "\n"


def canonical_digest(x: Column) -> Column:
    """The SHA-256 of a JSON text in which the order of arrays and keys doesn't count, with its prefix; null if it isn't JSON.

    One text at a time is decoded and rendered, and only digests leave the batch, so no more than the batch itself is held.
    """

    @F.arrow_udf(T.StringType())
    def digests(values: pa.Array) -> pa.Array:
        def one(v):
            text = _rendered(v.as_py(), 2, unordered=True)
            return None if text is None else "sha256:" + hashlib.sha256(text.encode()).hexdigest()

        return pa.array(map(one, values), pa.string())

    return digests(x)


def canonical_json(x: Column, indent: int | None = None, unordered: bool = False) -> Column:
    """JSON text with sorted keys and no spaces (or indented, with a line feed at the end); null if it isn't JSON.

    ``unordered``: arrays are sorted too, by the text of their members, so that permuted values give the same text.
    """

    @F.pandas_udf(T.StringType())
    def render(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _rendered(v, indent, unordered))

    return render(x)


def instant(x: Column) -> Column:
    """An RFC 3339 instant as UTC text with milliseconds; null unless it is a real date, time and offset (at most 14 h)."""
    shape = r"\A(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})\z"
    part = lambda i: F.regexp_extract(x, shape, i)
    local = F.try_to_timestamp(F.concat(part(1), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    hours, minutes = F.expr("1") * F.substring(part(3), 2, 2).try_cast("int"), F.substring(part(3), 5, 2).try_cast("int")
    shift = F.when(part(3) == "Z", F.lit(0)).otherwise((hours * 60 + minutes) * F.when(F.substring(part(3), 1, 1) == "-", -1).otherwise(1))
    whole = F.unix_seconds(local) - shift * 60
    millis = F.substring(F.rpad(part(2), 3, "0"), 1, 3)
    good = x.rlike(shape) & local.isNotNull() & (F.substring(x, 12, 2) != "24") & (F.abs(shift) <= 14 * 60) & F.coalesce(minutes < 60, F.lit(True))
    return F.when(good, F.concat(F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), millis, F.lit("Z")))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def record_line(m: Column) -> Column:
    """A map as ``key: value; key: value`` by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")


def section(title: str, body: Column) -> Column:
    """A Markdown section, or null where the body is null or empty."""
    return F.when(F.length(body) > 0, F.concat(F.lit(f"## {title}\n\n"), body))


def document_text(title: Column, *sections: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *sections)
