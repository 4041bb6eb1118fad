"""Text expressions: tokens, white space, headings, hashes, identifiers.

All are Column expressions but ``nfkc`` and ``heading_similarity``, which have
no built-in and run as Arrow-batched functions on heading text only.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Java's and RE2's plain \\w is ASCII; these classes give the Unicode meaning in both.
WORD = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_TOKEN_UNIT = r"(?U)(?:[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s])"
SPACE = r"(?U)\s+"
#: What ``\\s`` is with ``(?U)``; trimming these is much cheaper than a pattern that looks for them at every place.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space other than one space, which need no change.
_UNEVEN = r"(?U)[^\S ]\s*+| \s++"

#: Titles that are never indexed, and prefixes that title variants drop.
NON_INDEXABLE = r"(?i)^(?:cover|copyright|credits|brief contents|contents in detail|table of contents|foreword.*|acknowledg(?:e)?ments|about the author|about the reviewer|index|www\..*)$"
TITLE_PREFIXES = (r"(?i)^\s*chapter\s+\d+\s*[:.-]?\s*", r"(?i)^\s*appendix\s+[a-z0-9]+\s*[:.-]?\s*", r"(?i)^\s*part\s+[ivxlcdm0-9]+\s*[:.-]?\s*")
NUMERAL = r"(?i)^(?:[0-9]+|[ivxlcdm]+)\z"
EXPLICIT_HEADING = r"(?i)^(?:chapter|part|appendix)\s+"
POINT_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
POINT_PREFIX = "rag-security-chunk:"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(ordered: Column, key, body) -> Column:
    """``body(ordered, a, b)`` for each run of equal ``key(x)`` in an ordered array, from place ``a`` up to before ``b``; one pass, and no rows to group."""

    def of(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (key(F.get(s, i)) != key(F.get(s, i - 1)))))
        return let(first, lambda p: F.transform(p, lambda a, k: body(s, a, F.coalesce(F.get(p, k + 1), n))))

    return let(ordered, of)


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, _UNEVEN, " "))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)" + TOKEN)).cast("long")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+")).cast("long")


def clean_value(c: Column) -> Column:
    """No NUL characters, and one kind of line end."""
    return F.replace(F.replace(F.replace(c, F.lit("\0"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse_whitespace(c: Column) -> Column:
    """Without soft hyphens, no-break spaces as spaces, runs collapsed."""
    return squeeze(F.replace(F.replace(c, F.lit("­"), F.lit("")), F.lit(" "), F.lit(" ")))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_heading(c: Column, compatible: bool = True) -> Column:
    """Case-folded words; ``compatible`` applies NFKC first."""
    return squeeze(F.regexp_replace(casefold(collapse_whitespace(nfkc(c) if compatible else c)), r"[^\p{L}\p{N}_]+", " "))


def heading_skeleton(c: Column, compatible: bool = True) -> Column:
    return F.regexp_replace(normalize_heading(c, compatible), "[^a-z0-9]", "")


def slugify(c: Column, longest: int = 70, compatible: bool = True) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(normalize_heading(c, compatible), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.left(F.when(dashed == "", "section").otherwise(dashed), F.lit(longest)), "-+$", "")


def title_variants(c: Column) -> Column:
    """Sorted distinct forms of a title: itself, and without each numbered prefix."""
    stripped = [strip(F.regexp_replace(c, p, "")) for p in TITLE_PREFIXES]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(collapse_whitespace(c), *(F.when(s != "", s) for s in stripped)))))


def normalize_for_hash(c: Column) -> Column:
    return squeeze(casefold(c))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_for_hash(c), 256)


def margin_text(c: Column) -> Column:
    """Case-folded text with standing numbers and odd characters made alike."""
    numbered = F.regexp_replace(strip(casefold(c)), r"(?U)\b[0-9]+\b", "<number>")
    return strip(F.regexp_replace(F.regexp_replace(numbered, SPACE, " "), r"[^\p{L}\p{N}_<>:/|&.-]+", " "))


def rounded_box(c: Column) -> Column:
    """Coordinates with three decimals; anything but an array is an empty one."""
    return F.coalesce(F.transform(c, lambda x: F.bround(x.cast("double"), 3)), F.array().cast("array<double>"))


def area(box: Column) -> Column:
    value = lambda k: F.get(box, F.lit(k))
    return F.coalesce(F.greatest(F.lit(0.0), (value(2) - value(0)) * (value(3) - value(1))), F.lit(0.0))


def split_paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), r"(?U)\n\s*\n"), strip), lambda p: p != "")


def truncate_tokens(c: Column, budget: Column | int) -> Column:
    """The text up to the end of its token number ``budget``."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    pattern = F.concat(F.lit(r"(?U)^((?:\s*+(?:[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s])){"), F.greatest(budget, F.lit(1)).cast("string"), F.lit("})"))
    cut = F.call_function("regexp_extract", c, pattern, F.lit(1))
    return F.when(budget <= 0, "").when(token_count(c) <= budget, c).otherwise(F.regexp_replace(cut, r"(?U)\s+\z", ""))


def split_tokens(c: Column, most: int) -> Column:
    """Slices of at most ``most`` tokens with their own spacing; a short text stays whole."""
    slices = F.transform(F.regexp_extract_all(c, F.lit(rf"(?U)(?:\s*+(?:[\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_\s])){{1,{most}}}+"), F.lit(0)), strip)
    return F.when(strip(c) == "", F.array().cast("array<string>")).when((F.length(c) <= most) | (token_count(c) <= most), F.array(strip(c))).otherwise(F.filter(slices, lambda s: s != ""))


def split_counted(c: Column, most: int) -> Column:
    """The slices of ``split_tokens`` with their numbers of tokens, ``text, tokens``: all slices but the last are full, so a text is counted once."""

    def of(n: Column) -> Column:
        own = lambda s, tokens: F.struct(s.alias("text"), tokens.alias("tokens"))
        slices = F.regexp_extract_all(c, F.lit(rf"(?U)(?:\s*+(?:[\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_\s])){{1,{most}}}+"), F.lit(0))
        many = F.transform(slices, lambda s, i: own(strip(s), F.least(F.lit(most).cast("long"), n - i * most)))
        return F.when(n == 0, F.array().cast("array<struct<text:string,tokens:bigint>>")).when(n <= most, F.array(own(strip(c), n))).otherwise(many)

    return let(token_count(c), of)


def preview(c: Column, longest: int = 300) -> Column:
    one = squeeze(c)
    return F.when(F.length(one) > longest, F.concat(F.left(one, F.lit(longest - 3)), F.lit("..."))).otherwise(one)


def point_id(chunk_id: Column) -> Column:
    """UUID of version 5 over the chunk id."""
    digest = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), F.concat(F.lit(POINT_PREFIX), chunk_id).cast("binary")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def is_indexable_title(c: Column) -> Column:
    return ~collapse_whitespace(c).rlike(NON_INDEXABLE)


def is_numeral(c: Column) -> Column:
    return collapse_whitespace(c).rlike(NUMERAL)


def _collapse(text: str) -> str:
    return " ".join(text.replace("­", "").replace(" ", " ").split())


def _words(text: str) -> str:
    folded = _collapse(unicodedata.normalize("NFKC", text)).casefold()
    return _collapse("".join(ch if ch.isalnum() or ch == "_" else " " for ch in folded))


@lru_cache(maxsize=4096)
def _forms(text: str) -> tuple[str, str, set[str], Counter, Counter]:
    """Words, bare letters and digits, the set of words, and the characters of both; a page's texts meet all entries near it."""
    words = _words(text)
    bare = "".join(ch for ch in words if ch.isascii() and ch.isalnum())
    return words, bare, set(words.split()), Counter(words), Counter(bare)


def _ratio(a: str, b: str, least: float, of_a: Counter, of_b: Counter) -> float:
    """The matcher's ratio; 0 where lengths or characters in common, its quick ratios, show that it is below ``least``."""
    total = len(a) + len(b)
    if least and total and (2.0 * min(len(a), len(b)) / total < least or 2.0 * sum(min(n, of_b[ch]) for ch, n in of_a.items()) / total < least):
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def similarity(variants: list[str], candidate: str, least: float = 0.0) -> float:
    """How well a block's text fits a title given by its variants, 0 to 1; below ``least`` it may come out too low."""
    words, bare, b, of_words, of_bare = _forms(_collapse(candidate))
    best = 0.0
    for variant in variants:
        own, own_bare, a, of_own, of_own_bare = _forms(variant)
        if not own_bare or not bare:
            continue
        if own_bare == bare:
            return 1.0
        scores = [_ratio(own_bare, bare, least, of_own_bare, of_bare), _ratio(own, words, least, of_own, of_words)]
        scores.append(len(a & b) / len(a | b) if a and b else 0.0)
        if own_bare in bare and len(bare) <= 2 * len(own_bare):
            scores.append(0.96 if bare.startswith(own_bare) else 0.92)
        best = max(best, *scores)
    return round(best, 4)


@F.pandas_udf(DoubleType())
def heading_similarity(variants: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or c is None else similarity(list(v), c) for v, c in zip(variants, candidate)])


@F.pandas_udf(DoubleType())
def likely_similarity(variants: pd.Series, candidate: pd.Series) -> pd.Series:
    """As ``heading_similarity`` from 0.6 on, which is all that an anchor needs; much cheaper below."""
    return pd.Series([None if v is None or c is None else similarity(list(v), c, 0.6) for v, c in zip(variants, candidate)])
