"""Text expressions: tokens, normal forms, predicates, renderings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop words of the transcript tokenizer.
STOP_WORDS = (
    "le la les de des du un une et à a au aux que qui en dans pour sur par pas plus ne est c ce cette ces ça "
    "donc mais ou où alors avec sans se sa son ses leur leurs y là être avoir faire aller pouvoir devoir comme "
    "on il ils elle elles je tu nous vous te me se moi toi lui eux cet cela ceci "
    "d l j t qu n s m "
    "euh bah hein voilà genre ben ouais ouai oui non"
).split()

@cache
def decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition without combining marks is one other character, these, and
    classes of characters that decompose to several with an ASCII letter or digit among them. Hangul syllables, which decompose by rule to no Latin letter, stay."""
    single, several = [], {}
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != ch:
            single.append((ch, plain))
        elif any(c.isascii() and c.isalnum() for c in plain):
            several[plain] = several.get(plain, "") + ch
    return "".join(a for a, _ in single), "".join(b for _, b in single), several


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, inside the JVM.

    A character that decomposes to one other is translated; of those that decompose to several (``ﬁ``, ``½``, ``㎏``)
    the ones with ASCII letters or digits in them are replaced, by a loop over them where a text holds any."""
    accented, letters, several = decompositions()
    pairs = F.split(F.lit("\n".join(f"[{chars}]\t{plain}" for plain, chars in several.items())), "\n")
    longer = F.aggregate(pairs, text, lambda out, pair: F.regexp_replace(out, F.substring_index(pair, "\t", 1), F.substring_index(pair, "\t", -1)))
    plain = F.when(text.rlike(_blocks("".join(several.values()))), longer).otherwise(text)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.translate(plain, accented, letters), r"\p{M}+", ""))


def _blocks(chars: str) -> str:
    """A class of few ranges that holds the characters, and others in small spaces between them."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code - ranges[-1][1] <= 64:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def plain_text(text: str) -> str:
    """``strip_accents`` of one text on the driver."""
    accented, letters, several = decompositions()
    table = str.maketrans(accented, letters) | {ord(ch): plain for plain, chars in several.items() for ch in chars}
    return "".join(ch for ch in text.translate(table) if not unicodedata.category(ch).startswith("M"))


@F.pandas_udf(T.StringType())
def strip_accents_full(texts: pd.Series) -> pd.Series:
    """The same in Python, for every character."""
    return texts.map(
        lambda t: None if t is None else "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
    )


def tokens(text: Column, *, remove_stop_words: bool = True, full_unicode: bool = False) -> Column:
    """Lower case, accents off, letters and digits only, split at the rest (R2).

    With ``remove_stop_words`` (F12) the listed words and single characters go;
    the list is compared after accents are off, so its accented words stay. A
    null text gives null, an empty one the empty array.
    """
    plain = strip_accents_full(F.lower(text)) if full_unicode else strip_accents(F.lower(text))
    words = F.split(F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " ")), " ")
    words = F.filter(words, lambda w: w != "")
    if remove_stop_words:
        words = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    return words


def normal_text(text: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def looks_like_name(text: Column) -> Column:
    """Two capitalised words in the sense of the GLOB ``[A-Z][A-Za-z]* [A-Z][A-Za-z]*``, where ``*`` is anything."""
    return text.rlike(r"(?s)^[A-Z][A-Za-z].* [A-Z][A-Za-z].*$")


def any_like(text: Column, *needles: str) -> Column:
    """Case-insensitive containment of any of the needles."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.ilike("%" + re.sub(r"([%_\\])", r"\\\1", needle) + "%")
    return found


# What announces that a web search is wanted. The last group of the
# second pattern stands alone, so "internet" matches by itself.
WEB_PATTERNS = (
    r"\b(search|google|web|internet|online|look\s*up|check\s*online|find on the web)\b",
    r"cherche( r)? sur (le|la|les)?\s*web|internet",
    r"recherche en ligne",
    r"regarde sur internet",
    r"sur le web",
)


def wants_web(text: Column) -> Column:
    """Whether a message asks for a web search; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for pattern in WEB_PATTERNS:
        found = found | low.rlike(pattern)
    return found


def json_object_in(text: Column) -> Column:
    """The JSON object of a fenced block, else from the first to the last brace; null if it doesn't parse."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    blob = F.when(fenced != "", fenced).when(bare != "", bare)
    return F.when(F.try_parse_json(blob).isNotNull(), blob)


def safe_stem(name: Column) -> Column:
    """Characters other than letters, digits, ``_`` and ``-`` as ``_``; empty gives ``video``."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_")
    return F.when(F.coalesce(clean, F.lit("")) == "", "video").otherwise(clean)


#: The name ends on the first line; what is said may go on over line ends.
_PREFIX = r"^\[([^\n]*?)\]\s*((?s:.*))$"


def speaker_of_line(line: Column) -> Column:
    """The name in a leading ``[name]``, default ``UNK`` (X13). Line ends may follow the name."""
    return F.when(line.rlike(_PREFIX), F.regexp_extract(line, _PREFIX, 1)).otherwise("UNK")


def line_without_speaker(line: Column) -> Column:
    return F.when(line.rlike(_PREFIX), F.regexp_extract(line, _PREFIX, 2)).otherwise(line)


def ellipsis(text: Column, longer_than: int, keep: int, *, trim_end: bool = False) -> Column:
    """Texts above a length cut to ``keep`` characters and an ellipsis."""
    head = F.substring(text, 1, keep)
    return F.when(F.length(text) > longer_than, F.concat(F.rtrim(head) if trim_end else head, F.lit("…"))).otherwise(text)


# --- similarity of word sets (X9) -------------------------------------------


def _ratio(a: str, b: str) -> float:
    """100 x 2 x common subsequence / total length."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        match = row & places.get(ch, 0)
        row = ((row + match) | (row - match)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """0-100: the best ratio among the shared words and each side's words with its own rest.

    100 if one side's words contain the other's; 0 if a side has no words.
    """
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    if shared and (left <= right or right <= left):
        return 100.0
    one = " ".join(filter(None, [shared, " ".join(sorted(left - right))]))
    other = " ".join(filter(None, [shared, " ".join(sorted(right - left))]))
    best = _ratio(one, other)
    if shared:
        best = max(best, _ratio(shared, one), _ratio(shared, other))
    return best


@F.pandas_udf(T.DoubleType())
def token_set_similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``token_set_ratio`` of two columns in Arrow batches."""
    for left, right in batches:
        yield pd.Series([token_set_ratio(a, b) for a, b in zip(left, right)], dtype="float64")
