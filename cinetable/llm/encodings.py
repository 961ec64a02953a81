"""Detection and repair of text decoded with the wrong character encoding.

Method: a hidden Markov model with one clean state and one state per encoding
pair labels the characters; each labelled span gets its state's inverse
transform. ASCII looks alike in every state, so a state holds on through it and
weak signs in one text support each other. The emission of a character in a
pair's state is how plausible the *original* character is in its place, which is
the only table the model needs; in a German, Spanish or French text, a letter that the
language doesn't have counts as less plausible where a pair gives one that it has. Texts garbled twice or more are labelled again
after each repair. One pass without a shuffle, whole texts.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinetable.plans.columns import col, free_name, other_columns

#: UTF-8 bytes read by these single-byte encodings.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "iso8859-15")
#: Bytes of the first encoding read by the second.
MISREAD = (
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
)
ENTER, LEAVE = -6.0, -0.5  # log-odds of beginning and ending a garbled span
IMPOSSIBLE = -14.0
LOST = "�"

COMMON_LOWER = set("éèêëàâäáçùûüúôöóîïíñßœ")
COMMON_UPPER = set("ÉÈÊËÀÂÄÁÇÙÛÜÚÔÖÓÎÏÍÑŒ")
OPENING = set("“„«‹¿¡")
CLOSING = set("”»›")
#: Letters of the languages that single signs are judged by, and frequent words that tell them from other languages.
ALPHABETS = {"de": set("äöüß"), "es": set("áéíóúñü"), "fr": set("àâæçéèêëîïôœùûüÿ")}
FREQUENT = {
    "de": "und der die das den dem ist nicht ein eine einen einer mit auf zu von sich ich wir sie für im zum zur wird werden auch noch wie bei nach vor über aber haben hat sind dass oder nur wenn kein keine",
    "es": "el los las que y con por para una del como pero más está muy también sobre cuando hay sin este esta ese esa lo al sus entre ya",
    "fr": "le les des et est une du dans qui pas pour avec sur ce cette il elle nous vous ils au aux ne se sont mais ou où par plus fait être après leur",
}
VOWELS = set("aeiouyäöü")
FOREIGN = -10.5  # a clean letter that the text's language doesn't have, where a pair gives one that it has
SIGNS = set("€£¥§©®™½¼¾±×÷²³µ¹ªº°•·†‡‰←→↑↓−≤≥≈∞")


def _charset(name: str) -> str:
    """The 256 characters of an encoding; bytes it leaves undefined are C1 controls."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


@dataclass(frozen=True)
class State:
    """An encoding pair: ``bytes_of`` takes the characters back to the bytes they were."""

    name: str
    bytes_of: dict[str, int]
    charset: str | None  # what the bytes were, None for UTF-8


def _states() -> list[State]:
    states = []
    for name in UTF8_READ_AS:
        states.append(State(f"utf-8 as {name}", {ch: b for b, ch in enumerate(_charset(name)) if b > 127}, None))
    for true, read in MISREAD:
        states.append(State(f"{true} as {read}", {ch: b for b, ch in enumerate(_charset(read)) if b > 127}, _charset(true)))
    return states


STATES = _states()
CLEAN, LOSS = 0, len(STATES) + 1  # positions in the vectors; LOSS: replaced, the original is gone


def _telling(alphabet: set[str]) -> dict[str, frozenset[int]]:
    """Small Latin letters outside an alphabet, with the states that take them back to a letter of it."""
    found: dict[str, set[int]] = {}
    for s, state in enumerate(STATES, 1):
        for ch, b in state.bytes_of.items() if state.charset is not None else ():
            if ch.islower() and ch not in alphabet and unicodedata.name(ch, "").startswith("LATIN") and state.charset[b] in alphabet:
                found.setdefault(ch, set()).add(s)
    return {ch: frozenset(states) for ch, states in found.items()}


TELLING = {language: _telling(alphabet) for language, alphabet in ALPHABETS.items()}
_FREQUENT = {language: frozenset(words.split()) for language, words in FREQUENT.items()}
_WORD = regex.compile(r"\p{L}+")


@lru_cache(maxsize=4096)
def _kind(ch: str) -> str:
    """s space or edge, p punctuation, d digit, l lower, u upper, or the script of another letter."""
    if not ch or ch.isspace():
        return "s"
    if ch.isdigit():
        return "d"
    name = unicodedata.name(ch, "")
    if ch.isalpha():
        if name.startswith("LATIN"):
            return "u" if ch.isupper() else "l"
        return name.split(" ")[0].split("-")[0] or "?"
    if unicodedata.category(ch) in ("Mn", "Mc"):
        return "m"
    return "p"


@lru_cache(maxsize=100_000)
def plausible(ch: str, left: str, right: str) -> float:
    """Log-probability of a character between two kinds (``_kind``) in sound text, ASCII being 0."""
    code, letters = ord(ch), ("l", "u")
    if code < 128:
        return 0.0
    if code < 160 or ch == LOST:
        return IMPOSSIBLE
    kind = _kind(ch)
    if kind == "l" and code < 0x180:
        if right == "u" or (left == "u" and right not in ("l", "s", "p", "m")):
            return -8.0
        return -3.0 if ch in COMMON_LOWER else -6.0
    if kind == "u" and code < 0x180:
        if left == "l":
            return -11.0 if ch in COMMON_UPPER else -12.0
        if right == "p":
            return -6.0 if ch in COMMON_UPPER else -8.0
        return -4.5 if ch in COMMON_UPPER else -6.5
    if ch == "’":
        return -3.0 if left in letters and right != "d" else -5.0
    if ch in "‹›":
        return -6.0
    if ch == "‘" or ch in OPENING:
        return -3.5 if left in ("s", "p") and right not in ("s",) else -9.0
    if ch in CLOSING:
        return -3.5 if left != "s" and right in ("s", "p") else -9.0 if ch != "»" else -5.0
    if ch in "–—":
        return -3.0 if left == right == "s" else -5.0 if left in ("d", "p") or right in ("d", "p") else -7.0
    if ch == "…":
        return -3.0 if right not in ("l", "u", "d") or left == "s" else -9.0
    if ch == "°":
        return -4.0 if left in ("d", "s") else -9.0
    if ch in SIGNS:
        if ch in "ªº²³¹" and left in (*letters, "d") and right not in letters:
            return -6.0
        return -4.5 if left in ("s", "d", "p") and right in ("s", "d", "p") else -6.5 if left in ("s", "d", "p") or right in ("s", "p") and ch in "€™©®" else -10.0
    if ch == "\xa0":
        return -5.0
    if ch in "​‌‍⁠﻿︎️":
        return -5.0
    if kind == "m":
        return -4.0 if left not in ("s", "d") else -9.0
    if kind in ("l", "u"):
        return -7.0 if kind == "l" or left != "l" else -12.0
    if kind not in ("p", "d", "s"):
        # a letter of another script stands beside its like
        return -2.5 if (left == kind or right == kind or left in ("s", "p", "d")) and left not in letters and right not in letters else -10.0
    category = unicodedata.category(ch)
    if category in ("So", "Sk") and code >= 0x1F000:
        return -3.0
    if category in ("Po", "Ps", "Pe") and code >= 0x2E80:
        return -3.5
    beside_text = left in letters or right in letters
    if 0x2500 <= code < 0x25A0 and beside_text:
        return -13.0
    return -10.0 if beside_text or category in ("Sk", "Cf", "Cn", "Co") else -7.0


def _sequence(data: list[int | None], i: int) -> tuple[str, int] | None:
    """The UTF-8 character that begins at byte i, and its length."""
    lead = data[i]
    if lead is None or not 0xC2 <= lead <= 0xF4:
        return None
    length = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    part = data[i : i + length]
    if len(part) < length or any(b is None or not 0x80 <= b <= 0xBF for b in part[1:]):
        return None
    try:
        return bytes(part).decode("utf-8"), length
    except UnicodeDecodeError:
        return None


def _restore_run(run: str, state: State) -> list[tuple[int, int, str]]:
    """(start, stop, original) of what the state's inverse transform takes back in a run without ASCII."""
    if state.charset is not None:
        return [(i, i + 1, state.charset[state.bytes_of[ch]]) for i, ch in enumerate(run) if ch in state.bytes_of]
    data, found, i = [state.bytes_of.get(ch) for ch in run], [], 0
    while i < len(run):
        if sequence := _sequence(data, i):
            found.append((i, i + sequence[1], sequence[0]))
            i += sequence[1]
        else:
            i += 1
    return found


def _broken(run: str) -> list[tuple[int, int]]:
    """UTF-8 sequences read as cp1252 that lack their last byte."""
    bytes_of = STATES[0].bytes_of
    data, found, i = [bytes_of.get(ch, 0) for ch in run], [], 0
    while i < len(run):
        if sequence := _sequence(data, i):
            i += sequence[1]
            continue
        stop = i + 1
        while stop < len(run) and 0x80 <= data[stop] <= 0xBF and stop < i + 3:
            stop += 1
        if 0xE0 <= data[i] <= 0xF4 and stop > i + 1:
            found.append((i, stop))
            i = stop
        else:
            i += 1
    return found


@lru_cache(maxsize=50_000)
def emissions(run: str, left: str, right: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Of a run without ASCII: log-emissions (characters x states), where a state's
    byte sequence goes on from the character before, and the most that any one state gains."""
    kinds = [_kind(left), *map(_kind, run), _kind(right)]
    table = np.full((len(run), LOSS + 1), IMPOSSIBLE)
    inside = np.zeros(table.shape, dtype=bool)
    for i, ch in enumerate(run):
        table[i, CLEAN] = plausible(ch, kinds[i], kinds[i + 2])
        if ch in "ÂÃ" and i + 1 < len(run):
            table[i, CLEAN] -= 3.0
        elif i and ch.isupper() and run[i - 1].islower() and kinds[i + 1] not in "lu":
            table[i, CLEAN] -= 5.0  # a capital within a word of another script
        if ch == LOST:
            table[i, CLEAN], table[i, LOSS] = 2 * IMPOSSIBLE, -3.0
    for start, stop in _broken(run):
        table[start, LOSS], table[start + 1 : stop, LOSS] = -3.0, 0.0
        inside[start + 1 : stop, LOSS] = True
    for s, state in enumerate(STATES, 1):
        parts = _restore_run(run, state)
        for n, (start, stop, original) in enumerate(parts):
            before = _kind(parts[n - 1][2]) if n and parts[n - 1][1] == start else kinds[start]
            after = _kind(parts[n + 1][2]) if n + 1 < len(parts) and parts[n + 1][0] == stop else kinds[stop + 1]
            value = plausible(original, before, after)
            if len(original) == 1 and "\x80" <= original <= "\x9f" and state.charset is None:
                value = -5.0  # the outer layer of a text garbled twice
            table[start, s] = value
            table[start + 1 : stop, s] = 0.0
            inside[start + 1 : stop, s] = True
    gain = float((table[:, 1:] - table[:, :1]).clip(min=0).sum(axis=0).max())
    return table, inside, gain


_RUN = regex.compile(r"(?:[^\x00-\x7f]|&[A-Za-z]{1,6}(?:acute|grave|circ|tilde|uml|ring|cedil|slash|lig);)+")
_ENTITY = regex.compile(r"&[A-Za-z]{1,6}(?:acute|grave|circ|tilde|uml|ring|cedil|slash|lig);|.", regex.S)


def _runs(text: str) -> list[tuple[int, list[str], str, str, str]]:
    """(start, spellings, characters, left, right) of every run without ASCII; entities of Latin letters are characters."""
    found = []
    for match in _RUN.finditer(text):
        spelt = match[0]
        units = _ENTITY.findall(spelt) if "&" in spelt else list(spelt)
        characters = [html.unescape(u) if len(u) > 1 else u for u in units]
        if any(len(c) != 1 for c in characters):
            continue
        left = text[match.start() - 1] if match.start() else ""
        right = text[match.end()] if match.end() < len(text) else ""
        found.append((match.start(), units, "".join(characters), left, right))
    return found


def _language(text: str) -> str | None:
    """The language of ``ALPHABETS`` that a text's frequent words tell, None if they tell none or several."""
    words = [w.lower() for w in _WORD.findall(text)]
    counts = sorted(((sum(w in own for w in words), language) for language, own in _FREQUENT.items()), reverse=True)
    (most, language), (second, _) = counts[:2]
    return language if most >= 2 and most > 2 * second and most >= 0.08 * len(words) else None


def _with_foreign(text: str, runs: list, tables: list) -> list:
    """The tables, where single letters that the text's language doesn't have are implausible as they stand.

    Spelling alone can't tell a name of another language: capitalised words count in German only, whose nouns
    are, a word with another letter that the language doesn't have stays as it is, and so does a letter of another
    of the languages, but for a ß that doesn't follow a vowel."""
    seen = set().union(*(characters for _, _, characters, _, _ in runs))
    if not any(seen & telling.keys() for telling in TELLING.values()) or (language := _language(text)) is None:
        return tables
    telling, alphabet, out = TELLING[language], ALPHABETS[language], []
    for (start, units, characters, left, _), (table, inside, gain) in zip(runs, tables):
        if not telling.keys() & set(characters):
            out.append((table, inside, gain))
            continue
        table, stop = table.copy(), start + sum(map(len, units))
        first, last = start, stop
        while first and text[first - 1].isalpha():
            first -= 1
        while last < len(text) and text[last].isalpha():
            last += 1
        others = set(text[first:start] + text[stop:last])
        native = all(ch.isascii() or ch.lower() in alphabet or ch in telling for ch in others) and (language == "de" or not text[first].isupper())
        for i, ch in enumerate(characters):
            before = characters[i - 1] if i else left
            borrowed = ch in COMMON_LOWER and (ch != "ß" or before and before.lower() in VOWELS)
            if native and last - first > 1 and ch in telling and not borrowed and (less := table[i, CLEAN] - FOREIGN) > 0:
                table[i, CLEAN] = FOREIGN
                for s in range(1, LOSS):
                    if s not in telling[ch]:
                        table[i, s] -= less
        out.append((table, inside, float((table[:, 1:] - table[:, :1]).clip(min=0).sum(axis=0).max())))
    return out


def label(text: str) -> list[tuple[int, list[str], str, list[int]]]:
    """(start, spellings, characters, states) of the runs that hold a state other than clean, by Viterbi's algorithm."""
    if text.isascii() and "&" not in text:
        return []
    runs = _runs(text)
    tables = [emissions(characters, left, right) for _, _, characters, left, right in runs]
    if not tables:
        return []
    tables = _with_foreign(text, runs, tables)
    if sum(gain for _, _, gain in tables) < -ENTER:
        return []
    steps = np.concatenate([table for table, _, _ in tables])
    goes_on = np.concatenate([inside for _, inside, _ in tables])
    value = np.full(LOSS + 1, ENTER)
    value[CLEAN] = 0.0
    back = np.empty(steps.shape, dtype=np.int8)
    every = np.arange(LOSS + 1, dtype=np.int8)
    for i, emission in enumerate(steps):
        # stay, or end a span, or begin one from clean (or from another pair through
        # clean); a byte sequence is neither ended nor begun in its middle
        free = np.where(goes_on[i], -np.inf, value)
        best = int(free.argmax())
        leave = free[best] + (LEAVE if best != CLEAN else 0.0)
        source, reached = every.copy(), value.copy()
        if leave > reached[CLEAN]:
            reached[CLEAN], source[CLEAN] = leave, best
        origin = best if leave > value[CLEAN] else CLEAN
        enter = max(leave, value[CLEAN]) + ENTER
        entered = (reached < enter) & ~goes_on[i]
        entered[CLEAN] = False
        reached[entered], source[entered] = enter, origin
        back[i] = source
        value = reached + emission
    states = [int(value.argmax())]
    for row in back[:0:-1]:
        states.append(int(row[states[-1]]))
    states.reverse()
    found, at = [], 0
    for start, units, characters, _, _ in runs:
        own = states[at : at + len(characters)]
        at += len(characters)
        if any(own):
            found.append((start, units, characters, own))
    return found


def _repair_once(text: str) -> tuple[str, set[str], bool]:
    """The text after one round, the pairs that were taken back, and whether anything is lost for good."""
    pairs: set[str] = set()
    out, at, lost = [], 0, False
    for start, units, characters, states in label(text):
        replaced, i = list(units), 0
        while i < len(states):
            stop = i
            while stop < len(states) and states[stop] == states[i]:
                stop += 1
            if states[i] == LOSS:
                lost = True
            elif states[i] != CLEAN:
                state = STATES[states[i] - 1]
                done = 0
                for a, b, original in _restore_run(characters[i:stop], state):
                    replaced[i + a : i + b] = [original] + [""] * (b - a - 1)
                    pairs.add(state.name)
                    done += b - a
                lost |= done < stop - i
            i = stop
        out += [text[at:start], *replaced]
        at = start + sum(map(len, units))
    out.append(text[at:])
    return "".join(out), pairs, lost


def repair(text: str | None) -> tuple[str | None, list[str], bool]:
    """(text with the original where it can be had, encoding pairs by round, whether some of it is lost)."""
    if not text:
        return text, [], False
    pairs: list[str] = []
    lost = False
    seen = set()
    while text not in seen:  # each layer of a text garbled several times; none is taken off twice
        seen.add(text)
        text, found, gone = _repair_once(text)
        lost |= gone
        pairs += sorted(found)
    return text, pairs, lost


MADE = T.StructType(
    [
        T.StructField("restored_text", T.StringType()),
        T.StructField("encoding_pairs", T.ArrayType(T.StringType(), False)),
        T.StructField("is_garbled", T.BooleanType()),
        T.StructField("is_lossy", T.BooleanType()),
    ]
)


def repair_texts(df: DataFrame, text: str) -> DataFrame:
    """All columns but ``text``, then restored_text, encoding_pairs, is_garbled and is_lossy.

    ``restored_text`` is the text itself where nothing is garbled. ``is_lossy``:
    a part can't be restored (U+FFFD, or bytes are missing). Defined results: a
    null text stays null and an empty one empty, neither is garbled; repeated
    rows stay repeated; input columns named like a result are replaced.
    """
    kept, held = other_columns(df, text, *MADE.names), free_name(df, "_text")
    source = df.select(*(col(c) for c in kept), col(text).cast("string").alias(held))
    schema = T.StructType(source.schema.fields[:-1] + list(MADE))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [repair(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            values = (
                [t for t, _, _ in done],
                [p for _, p, _ in done],
                [bool(p) or lost for _, p, lost in done],
                [lost for _, _, lost in done],
            )
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            arrays += [pa.array(v, type=arrow.field(len(kept) + i).type) for i, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)
