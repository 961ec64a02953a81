"""Clean, ordered speaker turns from raw transcripts.

Method: one Aho-Corasick automaton finds speaker labels, fillers, sound notes
and time marks; context rules decide which findings count; interval subtraction
takes the accepted spans out of the text; lag and running-count windows over
(video, start, utt_id) build the turns. The windows run over range-sorted chunks
whose first and last turns are merged across chunk borders, so one video that
holds a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinetable.llm.runs import collapse_runs
from cinetable.operators.interval_union import IntervalMap
from cinetable.plans.columns import to_ms
from cinetable.plans.lineage import materialise

#: Hesitation sounds of the four transcript languages.
FILLERS = (
    "uh uhh uhm um umm er erm eh ehm em hm hmm mhm mmm mm-hmm mm-mm uh-huh uh-uh "
    "euh heu hum äh ähm öh öhm hä ehh eeh"
).split() + ["ben euh", "uh huh", "mm hmm"]
#: Fillers only where an ellipsis follows; otherwise words.
DRAWN_OUT = ["este", "pues", "bueno"]
#: Words that are no speech where nothing else is left.
ONLY_BESIDE_FILLERS = {"ben", "este", "bah"}
#: Fillers that are words of German: there only where nothing but fillers is left.
GERMAN_WORDS = {"um", "er"}
#: Frequent words that tell German from the other languages, and such words of these.
GERMAN_CONTEXT = set(
    "der die das den dem des ein eine einen einem einer und ist sind nicht mit auf für sich wird werden noch sie wir ich zu zum zur im am "
    "aber auch aus bei beim bis bitte da dann dass dem denn dort durch euch gegen geht gehen gibt habe haben hat heute hier ihm ihn ihr immer "
    "ja jetzt kann kein keine kommt kommen los macht man mehr mir mich morgen muss nach nur oder schon sehr sein seine so soll über uhr uns "
    "unter vom von vor war warum was weil wenn wer wie wieder wo ohne zwei drei vier fünf sechs sieben acht neun zehn elf zwölf".split()
)
OTHER_CONTEXT = set(
    "the a an and is are was were not with on for to of in it this that we you i he she they at by be have has go "
    "el la los las un una y es no con en para por que se le les des du et est pas avec dans sur qui il elle nous vous".split()
)

#: Words and phrases of sound notes; they count inside brackets or note signs.
NOTES = (
    "noise|music|musik|música|musique|cough|coughs|coughing|laughs|laughter|laughing|applause|applaudissements|"
    "aplausos|applaus|beifall|rires|rire|risas|gelächter|lachen|inaudible|unverständlich|crosstalk|silence|stille|"
    "silencio|blank_audio|blank audio|jingle|door closes|door opens|breath|sigh|sighs|husten|toux|tos|bell|ringing|"
    "static|beep|background noise|bruit|ruido|geräusch|unintelligible"
).split("|")

#: Words that stand before a speaker's number.
LABELS = "spk speaker sprecher sprecherin intervenant intervenante locuteur locutrice hablante orador interlocutor spkr".split()
#: A label of one letter begins many words; it counts only before one of these.
SHORT_LABEL = "s"
BEFORE_NUMBER = " _-n" + "".join(ch for ch in map(chr, range(0x20000)) if ch.isdecimal())
NUMBER_WORDS = {
    word: n
    for words in (
        "one two three four five six seven eight nine ten eleven twelve",
        "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf",
        "un deux trois quatre cinq six sept huit neuf dix onze douze",
        "uno dos tres cuatro cinco seis siete ocho nueve diez once doce",
    )
    for n, word in enumerate(words.split(), 1)
}
OPENING = {"[": "]", "(": ")", "<": ">", "{": "}", "*": "*", "♪": "♪", "♫": "♫", "【": "】"}
_NUMBER = r"(?:no\.?|nr\.?|n°|#)?[\s_#.\-]*(\d{1,9}|[^\W\d_]+)"
_AFTER_LABEL = re.compile(rf"[\s_#.\-]*{_NUMBER}", re.I)
_MARK_OPEN = re.compile(r"\s*(?:>>+\s*|[-–—•]\s*)?([\[(<{]?)\s*")
_MARK_CLOSE = re.compile(r"\s*(?:\([^()]{1,20}\)\s*)?(?:[\])>}]\s*[:\-–—]?|:|>+|[-–—](?=\s))\s*")


class _WordCharacters(dict):
    """For ``str.translate``: characters that can't be in a word become spaces."""

    def __missing__(self, code: int) -> int:
        ch = chr(code)
        self[code] = kept = code if ch.isalnum() or ch in "_-'’" else 32
        return kept


_WORD_CHARACTERS = _WordCharacters()
_OUTER_HYPHEN = re.compile(r"(?<![^\W_])-|-(?![^\W_])")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Whole words and phrases between spaces; a label may be followed by anything."""
    built = ahocorasick.Automaton()
    entries = [(kind, word, f" {word} ", 1) for kind, words in (("filler", FILLERS), ("drawn", DRAWN_OUT), ("note", NOTES)) for word in words]
    entries += [("label", word, f" {word}", 0) for word in LABELS]
    entries += [("label", SHORT_LABEL, f" {SHORT_LABEL}{after}", 1) for after in BEFORE_NUMBER]
    for kind, word, entry, closed in entries:
        built.add_word(entry, (*built.get(entry, ()), (kind, len(word), closed)))
    built.make_automaton()
    return built


def _findings(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the automaton's entries in a text, by kind."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)
    low = low.translate(_WORD_CHARACTERS)
    if "-" in low:
        low = _OUTER_HYPHEN.sub(" ", low)
    found: dict[str, list[tuple[int, int]]] = {}
    for last, entries in automaton().iter(f" {low} "):
        for kind, length, closed in entries:
            end = last - closed  # the text is shifted by the space before it
            found.setdefault(kind, []).append((end - length, end))
    return found


def _wordlike(ch: str) -> bool:
    return ch.isalnum() or ch in "_'’"


def _number(text: str) -> int | None:
    if text.isdecimal():
        return int(text)
    return NUMBER_WORDS.get(text.lower())


@lru_cache(maxsize=20_000)
def named_speaker(label: str | None) -> int | None:
    """The number that a speaker column names, if any."""
    text = (label or "").strip()
    if text.isdecimal():
        return int(text)
    for start, end in sorted(_findings(text).get("label", ())):
        if (after := _AFTER_LABEL.match(text, end)) and (n := _number(after[1])) is not None:
            if after[1].isdecimal() or not _wordlike(text[end : end + 1] or " "):
                return n
    return None


def _speaker_mark(text: str, labels: list[tuple[int, int]], begin: int) -> tuple[int, int, int] | None:
    """(start, end, number) of a speaker mark at ``begin``: it must be bracketed or closed by a sign."""
    if any(map(str.isalnum, text[begin : min(labels)[0]])):
        return None
    opening = _MARK_OPEN.match(text, begin)
    for start, end in labels:
        if start != opening.end():
            continue
        after = _AFTER_LABEL.match(text, end)
        if not after or (n := _number(after[1])) is None or (not after[1].isdecimal() and _wordlike(text[end : end + 1] or " ")):
            continue
        closing = _MARK_CLOSE.match(text, after.end())
        if closing and (not opening[1] or OPENING[opening[1]] in closing[0]):
            return opening.start(), closing.end(), n
        if not text[after.end() :].strip():
            return opening.start(), len(text), n
    return None


def _bracketed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span with the brackets, in as many layers as there are, that hold nothing else."""
    around = None
    while True:
        left, right = start - 1, end
        while left >= 0 and text[left].isspace():
            left -= 1
        while right < len(text) and text[right].isspace():
            right += 1
        if left < 0 or right >= len(text) or OPENING.get(text[left]) != text[right]:
            return around
        start, end = around = left, right + 1


_TIME = re.compile(r"(?<![\d:.,])\d{1,3}:\d{2}(?::\d{2}(?:[.,]\d{3})?)?(?![\d:])")
_DASH = re.compile(r"\s*[-–—](?=\W|$)")


def _time_spans(text: str) -> Iterator[tuple[int, int]]:
    for mark in _TIME.finditer(text):
        start, end = mark.span()
        if around := _bracketed(text, start, end):
            yield around
            continue
        exact = end - start >= 11  # with milliseconds
        dash = _DASH.match(text, end)
        at_start = not any(ch.isalnum() for ch in text[:start])
        alone = at_start and not any(ch.isalnum() for ch in text[end:])
        if exact or dash or alone or (at_start and end - start >= 7):
            yield start, dash.end() if dash else end


_ELLIPSIS = re.compile(r"\s*(?:…|\.{2,})")
_EMPTY = re.compile(r"\[\s*\]|\(\s*\)|<\s*>|\{\s*\}|\*\s*\*|([♪♫])(?:\s*[^\W\d_]+[,.…]*){0,3}\s*\1")
_BRACKET = re.compile(r"[\[(<{*♪♫]")


def _is_german(text: str, fillers: list[tuple[int, int]], german: bool) -> bool:
    """Whether the words beside the fillers are German; ``german`` decides where they don't tell."""
    words = set(re.findall(r"[^\W\d_]+", text.lower())).difference(*(text[a:b].lower().split() for a, b in fillers))
    own, others = len(words & GERMAN_CONTEXT) + any(ch in word for word in words for ch in "äöüß"), len(words & OTHER_CONTEXT)
    return own > others or (german and own == others and bool(words))


def _filler_spans(text: str, found: dict, german: bool) -> Iterator[tuple[int, int]]:
    fillers, words = found.get("filler", []), None
    for start, end in fillers:
        if text[start:end].lower() in GERMAN_WORDS:
            if words is None:
                words = _is_german(text, fillers, german)
            if words:
                continue
        yield start, end + (text[end : end + 1] == ",")
    for start, end in found.get("drawn", ()):
        if ellipsis := _ELLIPSIS.match(text, end):
            yield start, ellipsis.end()


def _note_spans(text: str, found: dict) -> Iterator[tuple[int, int]]:
    for start, end in found.get("note", ()):
        if around := _bracketed(text, start, end):
            yield around
    # brackets that hold nothing, and note signs around at most three words
    for empty in _EMPTY.finditer(text):
        yield _bracketed(text, *empty.span()) or empty.span()


def subtract(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """The text without the spans; a space takes the place of each."""
    if len(spans) == 1:
        start, end = spans[0]
        return f"{text[:start]} {text[end:]}"
    taken = IntervalMap()
    for start, end in spans:
        if end > start:
            taken.insert(start, end)
    kept, at = [], 0
    for start, end, _ in taken.periods():
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return " ".join(kept)


_AFTER_SPACE = re.compile(r" [,;:.!?…\-–—]")
_LOOSE = re.compile(r"(?:(?<=\s)|^)[,;:.…\-–—]+(?=\s|$)")
_WORD = re.compile(r"\w+")
_DOUBLED = re.compile(r"\s+([,;:.!?…])")


def clean_utterance(text: str | None, german: bool = False) -> tuple[int | None, str]:
    """(number of the speaker mark at the start, text without marks, notes and fillers).

    The text is empty if nothing but these and punctuation was there. ``german``
    says that the text is declared to be German.
    """
    rest, speaker, changed = " ".join((text or "").split()), None, False
    while True:  # a note may hold a filler, a mark may follow a time; every round shortens the text
        found = _findings(rest)
        spans = [*_filler_spans(rest, found, german)] if "filler" in found or "drawn" in found else []
        if _BRACKET.search(rest):
            spans += _note_spans(rest, found)
        if ":" in rest:
            spans += _time_spans(rest)
        if "label" in found and speaker is None and (mark := _speaker_mark(rest, found["label"], 0)):
            speaker = mark[2]
            spans.append(mark[:2])
        if not spans:
            break
        rest, changed = " ".join(subtract(rest, spans).split()), True
    if not any(map(str.isalnum, rest)) or (changed and all(w[0].lower() in ONLY_BESIDE_FILLERS for w in _WORD.finditer(rest))):
        return speaker, ""
    if changed and (_AFTER_SPACE.search(rest) or not rest[0].isalnum()):
        rest = _DOUBLED.sub(r"\1", " ".join(_LOOSE.sub(" ", rest).split()))
    return speaker, rest.strip(" ,;-–—")


CLEAN = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("utt_id", T.LongType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def clean_utterances(utterance: DataFrame) -> DataFrame:
    """video_id, utt_id, start_ms, end_ms, speaker (``SPKn`` or ``UNK``) and clean text of the utterances that hold speech."""
    arrow = to_arrow_schema(CLEAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, keep, names, texts = batch.column(5).to_pylist(), [], [], []
            for i, (label, text, german) in enumerate(zip(batch.column(4).to_pylist(), said, batch.column(6).to_pylist())):
                marked, clean = clean_utterance(text, german)
                if clean:
                    number = named_speaker(label)
                    number = marked if number is None else number
                    keep.append(i)
                    names.append("UNK" if number is None else f"SPK{number}")
                    texts.append(clean)
            kept = batch.select(batch.schema.names[:4]).take(pa.array(keep, pa.int64()))
            arrays = [kept.column(i).cast(arrow.field(i).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=arrow)

    # a declared language decides about words that are fillers in one language only
    lang = F.coalesce(F.lower(F.trim("lang")).rlike(r"^(?:de|deu|ger|german|deutsch)\b"), F.lit(False)) if "lang" in utterance.columns else F.lit(False)
    rows = utterance.select(
        F.col("video_id").cast("string").alias("video_id"),
        F.col("utt_id").cast("bigint").alias("utt_id"),
        to_ms(F.col("start_sec")).alias("start_ms"),
        to_ms(F.col("end_sec")).alias("end_ms"),
        F.col("speaker").cast("string").alias("speaker"),
        F.col("text").cast("string").alias("text"),
        lang.alias("german"),
    ).where("start_ms is not null and text is not null")
    return rows.mapInArrow(run, CLEAN)


def speaker_turns(utterance: DataFrame, *, gap_ms: int = 300_000, texts: bool = True) -> DataFrame:
    """Turns in order: video_id, speaker, start_ms, end_ms, first_utt_id, last_utt_id, utterances, text.

    A turn is a maximal run of one speaker in (start in ms, utt_id) order with
    no start more than ``gap_ms`` after the preceding one. ``end_ms`` is the
    greatest usable end, null if no utterance of the turn has one.

    Defined results: utterances without start, with a null text or without
    speech are left out; a speaker that nobody names is ``UNK`` and counts as
    one; repeated deliveries count once; null video_ids form a sequence of their
    own; an empty table gives no rows; further columns are ignored.
    """
    spoken = clean_utterances(utterance).withColumn("end_ms", F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms")))
    # written once: the range partitioning below reads its input twice, and cleaning is the costly part
    spoken = materialise(spoken if texts else spoken.drop("text", "end_ms"))
    runs = collapse_runs(
        spoken, ["video_id"], "start_ms", "utt_id", ["speaker"], lambda a, b: a == b,
        gap_ms=gap_ms, end_ms="end_ms" if texts else None, text="text" if texts else None, whole=True,
    )
    ident = utterance.schema["utt_id"].dataType
    return runs.select(
        "video_id",
        F.col("run_speaker").alias("speaker"),
        F.col("first_ms").alias("start_ms"),
        "end_ms",
        F.col("first_id").cast(ident).alias("first_utt_id"),
        F.col("last_id").cast(ident).alias("last_utt_id"),
        F.col("run_count").alias("utterances"),
        "text",
    )
