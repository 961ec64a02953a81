"""Language and confidence of texts and of their single-language stretches.

Method: a byte convolutional network. Filters of several widths slide over the
bytes of fixed-length windows, max pooling and softmax give each window's
language. It is trained here, in numpy, on labelled rows of the corpus itself;
the labels are partly wrong, so the rows that a first model firmly contradicts
are left out of a second training. The network is applied to batches of windows
inside ``mapInArrow``: one pass, no shuffle, whole texts. The training sample
(at most ``SAMPLE_TEXTS`` whole texts) and the weights (about
100 KB) are all that the driver holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinetable.llm.turns import clean_utterance
from cinetable.plans.columns import col, free_name, other_columns

LANGUAGES = ("de", "en", "es", "fr")
SAMPLE_TEXTS = 8_000  # labelled texts that train the network
WINDOW, STRIDE = 64, 40  # places, one a byte
BLOCK, MARGIN = 8, 4  # places that are pooled first; bytes that a filter at the last place looks beyond it
SHORT_WORDS, SHORT_CHARS = 4, 18  # less is a name or a technical term, it makes no language
SURE = 0.9  # a short part is a stretch of its own only if its language differs and has at least this share
SWITCH, RUN_WINDOWS = 8.0, 2  # log-odds that a change of language inside a stretch must gain, windows that it must last
UNSURE = 0.4  # of a stretch in which no language has this share none is named
NO_LANGUAGE = "und"
KNOWN_STRETCHES = 100_000  # stretches a worker keeps
MIN_CHARS = 40

#: Usual codes and names of the languages.
CODES = {
    "de": "de deu ger german deutsch alemán allemand",
    "en": "en eng english englisch inglés anglais",
    "es": "es spa esp spanish spanisch español espagnol castellano",
    "fr": "fr fra fre french französisch francés français",
}
_NAMED = {code: language for language, codes in CODES.items() for code in codes.split()}


def named_language(label):
    """Column: the language that a label names, null if none of ``LANGUAGES``."""
    code = F.regexp_extract(F.lower(label), r"(?U)^\s*([^\W\d_]+)(?:[-_.@].*)?\s*$", 1)
    pairs = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
    return pairs[code]


# --- the network ------------------------------------------------------------

Gradients = dict[str, np.ndarray]


class ByteCnn:
    """Byte embedding, filters of several widths with ReLU and max pooling, softmax.

    A window is ``WINDOW`` places and the ``MARGIN`` bytes after them that a filter
    at the last places looks at. All filters are one matrix; narrow ones have zero rows.
    """

    WIDTHS, FILTERS, EMBEDDING = (2, 3, 4, 5), 24, 8

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        hidden, rows = len(self.WIDTHS) * self.FILTERS, max(self.WIDTHS) * self.EMBEDDING
        reach = np.repeat([w * self.EMBEDDING for w in self.WIDTHS], self.FILTERS)
        self.used = (np.arange(rows)[:, None] < reach).astype(np.float32)
        # (filter, place in it) of the rows that aren't zero
        self.own = np.nonzero(self.used[:: self.EMBEDDING].T)
        self.parts: dict[str, np.ndarray] = {
            "e": rng.standard_normal((256, self.EMBEDDING)) * 0.5,
            "filters": rng.standard_normal((rows, hidden)) * np.sqrt(2 / reach) * self.used,
            "b": np.zeros(hidden),
            "out": rng.standard_normal((hidden, len(LANGUAGES))) * np.sqrt(2 / hidden),
            "bias": np.zeros(len(LANGUAGES)),
        }
        self.parts = {k: v.astype(np.float32) for k, v in self.parts.items()}

    def _scores(self, data: np.ndarray, places: int) -> np.ndarray:
        """Filter scores without bias at the first ``places`` of the bytes: places x filters."""
        embedded = self.parts["e"][data[: places + MARGIN]].reshape(-1)
        step = embedded.strides[0]
        columns = np.lib.stride_tricks.as_strided(embedded, (places, len(self.used)), (step * self.EMBEDDING, step))
        return np.ascontiguousarray(columns) @ self.parts["filters"]

    def _log_softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled + self.parts["b"], 0) @ self.parts["out"] + self.parts["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of windows with their margins; side by side with spaces between them they are one text."""
        apart = np.full((len(windows) + 1, WINDOW + BLOCK), 32, np.uint8)
        apart[:-1, : WINDOW + MARGIN] = windows
        return self.log_probabilities_at(apart.reshape(-1)[: len(windows) * (WINDOW + BLOCK) + MARGIN], np.arange(len(windows)) * (WINDOW + BLOCK))

    def log_probabilities_at(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of the windows that begin at ``starts`` (multiples of ``BLOCK``) of ``data`` (whole blocks and ``MARGIN``).

        Every place is scored once, also where windows overlap: the maxima of blocks are
        joined to those of windows."""
        blocks = (len(data) - MARGIN) // BLOCK
        best = np.empty((blocks, len(self.parts["b"])), np.float32)
        for at in range(0, blocks, 128):
            some = min(128, blocks - at)
            scores = self._scores(data[at * BLOCK :], some * BLOCK)
            while len(scores) > some:
                pairs = scores.reshape(len(scores) // 2, 2, -1)
                scores = np.maximum(pairs[:, 0], pairs[:, 1])
            best[at : at + some] = scores
        width = 1
        while width * BLOCK < WINDOW:
            best = np.maximum(best[:-width], best[width:])
            width *= 2
        return self._log_softmax(best[starts // BLOCK])

    def fit(
        self, windows: np.ndarray, labels: np.ndarray, *, epochs: int = 4, rate: float = 3e-3, seed: int = 11, balanced: bool = False
    ) -> None:
        """Adam on the cross-entropy with slightly smoothed labels; ``balanced`` gives every language the same weight."""
        weights = np.ones(len(LANGUAGES), np.float32)
        if balanced:
            shares = np.bincount(labels, minlength=len(LANGUAGES)) / max(1, len(labels))
            weights = (1 / (len(LANGUAGES) * np.maximum(shares, 0.02))).astype(np.float32)
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.parts.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                gradients = self._gradients(windows[batch], labels[batch], weights)
                step += 1
                for key, gradient in gradients.items():
                    first, second = moments[key]
                    first += 0.1 * (gradient - first)
                    second += 0.001 * (gradient * gradient - second)
                    ahead = first / (1 - 0.9**step)
                    self.parts[key] -= (rate * ahead / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Gradients:
        count = len(x)
        scores = self._scores(np.concatenate([x.reshape(-1), np.zeros(MARGIN, np.uint8)]), x.size).reshape(count, -1, len(self.parts["b"]))
        scores = scores[:, :WINDOW]
        where = scores.argmax(axis=1)
        hidden = np.maximum(np.take_along_axis(scores, where[:, None, :], 1)[:, 0] + self.parts["b"], 0)
        logits = hidden @ self.parts["out"] + self.parts["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        error = np.exp(logits)
        error /= error.sum(axis=1, keepdims=True)
        error -= 0.02 / len(LANGUAGES)
        error[np.arange(count), y] -= 0.98
        error *= weights[y][:, None] / count
        back = (error @ self.parts["out"].T) * (hidden > 0)
        filters, places = self.own
        touched = x[np.arange(count)[:, None], where[:, filters] + places].astype(np.intp)
        error_of = np.ascontiguousarray(back[:, filters])
        # one product a filter's place: windows x embedding against the filter's error in each window
        rows = np.einsum("np,npk->pk", error_of, self.parts["e"].take(touched, axis=0))
        gradient = np.zeros_like(self.parts["filters"])
        by_place = gradient.reshape(-1, self.EMBEDDING, len(self.parts["b"]))
        by_place[places, :, filters] = rows
        own = self.parts["filters"].reshape(by_place.shape)[places, :, filters]
        byte = touched.reshape(-1)
        embedding = [np.bincount(byte, (error_of * own[:, k]).reshape(-1), 256) for k in range(self.EMBEDDING)]
        return {
            "e": np.stack(embedding, axis=1).astype(np.float32), "filters": gradient,
            "b": back.sum(axis=0), "out": hidden.T @ error, "bias": error.sum(axis=0),
        }


# --- texts to stretches to windows -----------------------------------------

_BREAK = re.compile(r"\n+|(?<=[.!?…。])[\"'”’»)]*\s+|\s+[/|·•–—-]+\s+")
_SIGN = re.compile(r"[/|·•–—-]")
_SENTENCE_END = re.compile(r"[.!?…。][\"'”’»)]*\s")
_DIGIT = re.compile(r"\d+")
_LATIN = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ɏ]")


def _parts(text: str | None) -> list[tuple[str, bool]]:
    """Sentences and separated phrases of a text without marks, notes and fillers, and whether each is
    long enough to have a language of its own; shorter ones are names or technical terms."""
    out = []
    for line in (text or "").split("\n"):
        line = clean_utterance(line)[1]
        pieces = _BREAK.split(line) if _SIGN.search(line) or _SENTENCE_END.search(line) else (line,)
        for piece in pieces:
            if piece and any(map(str.isalpha, piece)):
                piece = piece.strip(" /|·•–—-")
                out.append((piece, len(piece) >= SHORT_CHARS and piece.count(" ") >= SHORT_WORDS - 1))
    return out


def _scored_parts(parts: list[tuple[str, bool]]) -> list[str]:
    """The parts that tell a text's languages: the long ones, or all short ones together."""
    return [p for p, long in parts if long] or ([" ".join(p for p, _ in parts)] if parts else [])


def stretches(text: str | None) -> list[str]:
    """The parts of a text that may have a language of their own."""
    return _scored_parts(_parts(text))


def without_accents(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))


def padded(stretch: str) -> bytes:
    """The bytes of a stretch in lower case in whole blocks, at least a window, behind ``MARGIN`` spaces."""
    data = b" " * MARGIN + _DIGIT.sub("0", stretch.lower()).encode("utf-8", "replace") + b" "
    return data.ljust(max(WINDOW, -(-len(data) // BLOCK) * BLOCK))


@lru_cache(maxsize=1_000)
def window_starts(length: int) -> tuple[int, ...]:
    """Where the windows of a padded stretch begin, the last one ending where it ends."""
    return (*range(0, length - WINDOW, STRIDE), length - WINDOW)


def windows_of(stretch: str) -> np.ndarray:
    """The windows of a stretch, each with its margin."""
    data = padded(stretch)
    whole = np.frombuffer(data + b" " * MARGIN, np.uint8)
    return np.stack([whole[at : at + WINDOW + MARGIN] for at in window_starts(len(data))])


def _window_scores(model: ByteCnn, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of all windows of the stretches one after the other, and how many each has."""
    pieces = [padded(t) for t in texts]
    starts, counts, at = [], [], 0
    for piece in pieces:
        own = window_starts(len(piece))
        starts += [at + s for s in own]
        counts.append(len(own))
        at += len(piece)
    data = np.frombuffer(b"".join(pieces) + b" " * MARGIN, np.uint8)
    return model.log_probabilities_at(data, np.array(starts)), np.array(counts)


def _stretch_scores(model: ByteCnn, texts: Sequence[str], cuts: dict[str, list[str]] | None = None) -> list[tuple[str, float]]:
    """Language and confidence of each stretch: its windows' mean log-probabilities.

    ``NO_LANGUAGE`` where most letters aren't Latin, or where no language has a share of ``UNSURE``.
    ``cuts`` gets the parts of the stretches whose language changes inside."""
    if not texts:
        return []
    scores, counts = _window_scores(model, texts)
    ends = np.cumsum(counts)
    means = np.add.reduceat(scores, np.concatenate([[0], ends[:-1]]), axis=0) / counts[:, None]
    likely = np.exp(means - means.max(axis=1, keepdims=True))
    likely /= likely.sum(axis=1, keepdims=True)
    best, share = likely.argmax(axis=1), likely.max(axis=1)
    out = []
    for text, b, p in zip(texts, best.tolist(), share.tolist()):
        foreign = p < UNSURE or not text.isascii() and 2 * len(_LATIN.findall(text)) < sum(map(str.isalpha, text))
        out.append((NO_LANGUAGE if foreign else LANGUAGES[b], p))
    if cuts is not None:
        for n in np.flatnonzero(counts >= 2 * RUN_WINDOWS).tolist():
            own = scores[ends[n] - counts[n] : ends[n]]
            if (own.argmax(axis=1) != best[n]).sum() >= RUN_WINDOWS and len(parts := _cut(model, texts[n], own)) > 1:
                cuts[texts[n]] = parts
    return out


def _path(scores: np.ndarray) -> list[int]:
    """The likeliest language of each window if every change costs ``SWITCH`` (Viterbi's algorithm)."""
    value, back = scores[0].astype(float), []
    for row in scores[1:]:
        changed = int(value.argmax())
        back.append(np.where(value >= value[changed] - SWITCH, np.arange(len(value)), changed))
        value = np.maximum(value, value[changed] - SWITCH) + row
    states = [int(value.argmax())]
    for row in reversed(back):
        states.append(int(row[states[-1]]))
    return states[::-1]


def _cut(model: ByteCnn, text: str, scores: np.ndarray) -> list[str]:
    """The parts of a stretch between which the language changes for at least ``RUN_WINDOWS`` windows.

    Windows tell about where; the cut is between the words that suit both languages best."""
    runs: list[list[int]] = []
    for n, state in enumerate(_path(scores)):
        if runs and runs[-1][0] == state:
            runs[-1][2] = n
        else:
            runs.append([state, n, n])
    runs = [r for r in runs if r[2] - r[1] + 1 >= RUN_WINDOWS]
    words = text.split(" ")
    places = np.cumsum([MARGIN] + [len(_DIGIT.sub("0", w.lower()).encode("utf-8", "replace")) + 1 for w in words])
    starts = window_starts(len(padded(text)))
    parts, begin = [], 0
    for (before, _, last), (after, first, _) in zip(runs, runs[1:]):
        if before == after:
            continue
        inside = [w for w in range(begin + SHORT_WORDS, len(words) - SHORT_WORDS + 1) if starts[last] < places[w] < starts[first] + WINDOW]
        if not inside:
            continue
        # the window that ends where the first language would, and that which begins where the second would
        left, sizes = _window_scores(model, [" ".join(words[max(begin, w - WINDOW) : w])[-WINDOW:] for w in inside])
        left = left[np.cumsum(sizes) - 1, before]
        right, sizes = _window_scores(model, [" ".join(words[w : w + WINDOW])[:WINDOW] for w in inside])
        right = right[np.cumsum(sizes) - sizes, after]
        w = inside[int((left + right).argmax())]
        parts.append(" ".join(words[begin:w]))
        begin = w
    return [*parts, " ".join(words[begin:])]


def _epochs(windows: int, steps: int) -> int:
    """Passes that make at least ``steps`` batches, so that a small corpus is learned as well; at most 24."""
    return min(24, -(-steps * 64 // max(1, windows)))


def train(samples: Sequence[tuple[str, str]]) -> ByteCnn:
    """A network from (text, language) pairs, some of which may be wrong."""
    parts = [(s, LANGUAGES.index(language)) for text, language in sorted(samples) for s in stretches(text)]
    # screen text often comes without its accents
    parts += [(plain, y) for s, y in parts if (plain := without_accents(s)) != s]
    pieces = [windows_of(s) for s, _ in parts]
    if not pieces:
        return ByteCnn()
    windows = np.concatenate(pieces)
    labels = np.repeat([y for _, y in parts], [len(p) for p in pieces])
    first = ByteCnn()
    first.fit(windows, labels, epochs=_epochs(len(windows), 250))
    sound = first.log_probabilities(windows).argmax(axis=1) == labels
    model = ByteCnn()
    # balanced only now: before, a rare language's weight would raise that of wrong labels too
    model.fit(windows[sound], labels[sound], epochs=_epochs(int(sound.sum()), 1_500), balanced=True)
    return model


def training_sample(df: DataFrame, text: str, label: str, *, size: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """At most ``size`` different labelled texts, the same ones at every run.

    The sample keeps the corpus' own shares of languages: in equal shares the
    wrongly labelled rows of a frequent language would weigh more among the
    texts of a rare one. They are the texts of the lowest hashes.
    """
    rows = df.count()
    texts = df.select(col(text).alias("text"), col(label).alias("label"), F.xxhash64(col(text)).alias("place"))
    share = 3 * size / max(1, rows)
    while True:
        # the lowest hashes only, about three times as many as needed: else every task would send ``size`` rows
        some = texts.where(F.col("place") < F.lit(int(-(2**63) + 2**64 * share))) if share < 1 else texts
        labelled = some.select("text", named_language(F.col("label")).alias("language"), "place").where(
            F.col("language").isNotNull() & (F.length("text") >= MIN_CHARS)
        )
        # copies of a text count once, they would only narrow the sample
        chosen = labelled.distinct().orderBy("place", "text", "language").limit(size).collect()
        if len(chosen) == size or share >= 1:
            return [(r.text, r.language) for r in chosen]
        share *= 8  # few labels or many copies


# --- the operator -----------------------------------------------------------

STRETCH = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
MADE = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("languages", T.StringType()),
        T.StructField("stretches", T.ArrayType(STRETCH)),
    ]
)


Scored = tuple[str, float]


def _own_stretch(text: str, scored: Scored, beside: str) -> bool:
    """Whether a short part is clearly of another language than the stretch beside it: at least two words, ``SURE``."""
    return scored[0] not in (NO_LANGUAGE, beside) and scored[1] >= SURE and " " in text


def _stretches_of(parts: list[tuple[str, bool]], known: dict[str, Scored]) -> list[dict]:
    """The whole text as single-language stretches: neighbours of one language are one, its confidence the
    mean by length; a short part goes with the stretch before it (the first ones with that after them)
    unless it is clearly of another language."""
    out: list[dict] = []

    def add(text: str, language: str | None, confidence: float, weight: int) -> None:
        last = out[-1] if out else None
        if last is None or language != last["language"]:
            out.append({"text": text, "language": language, "confidence": confidence, "weight": weight})
            return
        last["text"] += " " + text
        if total := last["weight"] + weight:
            last["confidence"] = (last["confidence"] * last["weight"] + confidence * weight) / total
            last["weight"] = total

    if not any(long for _, long in parts):
        whole = " ".join(p for p, _ in parts)
        parts = [(whole, True)] if whole else []
    held: list[str] = []
    for text, long in parts:
        language, confidence = known[text]
        if long:
            for early in held:
                if _own_stretch(early, known[early], language):
                    add(early, *known[early], len(early))
                    held = held[held.index(early) + 1 :]
            before, held = " ".join([*held, text]), []
            add(before, language, confidence, len(text))
        elif not out:
            held.append(text)
        elif _own_stretch(text, known[text], out[-1]["language"]):
            add(text, language, confidence, len(text))
        else:
            add(text, out[-1]["language"], 0.0, 0)
    return [{k: part[k] for k in ("text", "language", "confidence")} for part in out]


def _described(found: list[tuple[int, str, float]]) -> tuple:
    """language, confidence and languages from (length, language, confidence) of the long parts."""
    if len(found) == 1:
        _, main, sure = found[0]
        return main, sure, None if main == NO_LANGUAGE else main
    if not found:
        return None, None, None
    weight: dict[str, int] = {}
    for length, language, _ in found:
        weight[language] = weight.get(language, 0) + length
    main = max(weight, key=lambda k: (weight[k], k))
    sure = sum(length * confidence for length, language, confidence in found if language == main) / weight[main]
    weight.pop(NO_LANGUAGE, None)
    return main, sure, "+".join(sorted(weight)) or None


def detect_languages(df: DataFrame, text: str, model: ByteCnn, *, with_stretches: bool = True) -> DataFrame:
    """All columns of ``df``, then language, confidence, languages and stretches (null without ``with_stretches``).

    ``language`` is that of most of the text, ``languages`` all of them in
    alphabetical order joined by ``+``, ``stretches`` the single-language parts
    in order (text without marks and fillers, language, confidence); they hold the
    whole text. Parts of less than ``SHORT_WORDS`` words or ``SHORT_CHARS`` characters
    (names, terms) are in a stretch but count in ``language`` and ``languages`` only
    where there is nothing else. ``NO_LANGUAGE`` is the language of parts whose letters
    aren't mostly Latin or that are like none of ``LANGUAGES``; it is never in ``languages``.

    Defined results: a null, empty or speechless text has null languages and no
    stretch; repeated rows stay repeated; an empty table stays empty; input
    columns named like a result are replaced.
    """
    kept, held = other_columns(df, *MADE.names), free_name(df, "_text")
    source = df.select(*(col(c) for c in kept), col(text).cast("string").alias(held))
    schema = T.StructType(source.schema.fields[:-1] + list(MADE))
    arrow = to_arrow_schema(schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, known, cuts = shared.value, {}, {}

        def learn(texts: set[str], cut: bool) -> None:
            ordered = sorted(texts, key=len)
            for at in range(0, len(ordered), 512):
                part = ordered[at : at + 512]
                known.update(zip(part, _stretch_scores(network, part, cuts if cut else None)))

        for batch in batches:
            split = [_parts(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            scored = [_scored_parts(parts) for parts in split]
            asked = scored if not with_stretches else [[*some, *(p for p, _ in parts)] for some, parts in zip(scored, split)]
            new = {s for some in asked for s in some if s not in known}
            if len(known) + len(new) > KNOWN_STRETCHES:
                known.clear()
                cuts.clear()
                new = {s for some in asked for s in some}
            learn(new, True)
            if cuts and not cuts.keys().isdisjoint(s for some in scored for s in some):
                split = [[(p, long) for s, long in parts for p in cuts.get(s, (s,))] for parts in split]
                scored = [[p for s in some for p in cuts.get(s, (s,))] for some in scored]
                learn({s for some in scored for s in some if s not in known}, False)
            done = [_described([(len(s), *known[s]) for s in some]) for some in scored]
            found = [_stretches_of(parts, known) for parts in split] if with_stretches else [None] * len(done)
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            columns = [*zip(*done), found] if done else [()] * 4
            arrays += [pa.array(v, type=arrow.field(len(kept) + i).type) for i, v in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


def mislabelled(detected: DataFrame, text: str, label: str) -> DataFrame:
    """The rows of ``detect_languages`` with at least ``MIN_CHARS`` characters whose label is
    missing or names another language, or that mix languages."""
    wrong = ~F.coalesce(named_language(col(label)) == F.col("languages"), F.lit(False))
    return detected.where((F.length(col(text)) >= MIN_CHARS) & F.col("languages").isNotNull() & wrong)
