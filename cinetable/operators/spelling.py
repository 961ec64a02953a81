"""Spelling correction against a frequency dictionary.

Symmetric deletion: two words within two edits share a form that is left after
at most two deletions from each. So candidates come from an equi-join on these
forms, never from comparing all pairs. The forms of a long word would be too many:
there a term is cut in parts, more than two edits can touch, so that one stands in
the word unchanged, moved by two places at most. The distance is then checked exactly
(insert, delete, replace, swap of neighbours).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinetable.plans.columns import col

MAX_EDITS = 2


def deletions(word: str, edits: int = MAX_EDITS) -> set[str]:
    """All forms of a word after at most ``edits`` deletions."""
    forms, newest = {word}, {word}
    for _ in range(edits):
        newest = {w[:i] + w[i + 1 :] for w in newest for i in range(len(w))} - forms
        forms |= newest
    return forms


def edits_between(a: str, b: str, limit: int = MAX_EDITS) -> int:
    """Distance with swaps of neighbours (optimal string alignment); ``limit`` + 1 if it is greater."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


@F.pandas_udf(T.IntegerType())
def _edits(words: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([edits_between(a, b) for a, b in zip(words, terms)], dtype="int32")


PARTS = 2 * MAX_EDITS + 1  # a swap across a border touches two parts


def _cuts(length: int) -> list[tuple[int, int]]:
    """Start and stop of the ``PARTS`` parts of a term."""
    return [(length * n // PARTS, length * (n + 1) // PARTS) for n in range(PARTS)]


def term_parts(term: str) -> set[str]:
    """The parts of a term, each with the term's length and its own number."""
    return {f"{len(term)} {n} {term[a:b]}" for n, (a, b) in enumerate(_cuts(len(term)))}


def word_parts(word: str) -> set[str]:
    """The parts that a term within two edits of the word can share with it."""
    return {
        f"{length} {n} {word[a + move : b + move]}"
        for length in range(len(word) - MAX_EDITS, len(word) + MAX_EDITS + 1)
        for n, (a, b) in enumerate(_cuts(length))
        for move in range(-MAX_EDITS, MAX_EDITS + 1)
        if 0 <= a + move and b + move <= len(word)
    }


def _forms(df: DataFrame, word: str, forms_of: Callable[[str], set[str]] = deletions) -> DataFrame:
    schema = f"{word} string, form string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, form) for w in batch.column(0).to_pylist() for form in forms_of(w)]
            for at in range(0, len(pairs), 50_000):
                words, forms = zip(*pairs[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(forms, pa.string())], names=[word, "form"])

    return df.select(word).mapInArrow(run, schema)


class _Lookup:
    """A small dictionary in memory, by the same forms and parts as the join."""

    def __init__(self, counts: dict[str, int], longest: int) -> None:
        self.counts, self.longest, self.by_form = counts, longest, {}
        for term in counts:
            forms = deletions(term) if len(term) <= longest + MAX_EDITS else set()
            for form in forms | (term_parts(term) if len(term) > longest - MAX_EDITS else set()):
                self.by_form.setdefault(form, []).append(term)

    def best(self, word: str) -> tuple[str, int | None]:
        if word in self.counts:
            return word, 0
        forms = deletions(word) if len(word) <= self.longest else word_parts(word)
        near = {term for form in forms for term in self.by_form.get(form, ())}
        found = [(edits, -self.counts[term], term) for term in near if word and (edits := edits_between(word, term)) <= MAX_EDITS]
        return (min(found)[2], min(found)[0]) if found else (word, None)


def corrections(texts: DataFrame, text: str, dictionary: DataFrame, *, longest: int = 24, in_memory: int = 20_000) -> DataFrame:
    """text, corrected, edits for every distinct text: the dictionary's term with the fewest edits (at most two),
    then the greatest count, then the first in order; the text itself with null edits if there is none.

    Texts above ``longest`` characters are found by parts of the terms instead of deletions,
    whose forms grow with the square of the length. A dictionary of at most ``in_memory`` terms (counted by a
    job while the plan is built) is sent to the tasks, which look every text up; a larger one is
    joined on the forms. Null texts are left out; of a term listed twice the greatest count holds."""
    distinct = texts.select(col(text).alias("word")).where("word is not null").distinct()
    terms = dictionary.where("term is not null").groupBy("term").agg(F.coalesce(F.max("cnt"), F.lit(0)).alias("cnt"))
    small = terms.limit(in_memory + 1).collect()
    if len(small) <= in_memory:
        shared = texts.sparkSession.sparkContext.broadcast({r["term"]: r["cnt"] for r in small})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = None
            for batch in batches:
                lookup = lookup or _Lookup(shared.value, longest)
                words = batch.column(0).to_pylist()
                corrected, edits = zip(*map(lookup.best, words)) if words else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array(corrected, pa.string()), pa.array(edits, pa.int32())], names=["text", "corrected", "edits"]
                )

        return distinct.mapInArrow(run, "text string, corrected string, edits int")
    near = _forms(distinct.where(F.length("word").between(1, longest)), "word").join(
        _forms(terms.where(F.length("term").between(1, longest + MAX_EDITS)), "term"), "form"
    ).select("word", "term").distinct()
    far = _forms(distinct.where(F.length("word") > longest), "word", word_parts).join(
        _forms(terms.where(F.length("term") > longest - MAX_EDITS), "term", term_parts), "form"
    ).select("word", "term").distinct()
    exact = distinct.join(terms.select(F.col("term").alias("word")), "word").select("word", F.col("word").alias("term"))
    judged = near.unionByName(far).unionByName(exact).distinct().withColumn("edits", _edits("word", "term")).where(F.col("edits") <= MAX_EDITS)
    best = judged.join(terms, "term").groupBy("word").agg(
        F.min_by(F.struct("term", "edits"), F.struct("edits", -F.col("cnt"), "term")).alias("_b")
    )
    return distinct.join(best, "word", "left").select(
        F.col("word").alias("text"), F.coalesce("_b.term", "word").alias("corrected"), F.col("_b.edits").alias("edits")
    )
