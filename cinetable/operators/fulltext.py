"""Full-text match over transcripts (T9, R15): terms, OR, phrases, prefixes.

A text's terms are its runs of letters and digits in lower case without accents.
``match`` is a scan inside the JVM; ``postings`` and ``lookup`` are the index
for many queries, an equi-join on the term.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetable.functions.text import plain_text, strip_accents
from cinetable.plans.columns import col


def terms(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(strip_accents(F.lower(text)), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def _plain_terms(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", plain_text(query.lower()))


def match(text: Column, query: str) -> Column:
    """Whether a text meets a query: words (all of them), ``OR`` between groups, ``"a phrase"``, ``prefix*``.

    A null text or a query without terms meets nothing."""
    flat = F.concat(F.lit(" "), F.array_join(terms(text), " "), F.lit(" "))
    groups = []
    for part in re.split(r"\s+OR\s+", query):
        needs = []
        for phrase, word in re.findall(r'"([^"]*)"|(\S+)', part):
            found = _plain_terms(phrase or word)
            if found:
                tail = "" if word.endswith("*") else " "
                needs.append(flat.contains(" " + " ".join(found) + tail))
        if needs:
            groups.append(reduce(lambda a, b: a & b, needs))
    if not groups:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, groups), F.lit(False))


def postings(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term, tf of every text."""
    exploded = df.select(*(col(k) for k in keys), F.explode(terms(col(text))).alias("term"))
    return exploded.groupBy(*(col(k) for k in keys), "term").agg(F.count("*").alias("tf"))


def lookup(index: DataFrame, keys: list[str], words: str) -> DataFrame:
    """The keys whose text holds all the words, through the index."""
    wanted = sorted(set(_plain_terms(words)))
    hits = index.where(F.col("term").isin(wanted)) if wanted else index.limit(0)
    return hits.groupBy(*(col(k) for k in keys)).agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).drop("_n")
