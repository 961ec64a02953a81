"""Splitting of oversized texts at natural boundaries, with overlap.

Method: bounded-quantifier regular expressions. The alternatives, in order of
boundary strength, each consume up to the limit: paragraph, line, sentence,
clause, word, then whole characters. Lookback into the preceding piece supplies
the overlap; offsets are running sums over SQL arrays. One pass without a
shuffle and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetable.plans.columns import col, other_columns

#: What a cut may follow, from the strongest boundary to the weakest.
BOUNDARIES = (
    r"\n\s{0,3}\n",
    r"\n",
    r"[.!?…][\"'”’»)\]]{0,3}\s",
    r"[。！？]",
    r"[,;:–—]\s",
    r"[、，；]",
)
WORD_END = r"\s"
#: A character that belongs to the one before it.
JOINED = r"[\p{M}\x{200D}\x{FE0E}\x{FE0F}\x{1F3FB}-\x{1F3FF}]"


def cut_pattern(limit: int, overlap: int) -> str:
    """The expression whose successive matches are a text's pieces without overlap."""
    step = limit - overlap
    if overlap < 0 or step < 2:
        raise ValueError("the overlap must be smaller than the limit")
    half = step // 2
    choices = [rf"\A.{{1,{limit}}}\z", rf".{{1,{step}}}\z"]
    choices += [rf".{{{half},{step}}}(?<={b})" for b in BOUNDARIES]
    choices += [rf".{{{half},{step}}}(?<={WORD_END})", rf".{{1,{half}}}(?<={WORD_END})"]
    choices += [rf".{{{half},{step}}}(?!{JOINED})", rf".{{1,{step}}}"]
    return "(?Us)(?:" + "|".join(choices) + ")"


def cores(text: Column, limit: int, overlap: int) -> Column:
    """The array of a text's pieces without overlap; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(cut_pattern(limit, overlap)), F.lit(0))


def _running_sums(numbers: Column) -> Column:
    """Sums of an array up to each place, by doubling steps: n log n work, where an array grown place by place takes n squared."""
    steps = F.array(*(F.lit(1 << n) for n in range(31)))
    return F.aggregate(
        steps,
        numbers,
        lambda sums, step: F.when(step >= F.size(sums), sums).otherwise(
            F.transform(sums, lambda x, i: x + F.when(i >= step, F.get(sums, i - step)).otherwise(0))
        ),
    )


def _overlap(before: Column, overlap: int) -> Column:
    """At most ``overlap`` last characters of ``before``, from a word's start if there is one."""
    if overlap == 0:
        return F.lit("")
    from_word = F.regexp_extract(F.right(before, F.lit(overlap + 1)), rf"(?Us)(?<=\s)\S.{{0,{overlap - 1}}}\z", 0)
    return F.when(F.length(before) <= overlap, before).when(from_word != "", from_word).otherwise(
        F.right(before, F.lit(overlap))
    )


def split_texts(df: DataFrame, text: str, *, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """Each row's pieces: its other columns, then piece_no, piece_start, piece_end, overlap_chars, piece.

    ``piece`` has at most ``limit`` characters (Unicode code points), the first
    ``overlap_chars`` (at most ``overlap``) of which end the preceding piece.
    ``piece_start`` and ``piece_end`` delimit the part that is new: these parts
    joined in order are the text, unchanged.

    Defined results: a null or empty text has no piece; a text within the limit
    is one piece; a text without any boundary is cut between characters, never
    inside one; repeated rows stay repeated; an input column named like an
    output column is replaced.
    """
    made = ["piece_no", "piece_start", "piece_end", "overlap_chars", "piece"]
    kept = other_columns(df, text, *made)
    row = F.struct(*(col(c) for c in kept)) if kept else F.struct(F.lit(0))
    parts = df.select(row.alias("_row"), cores(col(text), limit, overlap).alias("_cores")).where("size(_cores) > 0")
    starts = F.concat(F.array(F.lit(0)), _running_sums(F.transform("_cores", lambda core: F.length(core))))
    parts = parts.withColumn("_starts", starts)
    pieces = F.transform(
        "_cores",
        lambda core, i: F.struct(
            i.alias("piece_no"),
            F.get("_starts", i).alias("piece_start"),
            F.get("_starts", i + 1).alias("piece_end"),
            F.when(i == 0, "").otherwise(_overlap(F.get("_cores", i - 1), overlap)).alias("_head"),
            core.alias("_core"),
        ),
    )
    return parts.select("_row", F.explode(pieces).alias("_p")).select(
        *(F.col("_row").getField(c).alias(c) for c in kept),
        "_p.piece_no",
        "_p.piece_start",
        "_p.piece_end",
        F.length("_p._head").alias("overlap_chars"),
        F.concat("_p._head", "_p._core").alias("piece"),
    )


def oversized(df: DataFrame, keys: list[str], text: str, *, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """Keys and kind of the texts that were cut: ``over_limit``, and ``no_space`` as well
    if more than ``limit`` characters in a row hold no white space. One row per key and kind."""
    was_cut = F.size(cores(col(text), limit, overlap)) > 1
    kinds = F.when(
        was_cut,
        F.when(col(text).rlike(rf"(?U)\S{{{limit + 1}}}"), F.array(F.lit("over_limit"), F.lit("no_space"))).otherwise(
            F.array(F.lit("over_limit"))
        ),
    )
    return df.select(*(col(k) for k in keys), F.explode(kinds).alias("kind")).distinct()
