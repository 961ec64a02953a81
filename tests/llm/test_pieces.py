import random

import pytest

from cinetable.llm.pieces import cut_pattern, oversized, split_texts


def pieces(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {}
    for r in split_texts(df, "text", **options).orderBy("id", "piece_no").collect():
        out.setdefault(r.id, []).append(r)
    return out


def check(text, rows, limit, overlap):
    assert "".join(r.piece[r.overlap_chars :] for r in rows) == text
    for n, r in enumerate(rows):
        assert r.piece_no == n and len(r.piece) <= limit and r.overlap_chars <= overlap
        assert r.piece == text[r.piece_start - r.overlap_chars : r.piece_end]
        assert n == 0 or r.piece_start == rows[n - 1].piece_end


@pytest.mark.parametrize(("limit", "overlap"), [(1200, 100), (60, 10), (50, 0)])
def test_round_trip(spark, limit, overlap):
    rng = random.Random(limit)
    texts = []
    for _ in range(30):
        parts = [rng.choice(["red ", "van. ", "gate! ", "\n", "\n\n", "日本。", "x" * rng.randrange(1, 150), "👍🏽", "é, "]) for _ in range(rng.randrange(1, 120))]
        texts.append("".join(parts))
    texts += ["a" * 5000, " " * 400, "x" * limit, "x" * (limit + 1), "word " * 60_000]
    found = pieces(spark, texts, limit=limit, overlap=overlap)
    for n, text in enumerate(texts):
        check(text, found[n], limit, overlap)
        assert len(found[n]) == 1 or len(text) > limit


def test_natural_boundaries(spark):
    sentence = "The red van is near the gate. "
    rows = pieces(spark, [sentence * 10], limit=100, overlap=20)[0]
    assert all(r.piece.endswith(". ") for r in rows)
    assert all(r.piece[: r.overlap_chars].lstrip() in sentence and not r.piece.startswith(" ") for r in rows[1:])
    words = pieces(spark, ["abcdefg " * 40], limit=50, overlap=10)[0]
    assert all(r.piece.endswith(" ") for r in words)


def test_no_character_is_broken(spark):
    text = "é" * 300 + "👍🏽" * 200
    for r in pieces(spark, [text], limit=51, overlap=7)[0]:
        assert not r.piece[r.overlap_chars :].startswith(("́", "🏽"))


def test_edges(spark):
    found = pieces(spark, ["", None, "a"])
    assert set(found) == {2}
    df = spark.createDataFrame([(1, "x y", 5, "z")], "id int, text string, piece_no int, _cores string")
    out = split_texts(df, "text")
    assert out.first().piece == "x y" and out.columns == ["id", "_cores", "piece_no", "piece_start", "piece_end", "overlap_chars", "piece"][:1] + out.columns[1:]
    assert split_texts(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        cut_pattern(10, 10)


def test_found(spark):
    rows = [("a", "x" * 1200), ("b", "x" * 1201), ("c", "ab " * 500), ("d", None), ("e", ""), ("f", "x " + "y" * 1201), ("b", "x" * 1201), ("g", "y" * 1200 + " " + "y" * 1200)]
    df = spark.createDataFrame(rows, "k string, text string")
    got = sorted(tuple(r) for r in oversized(df, ["k"], "text").collect())
    assert got == [("b", "no_space"), ("b", "over_limit"), ("c", "over_limit"), ("f", "no_space"), ("f", "over_limit"), ("g", "over_limit")]


def test_offsets_of_a_very_long_text(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select("id", F.repeat(F.lit("word and more. "), 1_000_000).alias("text"))
    got = split_texts(df, "text", limit=200, overlap=10).agg(F.count("*"), F.max("piece_end"), F.sum(F.col("piece_end") - F.col("piece_start"))).first()
    assert got[0] > 75_000 and got[1] == got[2] == 15_000_000
