import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from cinetable.functions import text as X
from cinetable.functions import timetext as C
from cinetable.functions.jsontext import flatten_json, json_field
from cinetable.functions.vectors import dot, unit
from cinetable.operators.fulltext import lookup, match, postings
from cinetable.operators.spelling import corrections, deletions, edits_between


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_time_text(spark):
    cases = [(3.9999, "00:00:04,000", "00:00:03,999"), (90061.25, "25:01:01,250", "01:01:01,250"), (None, None, None)]
    for seconds, rounded, cut in cases:
        assert one(spark, seconds, C.srt_text, "double") == rounded
        assert one(spark, seconds, C.srt_text_of_day, "double") == cut
    assert one(spark, -1.0, C.srt_text, "double") == "00:00:00,000"
    assert one(spark, "00:01:02,999", C.srt_whole_seconds) == 62 and one(spark, "bad", C.srt_whole_seconds) == 0
    assert one(spark, "00:01:02,999", C.srt_seconds) == 62.999
    with pytest.raises(Exception, match="no subtitle time"):
        one(spark, "00:00:01.000", C.srt_ms)


def test_tokens(spark):
    text = "L'Été, ça peut-être : 3 œuvres!"
    assert one(spark, text, X.tokens) == ["ete", "ca", "peut", "etre", "uvres"]
    assert one(spark, text, lambda c: X.tokens(c, full_unicode=True)) == ["ete", "ca", "peut", "etre", "uvres"]
    assert one(spark, "écran", X.tokens) == ["ecran"]
    assert one(spark, "", X.tokens) == [] and one(spark, None, X.tokens) is None


def test_names(spark):
    good = ["John Smith", "Jo1! Sm9?", "JOhn  SMith", "John Smith\nx"]
    bad = ["J Smith", "Jo S9", "john Smith", "Éric Dupont", "x John Smith"]
    assert all(one(spark, t, X.looks_like_name) for t in good)
    assert not any(one(spark, t, X.looks_like_name) for t in bad)


def test_small_text_functions(spark):
    assert one(spark, "  A b \n C ", X.normal_text) == "a b c"
    assert one(spark, "a b/ü.mp4", X.safe_stem) == "a_b___mp4" and one(spark, "", X.safe_stem) == "video"
    assert one(spark, "[Ada] hi", X.speaker_of_line) == "Ada" and one(spark, "hi", X.speaker_of_line) == "UNK"
    assert one(spark, "x" * 221, lambda c: X.ellipsis(c, 220, 217)) == "x" * 217 + "…"
    assert one(spark, "x" * 220, lambda c: X.ellipsis(c, 220, 217)) == "x" * 220
    assert one(spark, "please look  up this", X.wants_web) and one(spark, "internet", X.wants_web)
    assert not one(spark, "websites", X.wants_web) and not one(spark, None, X.wants_web)
    assert one(spark, 'so:\n```json\n{"a": 1}\n```', X.json_object_in) == '{"a": 1}'
    assert one(spark, "{no}", X.json_object_in) is None
    assert one(spark, "50% of a_b", lambda c: X.any_like(c, "% of a_")) and not one(spark, "50 of aab", lambda c: X.any_like(c, "% of a_"))


def test_token_set_ratio():
    assert X.token_set_ratio("big red van", "van big red") == 100
    assert X.token_set_ratio("red van", "the red van here") == 100
    assert X.token_set_ratio("", "a") == 0 and X.token_set_ratio(None, None) == 0
    assert 0 < X.token_set_ratio("hello world", "hallo world") < 100
    # shared "a", rests "b" and "c": "a b" against "a c", 2 x 2 of 6 characters
    assert X.token_set_ratio("a b", "a c") == pytest.approx(200 * 2 / 6)


def test_json(spark):
    rows = [("",), ("{}",), ("not json",), ('{"text":"Hi","p":{"q":1}}',), (None,), ("[1]",)]
    df = spark.createDataFrame(rows, "extra string")
    flat = flatten_json(df, "extra").collect()
    assert flat[3]["extra.text"] == "Hi" and flat[3]["extra.p.q"] == "1"
    assert all(r["extra.text"] is None for r in flat if r is not flat[3])
    assert [r[0] for r in df.select(json_field(F.col("extra"), "$.text")).collect()] == [None, None, None, "Hi", None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], None)], "a array<float>, b array<float>")
    assert [tuple(r) for r in df.select(dot("a", "b"), F.element_at(unit(F.col("a")), 2)).collect()] == [(11.0, 0.8), (None, 0.0)]


TEXTS = ["The Cloud is", "clouds here", "CLOUD-native é", "cloud's", "icloud", "nuage été", "private cloud computing", "", None]


@pytest.mark.parametrize("query", ["cloud", "cloud native", "ete", "cloud*", "cloud OR nuage", '"private cloud"', '"cloud private"'])
def test_full_text_equals_fts5(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text)")
    con.executemany("insert into t(rowid, text) values (?, ?)", list(enumerate(TEXTS, 1)))
    want = sorted(r[0] for r in con.execute("select rowid from t where t match ?", (query,)))
    df = spark.createDataFrame(list(enumerate(TEXTS, 1)), "id int, text string")
    assert sorted(r.id for r in df.where(match(F.col("text"), query)).collect()) == want
    if query in ("cloud", "cloud native", "ete"):
        assert sorted(r.id for r in lookup(postings(df, ["id"], "text"), ["id"], query).collect()) == want


def test_spelling_equals_brute_force(spark):
    terms = [("camera", 50), ("camara", 5), ("gate", 80), ("late", 80), ("a", 3)]
    words = ["camera", "cmaera", "camra", "gaet", "xate", "zzzzz", "ab", "", "kamara"]
    df = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "w string")
    got = {r.text: (r.corrected, r.edits) for r in corrections(df, "w", spark.createDataFrame(terms, "term string, cnt long")).collect()}
    for w in words:
        best = min(((edits_between(w, t), -n, t) for t, n in terms if edits_between(w, t) <= 2), default=None) if w else None
        assert got[w] == ((best[2], best[0]) if best else (w, None)), w
    assert edits_between("ab", "ba") == 1 and edits_between("abcd", "a") == 3 and deletions("ab") == {"ab", "a", "b", ""}


def test_spelling_of_long_words_equals_brute_force(spark):
    rng = random.Random(3)

    def changed(word):
        for _ in range(rng.choice((1, 2, 2, 3))):
            i, kind = rng.randrange(len(word) - 1), rng.randrange(4)
            word = (word[:i] + "x" + word[i:], word[:i] + word[i + 1 :], word[:i] + "x" + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :])[kind]
        return word

    terms = [("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(22, 40))), n % 5) for n in range(60)]
    words = [changed(rng.choice(terms)[0]) for _ in range(400)] + [t for t, _ in terms]
    # both swaps lie across borders of the parts
    words += [t[:i] + t[i + 1] + t[i] + t[i + 2 : j] + t[j + 1] + t[j] + t[j + 2 :] for t, _ in terms[:10] for k in (1, 2) for i, j in [(len(t) * k // 5 - 1, len(t) * (k + 2) // 5 - 1)]]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.text: (r.corrected, r.edits) for r in corrections(df, "w", spark.createDataFrame(terms, "term string, cnt long")).collect()}
    for w in words:
        best = min(((edits_between(w, t), -n, t) for t, n in terms if edits_between(w, t) <= 2), default=None)
        assert got[w] == ((best[2], best[0]) if best else (w, None)), w
