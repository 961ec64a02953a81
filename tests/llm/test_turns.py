import random

import pytest

from cinetable.llm.turns import clean_utterance, named_speaker, speaker_turns

SCHEMA = "video_id string, utt_id int, start_sec double, end_sec double, speaker string, text string, kind string"


@pytest.mark.parametrize(
    ("label", "n"),
    [
        ("SPK1", 1), (" spk_02 ", 2), ("[SPK3]", 3), ("Speaker one", 1), ("speaker no. 4", 4), ("Sprecher 5", 5), ("Locuteur 6 :", 6),
        ("Hablante 12", 12), ("S7", 7), ("SPK2 (remote)", 2), ("spk#1", 1), ("SPEAKER_010", 10), ("Intervenante dos", 2), ("3", 3),
        ("UNK", None), ("n/a", None), ("?", None), ("", None), (None, None), ("unknown", None), ("Room 5", None),
    ],
)
def test_speaker_column(label, n):
    assert named_speaker(label) == n


@pytest.mark.parametrize(
    ("text", "speaker", "clean"),
    [
        ("[SPK2] uhm, we  start", 2, "we start"),
        ("- SPK1: hello", 1, "hello"),
        (">> Speaker 3: hi there", 3, "hi there"),
        ("(Sprecher 4) 12:30 - los geht es", 4, "los geht es"),
        ("Speaker 2 - go ahead", 2, "go ahead"),
        ("[Intervenant 5]: oui", 5, "oui"),
        ("the second speaker 2 is here", None, "the second speaker 2 is here"),
        ("S'il vous plaît", None, "S'il vous plaît"),
        ("we meet at 10:30 today", None, "we meet at 10:30 today"),
        ("(00:12:01) we meet <00:12:03,500> today", None, "we meet today"),
        ("[door um, closes] the ♪ jingle hmm, ♪ end (laughs)", None, "the end"),
        ("the plan (22) is old", None, "the plan (22) is old"),
        ("este… fragmento", None, "fragmento"),
        ("este fragmento", None, "este fragmento"),
        ("wir treffen uns um drei und er ist da", None, "wir treffen uns um drei und er ist da"),
        ("we er go um home", None, "we go home"),
        ("the music is good", None, "the music is good"),
        ("[[[[[[[[music]]]]]]]] hello", None, "hello"),
        ("[um [er [uh [hm [euh [äh [eh ]]]]]]] hello", None, "hello"),
        ("[(<[([music])]>)] hello", None, "hello"),
        ("er ist hier", None, "er ist hier"),
        ("er kommt morgen", None, "er kommt morgen"),
        ("um zehn Uhr", None, "um zehn Uhr"),
        ("er, the plan is old", None, "the plan is old"),
        ("um, er", None, ""),
        ("S１: hello", 1, "hello"),
        ("uh-huh… mm-hmm", None, ""),
        ("*music*, [BLANK_AUDIO] 00:01:02.500?", None, ""),
        ("SPK1: hmm", 1, ""),
        ("50:20 -, 29:16 -…", None, ""),
        ("...", None, ""),
        ("", None, ""),
        (None, None, ""),
    ],
)
def test_cleaning(text, speaker, clean):
    assert clean_utterance(text) == (speaker, clean)


def test_very_long_text():
    text = "uhm the red van " * 20_000
    assert clean_utterance(text) == (None, ("the red van " * 20_000).strip())


def brute(rows, gap=300_000):
    seen, out, now = set(), [], None
    for v, u, s, e, label, text, _ in sorted([r for r in rows if r[2] is not None], key=lambda r: (r[0] is not None, r[0] or "", round(r[2] * 1000), r[1])):
        mark, clean = clean_utterance(text)
        if not clean or (v, u) in seen:
            continue
        seen.add((v, u))
        n = named_speaker(label)
        n = mark if n is None else n
        who = "UNK" if n is None else f"SPK{n}"
        ms = round(s * 1000)
        if now and now[0] == v and now[3] == who and ms - now[4] <= gap:
            now[2], now[4] = u, ms
            now[5].append(clean)
        else:
            if now:
                out.append(now)
            now = [v, u, u, who, ms, [clean]]
    if now:
        out.append(now)
    return sorted([(v, a, b, who, " ".join(t)) for v, a, b, who, _, t in out], key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_turns_equal_brute_force(many_chunks, seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.choice([0.0, 1.0, 2.5, 301.0]) if rng.random() < 0.3 else 3.0
        v = rng.choice(["hot"] * 8 + ["b", None])
        text = rng.choice(["hi there", "uhm", "SPK2: yes", "[SPK1] no", "", None, "(laughs) ok"])
        rows.append((v, i, t if rng.random() < 0.95 else None, t + 1, rng.choice(["SPK1", "Speaker two", None, "?"]), text, "x"))
    rows += rows[:50]
    df = many_chunks.createDataFrame(rows, SCHEMA)
    got = sorted([tuple(r) for r in speaker_turns(df).select("video_id", "first_utt_id", "last_utt_id", "speaker", "text").collect()], key=repr)
    assert got == brute(rows)


def test_turn_times_and_empty_table(spark):
    rows = [("v", 1, 1.0, 3.0, "SPK1", "a", "x"), ("v", 2, 2.0, None, "SPK1", "b", "x"), ("v", 3, 4.0, 1.0, "SPK1", "c", "x"), ("v", 4, 9.0, None, None, "d", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.start_ms, r.end_ms, r.utterances) for r in speaker_turns(df).orderBy("start_ms").collect()]
    assert got == [(1000, 3000, 3), (9000, None, 1)]
    assert speaker_turns(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"kind": "_side"})
    assert speaker_turns(clash).count() == 2


def test_declared_german():
    assert clean_utterance("er lacht", True) == (None, "er lacht") and clean_utterance("er lacht") == (None, "lacht")
    assert clean_utterance("um er", True) == (None, "") and clean_utterance("er the plan", True) == (None, "the plan")


def test_deep_brackets_take_linear_time():
    for inner in ("music", ""):
        assert clean_utterance("[" * 100_000 + inner + "]" * 100_000 + " hello") == (None, "hello")


def test_ids_above_an_int(spark):
    df = spark.createDataFrame([("v", 2**40, 1.0, 2.0, "SPK1", "a", "en")], SCHEMA.replace("utt_id int", "utt_id long").replace("kind", "lang"))
    got = speaker_turns(df).first()
    assert (got.first_utt_id, got.last_utt_id) == (2**40, 2**40)
