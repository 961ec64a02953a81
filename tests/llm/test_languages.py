import random

import pytest
from pyspark.sql import functions as F

from cinetable.llm import languages as L

WORDS = {
    "en": "the scoreboard ignores a bicycle without lights while every recording follows what we said yesterday near the gate".split(),
    "de": "die Anzeigetafel übersieht ein Fahrrad ohne Licht und der Förster erwähnt nach der Pause den roten Lieferwagen".split(),
    "fr": "le tableau oublie un vélo sans lumière mais la conférencière répète après la pause le mauvais score".split(),
    "es": "el marcador olvida una bicicleta sin luces porque la presentadora repite después del descanso la primera frase".split(),
}


def sentence(rng, language, n=11):
    words = WORDS[language]
    start = rng.randrange(len(words))
    return " ".join(words[(start + i) % len(words)] for i in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    samples = []
    for i in range(1200):
        language = rng.choice(L.LANGUAGES)
        wrong = rng.random() < 0.08
        samples.append((sentence(rng, language), rng.choice(L.LANGUAGES) if wrong else language))
    return L.train(samples)


def test_held_out_accuracy(model):
    rng = random.Random(9)
    held = [(sentence(rng, x), x) for x in L.LANGUAGES * 60]
    held += [(L.without_accents(t).upper(), x) for t, x in held]
    right = sum(found == x for (found, _), (_, x) in zip(L._stretch_scores(model, [t for t, _ in held]), held))
    assert right >= 0.97 * len(held)


def test_training_is_repeatable():
    samples = [(sentence(random.Random(i), x), x) for i, x in enumerate(L.LANGUAGES * 10)]
    a, b = L.train(samples), L.train(samples[::-1])
    assert all((a.parts[k] == b.parts[k]).all() for k in a.parts)
    assert L.train([]).parts.keys() == a.parts.keys()


def test_gradient():
    """The analytic step lowers the loss, and one batch can be learned by heart."""
    rng = random.Random(1)
    data = [(sentence(rng, x), n) for n, x in enumerate(L.LANGUAGES)] * 8
    import numpy as np

    windows, labels = np.concatenate([L.windows_of(t)[:1] for t, _ in data]), np.array([n for _, n in data])
    net = L.ByteCnn()
    before = -net.log_probabilities(windows)[np.arange(len(labels)), labels].mean()
    net.fit(windows, labels, epochs=40)
    after = -net.log_probabilities(windows)[np.arange(len(labels)), labels].mean()
    assert after < 0.2 < before


@pytest.mark.parametrize(
    ("label", "want"),
    [("en", "en"), ("EN_us", "en"), ("fr-CA", "fr"), (" ger ", "de"), ("Spanish", "es"), ("fra", "fr"), ("und", None), ("", None), (None, None), ("it", None)],
)
def test_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(L.named_language(F.col("l"))).first()[0] == want


def test_found(spark, model):
    rng = random.Random(4)
    en, de, fr = (sentence(rng, x) for x in ("en", "de", "fr"))
    rows = [
        (1, en, "en-GB"), (2, en, "fr"), (3, en, None), (4, f"{en} / {de}", "en"), (5, f"{fr}\n{en}\n{de}", ""), (6, "short", None), (7, None, "en"),
        (8, f"[SPK1] {de} [applause], Projekt Aster", "de"), (9, "", None), (1, en, "en-GB"), (10, (en + " ") * 800, "eng"), (11, "uhm " * 20, "en"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, language_label string").withColumn("confidence", F.lit(1))
    detected = L.detect_languages(df, "text", model)
    got = {r.id: r.languages for r in L.mislabelled(detected, "text", "language_label").collect()}
    assert got == {2: "en", 3: "en", 4: "de+en", 5: "de+en+fr"}
    parts = {r.id: r.stretches for r in detected.collect()}
    assert [p.language for p in parts[5]] == ["fr", "en", "de"] and all(0 < p.confidence <= 1 for p in parts[5])
    assert parts[7] == [] and parts[11] == [] and len(parts[10]) == 1
    assert L.detect_languages(df.limit(0), "text", model).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(sentence(rng, "en") + str(i), "en") for i in range(300)] + [(None, "en"), ("x", "en"), (sentence(rng, "de"), "it")], "t string, l string")
    sample = L.training_sample(df, "t", "l", size=50)
    assert len(sample) == 50 and sample == L.training_sample(df.repartition(5), "t", "l", size=50)


def test_whole_texts_train(spark, monkeypatch):
    text = " ".join(sentence(random.Random(i), "en") for i in range(9))
    assert L.training_sample(spark.createDataFrame([(text, "en")], "t string, l string"), "t", "l") == [(text, "en")]
    seen = []
    monkeypatch.setattr(L, "windows_of", lambda s, windows=L.windows_of: seen.append(s) or windows(s))
    L.train([(text, "en")])
    assert seen == L.stretches(text) and len(seen) == 9


def test_joined_windows_equal_single_ones(model):
    import numpy as np

    texts = [sentence(random.Random(i), L.LANGUAGES[i % 4], 4 + 5 * i) for i in range(9)] + ["a b c d", "é" * 200]
    alone = [model.log_probabilities(L.windows_of(t)).mean(axis=0) for t in texts]
    for (language, share), scores in zip(L._stretch_scores(model, texts), alone):
        assert share == pytest.approx(float(np.exp(scores.max()) / np.exp(scores).sum()), rel=1e-4)


def test_the_whole_text_is_in_a_stretch(spark, model):
    rng = random.Random(8)
    en, de = (sentence(rng, x) for x in ("en", "de"))
    texts = [f"Aster. {en} Ok, Room 5. {de}", "Aster. Room 5.", f"{en} und ein Fahrrad ohne Licht. {en}"]
    found = L.detect_languages(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", model)
    for r in found.collect():
        assert " ".join(p.text for p in r.stretches).split() == texts[r.id].split()
    assert {r.id: r.languages for r in found.collect()}[0] == "de+en"


def test_a_short_part_of_another_language():
    known = {"Bonjour à tous.": ("fr", 0.99), "It is here now, all of it.": ("en", 0.98), "Aster.": ("de", 0.99), "Maybe so.": ("fr", 0.6)}
    parts = [("Bonjour à tous.", False), ("It is here now, all of it.", True), ("Aster.", False), ("Maybe so.", False), ("Bonjour à tous.", False)]
    got = [(p["language"], p["text"]) for p in L._stretches_of(parts, known)]
    assert got == [("fr", "Bonjour à tous."), ("en", "It is here now, all of it. Aster. Maybe so."), ("fr", "Bonjour à tous.")]


def test_texts_of_no_known_language(spark, model):
    texts = ["Это предложение написано по-русски, без ошибок.", "これは日本語の文です。とても短いです。", "7777 !!"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "id int, t string, l string")
    found = L.detect_languages(df, "t", model)
    assert [(r.language, r.languages) for r in found.orderBy("id").collect()] == [("und", None), ("und", None), (None, None)]
    assert L.mislabelled(found, "t", "l").count() == 0


def test_a_change_inside_a_stretch(spark, model):
    rng = random.Random(21)
    plain = lambda x, n: sentence(rng, x, n).lower().rstrip(".")
    texts, want = [], []
    for first, second in (("en", "de"), ("fr", "en"), ("es", "fr"), ("de", "es")):
        texts.append(f"{plain(first, 36)} {plain(second, 36)}")
        want.append([first, second])
    texts += [plain(x, 90) for x in L.LANGUAGES]
    want += [[x] for x in L.LANGUAGES]
    texts.append(f"{plain('en', 30)} {plain('fr', 30)} {plain('en', 30)}")
    want.append(["en", "fr", "en"])
    found = L.detect_languages(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t", model)
    for r in found.collect():
        assert [p.language for p in r.stretches] == want[r.id]
        assert " ".join(p.text for p in r.stretches) == texts[r.id] and r.languages == "+".join(sorted(set(want[r.id])))
    cut = {r.id: len(r.stretches[0].text.split()) for r in found.collect()}
    assert all(abs(cut[n] - 36) <= 3 for n in range(4))
