import pytest

from cinetable.llm.encodings import MISREAD, UTF8_READ_AS, repair, repair_texts

GERMAN = "Die Übersetzung prüft über zwanzig Plätze, bevor der Förster sie erwähnt – „so“ heißt es später."
FRENCH = "Le présentateur répète la dernière phrase près du château : « l’œuvre », dès qu’il a vérifié la caméra…"
SPANISH = "¿Qué pasó? El árbitro menciona la cámara y el subtítulo pequeño de la última grabación, mañana también."
CLEAN = [
    GERMAN, FRENCH, SPANISH, "plain ascii & more", "NÃO, SÃO PAULO, PÃO, ÂGE, CHÂTEAU, Ångström", "20 °C, 5 €, £5, ½, ±3, × ÷ µm © § 10",
    "LUMIÈRE, PREMIÈRE, SIÈGES, ÎLE, ÇA", "архив видео, Θέμα ημέρας, 第3章 新しい映像です, بث مباشر", "👍🏽 🇪🇺 🎬🎥 ﬁn écran ​",
    "&eacute; &amp; R&D", "", None,
]


@pytest.mark.parametrize("text", CLEAN)
def test_sound_text_stays(text):
    assert repair(text) == (text, [], False)


def garble(text, read_as):
    return "".join(bytes([b]).decode(read_as, "ignore") or chr(b) for b in text.encode("utf-8"))


@pytest.mark.parametrize("read_as", UTF8_READ_AS)
@pytest.mark.parametrize("text", [GERMAN, FRENCH, SPANISH])
def test_utf8_read_as(text, read_as):
    assert repair(garble(text, read_as))[0] == text


@pytest.mark.parametrize("text", [GERMAN, FRENCH])
def test_garbled_two_and_three_times(text):
    for layers in (("cp1252", "cp1252"), ("cp1252", "latin-1"), ("cp1252", "cp1252", "cp1252")):
        garbled = text
        for read_as in layers:
            garbled = garble(garbled, read_as)
        assert repair(garbled)[0] == text


@pytest.mark.parametrize(("true", "read"), [m for m in MISREAD if m[1] in ("mac_roman", "cp437", "cp850")])
def test_single_bytes_misread(true, read):
    text = "Die Übersetzung prüft über zwanzig Plätze, bevor der Förster sie erwähnt, und hört später zu."
    assert repair(text.encode(true).decode(read))[0] == text


def test_single_weak_signs():
    """One sign among sound letters of the text's language is enough; names and other languages stay."""
    sound = "In dem Hof sind für die Gäste noch zwei leere Plätze und auch über dem Tor hängt ein Schild."
    assert repair(sound.replace("Plätze", "Plõtze")) == (sound, ["cp1252 as cp850"], False)
    assert repair("Il est dans la rue avec le père et la mčre, qui ne parle pas.")[0] == "Il est dans la rue avec le père et la mère, qui ne parle pas."
    assert repair("El hombre que está en los ßrboles no habla con el niño.")[0] == "El hombre que está en los árboles no habla con el niño."
    for kept in (
        "Kovač est dans la rue avec le père, Dvořák aussi, et il ne parle pas.", "El libro que lee con la niña es una œuvre de los Voß, y está en la groß mesa.",
        "Põhjus on selles, et õpetaja ütles nii ja läks ära.", "Der Zug und die Bahn sind in Łódź, nicht in São Paulo.",
    ):
        assert repair(kept) == (kept, [], False)


def test_places_entities_and_loss():
    assert repair("before CafÃ© – and the château")[0] == "before Café – and the château"
    assert repair("TodavÃ\xada")[0] == "Todavía"
    assert repair("that&acirc;€™s")[0] == "that’s"
    assert repair("na�ve") == ("na�ve", [], True)
    assert repair("cableâ€")[2]


def test_operator(spark):
    rows = [(1, "CafÃ©", "x"), (2, None, "x"), (3, "", "x"), (4, "plain", "x"), (1, "CafÃ©", "x"), (5, garble(GERMAN, "cp1252") * 2000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_lossy string")
    out = repair_texts(df, "text").collect()
    assert sorted((r.doc_id, r.is_garbled, r.is_lossy) for r in out) == [(1, True, False), (1, True, False), (2, False, False), (3, False, False), (4, False, False), (5, True, False)]
    assert {r.doc_id: r.restored_text for r in out}[5] == GERMAN * 2000
    assert repair_texts(df.limit(0), "text").count() == 0


def test_any_number_of_layers():
    text = garbled = "Der Förster erwähnt den größten Lärm, für über drei Städte."
    for _ in range(6):
        garbled = garbled.encode("utf-8").decode("latin-1")
    assert repair(garbled)[0] == text
