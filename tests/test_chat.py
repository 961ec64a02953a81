import pytest
from pyspark.sql import functions as F

from cinetable.sources import chat


def test_messages():
    text = {"type": "text", "text": "a"}
    messages = [
        {"role": "system", "content": "s"}, {"role": "system", "content": [text, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "system", "content": ""},
        {"role": "tool", "content": "c"}, {"content": [text, 7]}, {"role": "assistant", "content": "d"},
    ]
    system, turns = chat.split_system(messages)
    assert system == "s\n\na\n\nb"
    assert turns == [
        {"role": "user", "content": [{"type": "text", "text": "c"}]}, {"role": "user", "content": [text, {"type": "text", "text": "7"}]},
        {"role": "assistant", "content": [{"type": "text", "text": "d"}]},
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [('x ```json\n{"a": 1}\n``` y {"b": 2}', {"a": 1}), ('so {"a": {"b": 1}} end', {"a": {"b": 1}}), ("none", {}), ("{bad}", {}), (None, {}), ("", {})],
)
def test_object_in(text, want):
    assert chat.object_in(text) == want


def test_questions_and_decisions():
    assert chat.standalone_question(lambda m: " Who? ", "", "who") == "Who?"
    assert chat.standalone_question(lambda m: "x", "", "who") == "who" and chat.standalone_question(lambda m: 1 / 0, "", "who") == "who"
    decide = lambda reply: chat.search_decision(lambda m: reply, "q", "c")
    assert decide('{"need_search": true, "query": " x ", "answer": "no", "reason": null}') == chat.Decision(True, "x", None, "")
    assert decide('{"need_search": false, "query": "x", "answer": "yes", "reason": "r"}') == chat.Decision(False, None, "yes", "r")
    assert decide("nonsense") == chat.Decision(False, None, "", "")


def test_a_turn():
    def model(replies):
        left = iter(replies)
        return lambda messages: next(left)

    need = '{"need_search": true, "query": "x"}'
    hits = [{"title": "t", "url": "u", "snippet": "s"}]
    turn = lambda replies, **more: list(chat.chat_turn(model(replies), "m", lambda q: "ctx", **more))
    assert turn(["question", '{"need_search": false, "answer": "direct"}']) == ["direct"]
    assert turn(["question", "{}", "made"]) == ["made"]
    assert turn(["question", need, "final"], search=lambda q: hits) == ["Searching the web: x", "final"]
    assert turn(["question", need]) == ["Suggested web search: x"]
    assert turn(["question", '{"need_search": true}']) == ["A web search was suggested without a query."]
    assert turn(["question", need], search=lambda q: [])[-1] == "The web search found nothing."
    assert turn(["question", need], search=lambda q: 1 / 0)[-1].startswith("The web search failed")
    assert turn(["question", "{}"])[-1].startswith("The language model failed")
    assert chat.web_block(hits * 2) == "[1] t  u\ns\n\n[2] t  u\ns"


def test_retries():
    tries, waits = [], []

    def ask(messages):
        tries.append(1)
        if len(tries) < 4:
            raise ConnectionError
        return "ok"

    assert chat.retrying(ask, sleep=waits.append)([]) == "ok" and waits == [4.0, 8.0, 10.0]
    tries.clear()
    with pytest.raises(ConnectionError):
        chat.retrying(ask, attempts=2, sleep=waits.append)([])
    with pytest.raises(KeyError):
        chat.retrying(lambda m: {}["x"])([])


def test_answers_are_kept(spark, tmp_path):
    folder, log = str(tmp_path / "answers"), tmp_path / "log"

    def ask(messages):
        with open(log, "a") as file:
            file.write("x\n")
        return messages[0]["content"].upper()

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id int, p string")
    for more in (rows, rows.unionByName(spark.createDataFrame([(5, "c")], rows.schema))):
        got = {r.id: r.answer for r in chat.answered(more, "p", ask, folder=folder, at_once=2).collect()}
        assert got == {r.id: r.p and r.p.upper() for r in more.collect()}
    assert len(log.read_text().split()) == 3
    assert chat.answered(rows.limit(0), "p", ask).count() == 0


def test_kept_segments(spark):
    rows = spark.createDataFrame([("v", 1, "Yes."), ("v", 2, "no"), ("w", 3, "no"), ("w", 4, None)], "v string, s int, a string")
    assert sorted(r.s for r in chat.kept_by_answer(rows, ["v"], "a").collect()) == [1, 3, 4]
    assert chat.kept_by_answer(rows.where(F.lit(False)), ["v"], "a").count() == 0
