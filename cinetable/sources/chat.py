"""Language models as plain callables from messages to text: questions over tables and one turn of a conversation
(S19, R16, ST2, F13, U8, X24). No provider is built in and nothing here needs a network."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetable.plans.columns import col
from cinetable.plans.lineage import materialise

Messages = list[dict]
Ask = Callable[[Messages], str]


# --- messages ---------------------------------------------------------------


def _is_text(part: object) -> bool:
    return isinstance(part, dict) and part.get("type") == "text"


def as_blocks(content: object) -> list[dict]:
    """Content as text blocks: text blocks stay, anything else becomes one with its text form."""
    return [part if _is_text(part) else {"type": "text", "text": str(part)} for part in (content if isinstance(content, list) else [content])]


def instruction_text(content: object) -> str:
    """The text of a system message; of a list only its text blocks count."""
    return "\n\n".join(part.get("text", "") for part in content if _is_text(part)) if isinstance(content, list) else str(content)


def split_system(messages: Messages) -> tuple[str, Messages]:
    """For services that take instructions apart (X24): their text, and the turns, all of which are ``user`` or ``assistant``."""
    by_role = [(m.get("role", "user"), m.get("content", "")) for m in messages]
    instructions = filter(None, (instruction_text(content) for role, content in by_role if role == "system"))
    turns = [{"role": role if role == "assistant" else "user", "content": as_blocks(content)} for role, content in by_role if role != "system"]
    return "\n\n".join(instructions), turns


def object_in(text: str | None) -> dict:
    """The JSON object of a fenced block, else from the first brace to the last; empty if there is none."""
    text = text or ""
    for pattern in (r"```json\s*(\{.*?\})\s*```", r"(\{.*\})"):
        if found := re.search(pattern, text, re.S):
            try:
                value = json.loads(found[1])
            except ValueError:
                return {}
            return value if isinstance(value, dict) else {}
    return {}


# --- calls (U8) -----------------------------------------------------------------


def retrying(ask: Ask, *, attempts: int = 5, wait: tuple[float, float] = (4.0, 10.0), errors: tuple = (ConnectionError, TimeoutError), sleep: Callable = time.sleep) -> Ask:
    """``ask`` that tries again after the named errors; waits double from the first to the second bound."""

    def call(messages: Messages) -> str:
        for n in range(attempts):
            try:
                return ask(messages)
            except errors:
                if n == attempts - 1:
                    raise
                sleep(min(wait[0] * 2**n, wait[1]))
        raise AssertionError

    return call


def answered(questions: DataFrame, prompt: str, ask: Ask, *, model: str = "", folder: str | None = None, at_once: int = 16) -> DataFrame:
    """All columns of ``questions`` and ``answer`` to the text in ``prompt``.

    Equal prompts are asked once, at most ``at_once`` calls run at a time, and with ``folder`` answers
    are kept there by a hash of model and prompt and asked never again. A null prompt has a null answer.
    Asking happens while the plan is built, so that no repeated evaluation repeats a call."""
    spark = questions.sparkSession
    key = F.sha2(F.concat(F.lit(f"{model}\n"), col(prompt)), 256)
    asked = questions.withColumn("_key", key)
    missing = asked.where(col(prompt).isNotNull()).select("_key", col(prompt).alias("prompt")).distinct()
    schema = "_key string, answer string"
    kept = None
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            kept = spark.read.schema(schema).parquet(folder)
            missing = missing.join(kept, "_key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"_key": part["_key"], "answer": [ask([{"role": "user", "content": p}]) for p in part["prompt"]]})

    new = materialise(missing.repartition(at_once).mapInPandas(run, schema))
    if folder is not None:
        new.write.mode("append").parquet(folder)
    answers = new if kept is None else kept.unionByName(new)
    return asked.join(answers.dropDuplicates(["_key"]), "_key", "left").drop("_key")


def kept_by_answer(segments: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """The segments whose answer holds a yes; all of a group that has none such (F13). A group is what one question found."""
    yes = F.coalesce(F.lower(col(answer)).contains("yes"), F.lit(False))
    # a flag a group, joined: no group is gathered
    any_yes = segments.where(yes).select(*(col(k) for k in keys)).distinct().withColumn("_any", F.lit(True))
    return segments.join(any_yes, keys, "left").where(yes | F.col("_any").isNull()).drop("_any")


# --- one turn of a conversation (R16, ST2) ---------------------------------------


@dataclass(frozen=True)
class Decision:
    need_search: bool
    query: str | None = None
    answer: str | None = None
    reason: str = ""


def standalone_question(ask: Ask, history: str, message: str) -> str:
    """A question that can be understood alone; the message itself if asking fails or gives less than two characters."""
    task = "Say the user's last message as one question that needs nothing said before. Give only the question."
    try:
        answer = ask([{"role": "system", "content": task}, {"role": "user", "content": f"{history}\n---\n{message}"}])
    except Exception:
        return message
    answer = (answer or "").strip()
    return answer if len(answer) >= 2 else message


def search_decision(ask: Ask, question: str, context: str, *, explicit: bool = False, history: str = "") -> Decision:
    """Whether the web is to be searched, and for what; else the answer from the context, if the model gave one."""
    task = (
        "Answer from the passages if they hold the answer and no web search was asked for; otherwise name one web search. "
        "Reply with one JSON object: need_search (boolean), query (text or null), answer (text or null), reason (text)."
    )
    facts = {"web_search_asked_for": explicit, "conversation": history, "question": question, "passages": context}
    found = object_in(ask([{"role": "system", "content": task}, {"role": "user", "content": json.dumps(facts, ensure_ascii=False)}]))
    text = {k: (found.get(k) or "").strip() for k in ("query", "answer", "reason")}
    need = bool(found.get("need_search"))
    return Decision(need, text["query"] if need else None, None if need else text["answer"], text["reason"])


def web_block(results: list[dict]) -> str:
    """Numbered results with title, address and snippet, parted by blank lines."""
    return "\n\n".join(f"[{n}] {r['title']}  {r['url']}\n{r['snippet']}" for n, r in enumerate(results, 1))


def chat_turn(
    ask: Ask,
    message: str,
    retrieve: Callable[[str], str],
    *,
    history: str = "",
    explicit: bool = False,
    search: Callable[[str], list[dict]] | None = None,
) -> Iterator[str]:
    """What is shown in one turn, in order (ST2): a notice while the web is searched, then the answer.

    ``retrieve`` gives the context of a question; ``search`` the web's results, None if it is switched off."""
    question = standalone_question(ask, history, message)
    context = retrieve(question)
    decision = search_decision(ask, question, context, explicit=explicit, history=history)
    sources = {"question": question, "conversation": history, "passages": context}
    if decision.need_search:
        if not decision.query:
            yield "A web search was suggested without a query."
            return
        if search is None:
            yield f"Suggested web search: {decision.query}"
            return
        yield f"Searching the web: {decision.query}"
        try:
            results = search(decision.query)
        except Exception as error:
            yield f"The web search failed: {error}"
            return
        if not results:
            yield "The web search found nothing."
            return
        sources["web"] = web_block(results)
    elif decision.answer:
        yield decision.answer
        return
    task = "Answer from the given passages, conversation and web results alone. Give time codes of passages, and [n] for web results."
    try:
        yield ask([{"role": "system", "content": task}, {"role": "user", "content": json.dumps(sources, ensure_ascii=False)}])
    except Exception as error:
        yield f"The language model failed: {error}"
