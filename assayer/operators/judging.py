"""Model calls behind one Arrow boundary: messages in, responses or errors out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.prompts import mock_response
from assayer.functions.verdicts import parse_score, parse_verdict, resolve_winner
from assayer.operators.journal import Answers, Journal

Chat = Callable[[list[dict]], str]


def ask(chat: Chat, messages: list[dict], attempts: int = 3, delay: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(response, error). A blank response is an error; the wait doubles when the service says 429."""
    error = ""
    for k in range(attempts):
        try:
            text = chat(messages)
            if text and text.strip():
                return text, None
            error = "blank response"
        except Exception as e:  # a provider may raise anything; the row carries it
            error = f"{type(e).__name__}: {e}"
        if k < attempts - 1:
            sleep(delay * (2 if "429" in error else 1))
    return None, error


def respond(
    df: DataFrame, make_chat: Callable[[], Chat] | None, messages: str = "messages", workers: int | None = None, attempts: int = 3, delay: float = 5.0, journal: Journal | None = None,
) -> DataFrame:
    """Adds ``response`` and ``error``. ``make_chat`` is called once in each task; none means the mock judge.

    Each partition of ``df`` is a caller of its own; ``workers`` sets another number of them, for a service that
    takes no more at a time. Rows without messages are not called. With a ``journal`` each answer is kept as it
    comes, and calls that it knows are not made again: neither by a task that is tried again nor by a later run. Without,
    write the result before anything else reads it. Answers of the mock judge are never kept.
    """
    if make_chat is None:
        asked = F.col(messages).isNotNull()
        return df.withColumns({"response": F.when(asked, mock_response(F.col(messages))), "error": F.when(~asked, F.lit("not called"))})

    rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    columns = [*df.columns, "response", "error"]
    if journal is not None:
        df = df.withColumn("_call", journal.call(messages, F.col(messages)))

    def answer(chat: Chat, own: list | None, book: Answers | None, key: str | None) -> tuple[str | None, str | None]:
        if own is None:
            return None, "not called"
        if book is not None and (said := book.get(key)):
            return said, None
        said, error = ask(chat, [dict(m) for m in own], attempts, delay)
        if book is not None and error is None:
            book.add(key, said)
        return said, error

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, book = make_chat(), journal.open() if journal else None
        for batch in batches:
            keys = batch["_call"] if journal else [None] * len(batch)
            answers = [answer(chat, own, book, key) for own, key in zip(batch[messages], keys, strict=True)]
            yield batch.assign(response=[a for a, _ in answers], error=[e for _, e in answers])[columns]

    return (df.repartition(workers) if workers else df).mapInPandas(call, f"{rows}, response string, error string")


def grade(df: DataFrame, make_chat: Callable[[], Chat] | None = None, **options) -> DataFrame:
    """Adds ``judgment`` and ``score`` to rows with messages of one grading call."""
    out = respond(df, make_chat, **options).withColumnRenamed("response", "judgment")
    return out.withColumn("score", parse_score(F.col("judgment"))).withColumn("score", F.coalesce("score", F.lit(-1.0)))


def compare(df: DataFrame, make_chat: Callable[[], Chat] | None = None, **options) -> DataFrame:
    """Adds both orders' judgments and verdicts and the winner to rows with messages_ab and messages_ba."""
    for k in ("ab", "ba"):
        df = respond(df, make_chat, messages=f"messages_{k}", **options)
        df = df.withColumnsRenamed({"response": f"judgment_{k}", "error": f"error_{k}"})
        df = df.withColumn(f"winner_{k}", parse_verdict(F.col(f"judgment_{k}")))
    return df.withColumn("winner", resolve_winner(F.col("winner_ab"), F.col("winner_ba"), F.col("model_a"), F.col("model_b")))
