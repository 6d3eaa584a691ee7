"""Explanation text for scored events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import shown
from emberwatch.streaming.segments import Segments

Explainer = Callable[[pd.Series], pd.Series]


def explanation_input(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return events.select(
        *keep, "event_type", F.col("raw_log").alias("message"), "user", "source_ip", "severity"
    )


# The labels of the five fields in the prompt.
def prompt(message: str = "message") -> Column:
    """The question for a text model about one event; missing values read None."""
    return F.concat(
        F.lit("You assist a security analyst. Explain this alert in a few sentences.\n"),
        F.lit("Event type: "), shown(F.col("event_type")),
        F.lit("\nMessage: "), shown(F.col(message)),
        F.lit("\nUser: "), shown(F.col("user")),
        F.lit("\nSource IP: "), shown(F.col("source_ip")),
        F.lit("\nSeverity: "), shown(F.col("severity")),
        F.lit("\nSay what happened and what to check next."),
    )


def template_text() -> Column:
    """The built-in explanation, a native expression."""
    return F.concat(
        shown(F.col("event_type")), F.lit(" by user "), shown(F.col("user")),
        F.lit(" from "), shown(F.col("source_ip")),
        F.lit(" scored "), shown(F.col("severity")),
        F.lit(": "), shown(F.col("raw_log")),
    )


def explain(events: DataFrame, explainer: Explainer | None = None) -> DataFrame:
    """Add ``explanation``; a callable gets the prompts batch by batch, as Arrow-backed series.

    The callable reaches a task once and then serves all its batches.
    """
    if explainer is None:
        text = template_text()
    else:
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for prompts in batches:
                yield explainer(prompts)

        text = F.pandas_udf(ask, "string")(prompt("raw_log"))
    return events.withColumn("explanation", text).withColumn("status", F.lit("explained"))


ANSWERS = "digest string, answer string, _day string"
TRIES = 3


def with_retries(explainer: Explainer, tries: int = TRIES) -> Explainer:
    """The callable, called again on a failure; the last failure fails the task."""
    def ask(prompts: pd.Series) -> pd.Series:
        for left in reversed(range(tries)):
            try:
                return explainer(prompts)
            except Exception:
                if not left:
                    raise

    return ask


def explain_once(
    events: DataFrame, explainer: Explainer, path: str, tries: int = TRIES
) -> DataFrame:
    """Like ``explain``, but a prompt is asked once, in this batch and in all later ones.

    Answers are kept below ``path``, by the prompt's digest. Only prompts without one reach the callable,
    each once however many events have it, and a failing call is made ``tries`` times. A task that
    Spark runs again asks again.
    """
    asked = events.withColumn("_prompt", prompt("raw_log")).withColumn("_digest", F.sha2("_prompt", 256))
    store = Segments(events.sparkSession, path, ANSWERS)
    # The day of an answer is its digest's first digit, which spreads the answers over 16 folders.
    known = store.read().select(F.col("digest").alias("_digest"))
    distinct = asked.select("_digest", "_prompt").dropDuplicates(["_digest"])
    new = distinct.join(known, "_digest", "left_anti")
    call = with_retries(explainer, tries)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"digest": batch["_digest"], "answer": call(batch["_prompt"]),
                                    "_day": batch["_digest"].str[:1]})

    store.add(new.mapInPandas(answer, ANSWERS), uuid.uuid4().hex, 0)
    answers = store.read().select(F.col("digest").alias("_digest"), F.col("answer").alias("explanation"))
    return asked.drop("_prompt").join(answers, "_digest", "left").drop("_digest").withColumn(
        "status", F.lit("explained"))
