"""Translation by providers: an interface, an offline provider, and the runner with retries."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Iterator
from concurrent.futures import CancelledError
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from bookflow.operators.errors import RATE_LIMIT
from bookflow.operators.glossary import Rule


class Provider(Protocol):
    """What translates one text; created on the driver, sent to tasks."""

    name: str

    def available(self) -> bool: ...

    def translate(self, text: str, rules: list[Rule]) -> str: ...


class DictionaryProvider:
    """Offline and deterministic: the glossary's terms are replaced, the rest stays."""

    name = "dictionary"

    def available(self) -> bool:
        return True

    def translate(self, text: str, rules: list[Rule]) -> str:
        for r in rules:
            text = re.sub(rf"(?<!\w){re.escape(r.source)}(?!\w)", lambda _, t=r.target: t, text, flags=re.IGNORECASE)
        return text


def chosen(providers: list[Provider], name: str = "auto") -> Provider:
    """A provider by name, or the first that is available; unknown names are an error."""
    if name != "auto":
        for p in providers:
            if p.name == name.lower():
                return p
        raise ValueError(f"no provider {name!r}")
    for p in providers:
        if p.available():
            return p
    raise ValueError("no provider is available")


RESULT = "chapter_id long, status string, translated_text string, error_message string"


class FirstOf:
    """Several ways to the same translation, such as a streamed answer, a whole one and a plain request: the first that gives a text counts."""

    def __init__(self, ways: list[Provider]):
        self.ways, self.name = ways, ways[0].name

    def available(self) -> bool:
        return any(w.available() for w in self.ways)

    def translate(self, text: str, rules: list[Rule]) -> str:
        said = []
        for w in self.ways:
            try:
                if (out := w.translate(text, rules)).strip():
                    return out
                said.append(f"{w.name}: empty result")
            except Exception as e:  # noqa: BLE001 - the next way may do
                said.append(f"{w.name}: {e}")
        raise RuntimeError("; ".join(said))


#: Attempts at one text, and the bounds of the waits between them in seconds, which double; a rate limit waits longer (fixed values).
ATTEMPTS, LEAST_WAIT_S, MOST_WAIT_S, RATE_LIMIT_WAIT_S = 3, 2.0, 30.0, 80.0


def wait_before(attempt: int, message: str, least: float = LEAST_WAIT_S, most: float = MOST_WAIT_S, rate_limit: float = RATE_LIMIT_WAIT_S) -> float:
    """Seconds to wait before an attempt (from 1) after one that failed with a message."""
    if re.search(RATE_LIMIT, message.lower()):
        return rate_limit
    return min(most, least * 2 ** (attempt - 1))


class JobControl:
    """Pause, resume and cancel work that is done in steps, each a Spark job of one group.

    Between steps a pause waits; a cancellation also stops the jobs that run, through their group."""

    def __init__(self, spark, group: str):
        self.spark, self.group = spark, group
        self._go, self._cancelled = threading.Event(), threading.Event()
        self._go.set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self) -> None:
        self._cancelled.set()
        self._go.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def check(self) -> None:
        """Waits while paused; raises CancelledError once cancelled."""
        self._go.wait()
        if self._cancelled.is_set():
            raise CancelledError(f"{self.group} was cancelled")

    def run(self, steps) -> list:
        """Results of all steps (functions without an argument), in order."""
        self.spark.sparkContext.setJobGroup(self.group, self.group, interruptOnCancel=True)
        out = []
        for step in steps:
            self.check()
            out.append(step())
        return out


def translated(chapters: DataFrame, provider: Provider, rules: list[Rule], attempts: int = ATTEMPTS, wait=wait_before) -> DataFrame:
    """Runs the provider over (chapter_id, raw_text). Blank texts fail without a call; an error or an empty result is tried again after ``wait(attempt, message)`` seconds.

    Calls repeat if a task does: write the result before using it twice."""

    def one(text: str | None) -> tuple[str, str | None, str | None]:
        if not text or not text.strip():
            return "failed", None, "no text"
        message = ""
        for k in range(attempts):
            if k:
                time.sleep(wait(k, message))
            try:
                out = provider.translate(text, rules)
                if out.strip():
                    return "translated", out, None
                message = "empty result"
            except Exception as e:  # noqa: BLE001 - a provider may raise anything; it ends up in the row
                message = str(e)
        return "failed", None, message

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(int(i), *one(t)) for i, t in zip(b["chapter_id"], b["raw_text"])]
            yield pd.DataFrame(rows, columns=["chapter_id", "status", "translated_text", "error_message"])

    return chapters.select("chapter_id", "raw_text").mapInPandas(run, RESULT)
