"""Answer generation behind an interface: an offline extractive generator, and retries for remote ones."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.schemas import ANSWER_DDL


class QuotaExhausted(RuntimeError):
    """The allowance is gone: retrying wastes time, a batch stops."""


class Transient(RuntimeError):
    """Load on the server's side; ``delay`` is what it asks for."""

    def __init__(self, message: str, delay: float | None = None):
        super().__init__(message)
        self.delay = delay


class Generator(Protocol):
    name: str

    def answer(self, question: str, sources: list[str]) -> dict:
        """{"answer", "citations": [{"source_id", "quote"}], "insufficient_context"}."""


STOP = frozenset("a an and are as at by do does file for from how in is it of on or the to what when which who with must".split())


class ExtractiveGenerator:
    """Answers with the sentences that share most words with the question, quoted word for word."""

    name = "extractive-1"

    def __init__(self, sentences: int = 2, least: float = 0.3):
        self.sentences, self.least = sentences, least

    def answer(self, question: str, sources: list[str]) -> dict:
        asked = {w for w in re.findall(r"\w+", question.lower()) if w not in STOP}
        scored = []
        for n, text in enumerate(sources, 1):
            for at, s in enumerate(re.split(r"(?<=[.;])\s+", text)):
                share = len(asked & set(re.findall(r"\w+", s.lower()))) / max(1, len(asked))
                scored.append((-share, n, at, s.strip()))
        best = [x for x in sorted(scored)[: self.sentences] if -x[0] >= self.least and x[3]]
        quotes = [{"source_id": n, "quote": s} for _, n, _, s in best]
        return {"answer": " ".join(q["quote"] for q in quotes) or "The sources do not say.", "citations": quotes, "insufficient_context": not quotes}


def failure(status: int, message: str) -> Exception:
    """What a refusal of a remote service means: quota gone, load that passes, or an error."""
    if status == 429 or "RESOURCE_EXHAUSTED" in message:
        return QuotaExhausted(message)
    if status in (500, 503) or "UNAVAILABLE" in message or "INTERNAL" in message:
        asked = re.search(r"""["']retryDelay["']\s*:\s*["'](\d+(?:\.\d+)?)s["']""", message)
        return Transient(message, float(asked.group(1)) if asked else None)
    return RuntimeError(f"{status}: {message}")


INSTRUCTIONS = "Answer from the numbered sources alone. Quote the sentences that support the answer word for word with the number of their source. Say if the sources don't hold the answer."


class RemoteGenerator:
    """A service that takes ``{"model", "instructions", "prompt"}`` by POST and gives an answer as JSON; ``key`` goes into the Authorization header."""

    def __init__(self, url: str, name: str, key: str | None = None, timeout: float = 60.0):
        self.url, self.name, self.key, self.timeout = url, name, key, timeout

    def answer(self, question: str, sources: list[str]) -> dict:
        numbered = "\n\n".join(f"[{i}] {s}" for i, s in enumerate(sources, 1))
        body = {"model": self.name, "instructions": INSTRUCTIONS, "prompt": f"SOURCES\n\n{numbered}\n\nQUESTION\n{question}"}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as reply:
                found = json.loads(reply.read())
        except urllib.error.HTTPError as e:
            raise failure(e.code, e.read().decode("utf-8", "replace")) from e
        cites = [{"source_id": int(c["source_id"]), "quote": str(c["quote"])} for c in found["citations"]]
        return {"answer": str(found["answer"]), "citations": cites, "insufficient_context": bool(found["insufficient_context"])}


def with_retry(call: Callable[[], dict], attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> dict:
    """``call`` again after transient failures, waiting as asked or 1, 2, 4 ... seconds; other failures at once."""
    for attempt in range(attempts):
        try:
            return call()
        except Transient as e:
            if attempt == attempts - 1:
                raise
            sleep(e.delay if e.delay is not None else 2**attempt)
    raise ValueError("attempts must be positive")


def format_sources(chunks: Column) -> Column:
    """Numbered blocks of an array of chunks (number, issue_date, applies_to, subject, section, text), parted by blank lines."""

    def block(c: Column, i: Column) -> Column:
        binds = F.array_join(F.coalesce(c["applies_to"], F.array().cast("array<string>")), ", ")
        text = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
        return F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c["number"], F.lit("None")), F.lit("  ("), F.coalesce(c["issue_date"], F.lit("None")), F.lit(")\nbinds: "),
            text(binds, "(not entity-scoped)"), F.lit("\ndocument: "), F.coalesce(c["subject"], F.lit("None")), F.lit("\nsection: "), text(c["section"], "-"), F.lit("\n---\n"), c["text"],
        )

    return F.array_join(F.transform(chunks, block), "\n\n")


def generate(asked: DataFrame, generator: Generator, attempts: int = 4) -> DataFrame:
    """``asked`` (question, texts) with ``generated``: the answer, the seconds it took and an error, one of them null.

    When the quota is gone, the task asks nothing more: its other questions get the error "not asked".
    """

    @F.pandas_udf(f"struct<reply:struct<answer:string,citations:array<struct<source_id:int,quote:string>>,insufficient_context:boolean>,seconds:double,error:string>")
    def replies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        gone = False  # for all batches of the task
        for questions, texts in batches:
            out = []
            for q, t in zip(questions, texts, strict=True):
                began = time.monotonic()
                if gone:
                    out.append((None, 0.0, f"{QuotaExhausted.__name__}: not asked"))
                    continue
                try:
                    reply, error = with_retry(lambda q=q, t=t: generator.answer(q, list(t)), attempts), None
                except Exception as e:  # an error becomes a row of the log
                    reply, error, gone = None, f"{type(e).__name__}: {e}", isinstance(e, QuotaExhausted)
                out.append((reply, round(time.monotonic() - began, 2), error))
            yield pd.DataFrame(out, columns=["reply", "seconds", "error"])

    return asked.withColumn("generated", replies("question", "texts"))


def decode_answers(replies: DataFrame, column: str = "json") -> DataFrame:
    """Replies in JSON as the answer type; what doesn't fit it fails the query."""
    return replies.withColumn("reply", F.from_json(column, ANSWER_DDL, {"mode": "FAILFAST"}))


def list_models(spark: SparkSession, models: list[dict], current: str, all_models: bool = False) -> DataFrame:
    """Models that can generate (all on request, and those that name no actions), sorted, the current one marked."""
    rows = [(m.get("name", "").removeprefix("models/"), m.get("input", 0), m.get("output", 0), bool(m.get("thinking")), m.get("display", ""), m.get("actions") or []) for m in models]
    df = spark.createDataFrame(rows, "name string, input long, output long, thinking boolean, display string, actions array<string>")
    fit = F.lit(all_models) | (F.size("actions") == 0) | F.array_contains("actions", "generateContent")
    return df.filter(fit).select("name", "input", "output", "thinking", "display", (F.col("name") == current).alias("is_current")).orderBy("name", "input", "output")
