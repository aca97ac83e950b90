"""Language models behind a small interface, with limits and repairs; nothing here needs a network unless a client does."""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions.text import word_count


class Client(Protocol):
    """Anything that answers a prompt with a text."""

    def complete(self, prompt: str) -> str: ...


class Recorded:
    """A client that answers from a function or a table of prompts: for tests and for offline runs."""

    def __init__(self, answers: dict[str, str] | Callable[[str], str]):
        self.answers = answers

    def complete(self, prompt: str) -> str:
        return self.answers(prompt) if callable(self.answers) else self.answers.get(prompt, "")


class Limiter:
    """At most ``per_minute`` calls in any 60 seconds."""

    def __init__(self, per_minute: float = 12, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_minute, self.clock, self.sleep = per_minute, clock, sleep
        self.calls: deque[float] = deque()
        self.lock = threading.Lock()

    def wait(self) -> None:
        with self.lock:
            while True:
                now = self.clock()
                while self.calls and now - self.calls[0] >= 60:
                    self.calls.popleft()
                if len(self.calls) < max(1, self.per_minute):
                    self.calls.append(now)
                    return
                self.sleep(60 - (now - self.calls[0]))


def retry_delay(error: Exception, attempt: int, base: float = 1.0, most: float = 8.0, jitter: Callable[[], float] = random.random) -> float:
    """Seconds to wait: what the error asks for, or a doubling time with jitter."""
    asked = getattr(error, "retry_after", None)
    if asked is None:
        said = re.search(r"after\s+(\d+(?:\.\d+)?)\s*s", str(error), re.IGNORECASE)
        asked = said and said.group(1)
    if asked is not None:
        return float(asked)
    return min(most, base * 2**attempt) + jitter() * 0.25 * base


def completed(client: Client, prompt: str, limiter: Limiter | None = None, attempts: int = 10, sleep: Callable[[float], None] = time.sleep) -> str:
    """The client's answer; an empty text if all attempts fail."""
    for attempt in range(attempts):
        try:
            if limiter:
                limiter.wait()
            return client.complete(prompt)
        except Exception as error:  # noqa: BLE001 - any failure of a service is retried
            if attempt + 1 < attempts:
                sleep(retry_delay(error, attempt))
    return ""


def repaired_json(answer: str) -> object:
    """The JSON in an answer: in a fence or bare, with None and trailing commas put right; {} if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", answer or "", re.DOTALL)
    text = (fenced.group(1) if fenced else answer or "").strip().replace("None", "null")
    for candidate in (text, re.sub(r",\s*([\]}])", r"\1", re.sub(r"\s+", " ", text))):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return {}


def answered(prompts: DataFrame, make: Callable[[], Client], concurrency: int = 2, per_minute: float = 12) -> DataFrame:
    """``prompts`` (key, prompt) with answer. ``make`` gives a client in each of ``concurrency`` tasks, which share the rate."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, limiter = make(), Limiter(per_minute / concurrency)
        for batch in batches:
            yield batch.assign(answer=[completed(client, p, limiter) for p in batch["prompt"]])

    rows = prompts.select(F.col("key").cast("string").alias("key"), "prompt").repartition(concurrency)
    return rows.mapInPandas(ask, "key string, prompt string, answer string")


def summarised(nodes: DataFrame, make: Callable[[], Client], least: int = 200, concurrency: int = 2, per_minute: float = 12) -> DataFrame:
    """``nodes`` (doc_id, node_id, is_leaf, text, ...) with summary for leaves and prefix_summary for inner nodes: the text
    itself if it has fewer than ``least`` words, else what a model says of it."""
    key = F.to_json(F.struct("doc_id", "node_id"))
    long = word_count(F.col("text")) >= least
    prompts = nodes.where(long).select(key.alias("key"), F.concat(F.lit("Summarise this section in a few sentences.\n"), F.col("text")).alias("prompt"))
    said = answered(prompts, make, concurrency, per_minute).select("key", "answer")
    out = nodes.drop("summary", "prefix_summary").withColumn("key", key).join(said, "key", "left").withColumn("_said", F.coalesce("answer", "text"))
    return out.withColumns({"summary": F.when(F.col("is_leaf"), F.col("_said")), "prefix_summary": F.when(~F.col("is_leaf"), F.col("_said"))}).drop("key", "answer", "_said")


def described(nodes: DataFrame, make: Callable[[], Client], concurrency: int = 2, per_minute: float = 12) -> DataFrame:
    """doc_id and doc_description: a sentence by a model on each document's titles and summaries."""
    line = F.concat_ws(": ", "title", F.coalesce("summary", "prefix_summary"))
    whole = nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    prompts = whole.select(F.col("doc_id").alias("key"), F.concat(F.lit("Describe this document in one sentence.\n"), F.col("t")).alias("prompt"))
    return answered(prompts, make, concurrency, per_minute).select(F.col("key").alias("doc_id"), F.col("answer").alias("doc_description"))


def reranked(results: DataFrame, order: DataFrame) -> DataFrame:
    """``results`` (qid, rank, node_id, ...) permuted by a model's ``order`` (qid, place, node_id): ids it names first, by
    their first place; unknown ids are passed over and unnamed results follow in their old order."""
    first = order.groupBy("qid", "node_id").agg(F.min("place").alias("_place"))
    out = results.join(first, ["qid", "node_id"], "left")
    by = Window.partitionBy("qid").orderBy(F.col("_place").asc_nulls_last(), "rank")
    return out.withColumn("new_rank", F.row_number().over(by)).drop("_place")


def rerank_prompt(query: str, results: list[dict]) -> str:
    lines = "\n".join(f"- {r['node_id']}: {r['title']} | {r.get('summary') or r.get('snippet') or ''}" for r in results)
    return f"Order these sections by how well they answer the question. Give a JSON list of ids only.\nQuestion: {query}\n{lines}"


def rerank(results: DataFrame, query: str, client: Client, top: int = 3) -> DataFrame:
    """One query's results with their first ``top`` permuted by a model. What goes to the driver is those rows."""
    rows = [r.asDict() for r in results.where(F.col("rank") <= top).orderBy("rank").select("qid", "rank", "node_id", "title", "summary", "snippet").collect()]
    ids = repaired_json(completed(client, rerank_prompt(query, rows), attempts=3)) if rows else []
    known = {r["node_id"] for r in rows}
    named = [(rows[0]["qid"], k, str(i)) for k, i in enumerate(ids if isinstance(ids, list) else []) if str(i) in known]
    order = results.sparkSession.createDataFrame(named, f"qid {results.schema['qid'].dataType.simpleString()}, place int, node_id string")
    return reranked(results, order)
