"""Providers of text and vectors: a seam through which partitions call a client, with bounded concurrency and retries.

A client is made on the executor by a function given by the caller, so tests give an offline one. `Endpoint` speaks the
common JSON interface of hosted models with the standard library alone.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@dataclass(frozen=True)
class Endpoint:
    """A hosted model under `base`. The key is read on the executor from the environment variable named, if any."""

    base: str
    model: str
    key_variable: str | None = None
    seconds: float = 60.0

    def _post(self, path: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"}
        if self.key_variable:
            head["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        asked = urllib.request.Request(f"{self.base.rstrip('/')}/{path}", json.dumps({"model": self.model} | body).encode(), head)
        with urllib.request.urlopen(asked, timeout=self.seconds) as got:
            return json.load(got)

    def reply(self, prompt: str) -> str:
        return self._post("chat/completions", {"messages": [{"role": "user", "content": prompt}]})["choices"][0]["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts, whatever the order of the answer."""
        return [d["embedding"] for d in sorted(self._post("embeddings", {"input": texts})["data"], key=lambda d: d["index"])]


def retried(call: Callable, argument, retries: int = 2, pause: float = 0.5):
    """call(argument), tried again after pause, 2 * pause, ...; the last failure ends the batch as a RuntimeError."""
    for attempt in range(retries + 1):
        try:
            return call(argument)
        except Exception as e:  # whatever the client raises
            if attempt == retries:
                raise RuntimeError(f"no reply after {retries + 1} attempts: {e}") from e
            time.sleep(pause * 2**attempt)


def replies(requests: DataFrame, make: Callable[[], object], prompt: str = "prompt", out: str = "value", at_once: int = 32, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """requests with the reply to each prompt in `out`; at most `at_once` calls of a task are open. A null prompt has a null reply.

    Meant for distinct prompts that the cache lacks: see `store.cached`. One prompt that fails fails the job.
    """
    schema = requests.drop(out).schema.add(out, "string")

    def run(batches: Iterator) -> Iterator:
        client = make()
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                got = pool.map(lambda p: None if p is None else retried(client.reply, p, retries, pause), pdf[prompt].tolist())
                yield pdf.drop(columns=[out], errors="ignore").assign(**{out: list(got)})

    return requests.mapInPandas(run, schema)


def embedded(rows: DataFrame, make: Callable[[], object], column: str, out: str = "embedding", batch: int = 256, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """rows with the vector of a text column in `out`, `batch` texts a call; null texts have null vectors."""
    schema = rows.drop(out).schema.add(out, ArrayType(DoubleType()))

    def run(batches: Iterator) -> Iterator:
        client = make()
        for pdf in batches:
            texts = pdf[column].tolist()
            have = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for k in range(0, len(have), batch):
                part = have[k : k + batch]
                got = retried(client.embed, [texts[i] for i in part], retries, pause)
                if len(got) != len(part):
                    raise RuntimeError(f"{len(part)} texts got {len(got)} vectors")
                for i, v in zip(part, got):
                    vectors[i] = [float(x) for x in v]
            yield pdf.drop(columns=[out], errors="ignore").assign(**{out: vectors})

    return rows.mapInPandas(run, schema)


def label_of(reply: Column) -> Column:
    """First line of a reply that has been stripped as a whole, so the line may end in blanks; a stated label where there is none."""
    line = F.regexp_extract(F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s+|\s+$", "")), r"^[^\r\n]*", 0)
    return F.when(line == "", F.lit("Unlabeled cluster")).otherwise(line)
