"""Dense embeddings behind one protocol: a function from texts to vectors, called in batches, with a cache by hash."""

from __future__ import annotations

import json
import random
import time
import warnings
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Embedder(Protocol):
    name: str
    dimensions: int
    batch: int

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


class LocalDaemon:
    """A local embedding service: one text a request; a failed one is a zero vector."""

    def __init__(self, model: str, url: str = "http://localhost:11434", dimensions: int = 768, post: Callable = _post):
        self.name, self.model, self.url, self.dimensions, self.batch, self.post = f"daemon:{model}", model, url.rstrip("/"), dimensions, 10, post

    def available(self, timeout: float = 2.0) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=timeout) as reply:
                return reply.status == 200
        except (OSError, ValueError):
            return False

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            try:
                out.append(self.post(f"{self.url}/api/embed", {"model": self.model, "input": text}, {}, 60.0)["embeddings"][0])
            except (OSError, ValueError, KeyError, IndexError):
                out.append([0.0] * self.dimensions)
        return out


class HostedService:
    """A hosted service: 100 texts a request, tried five times while it says that requests are too many."""

    def __init__(self, model: str, key: str, url: str = "https://api.openai.com/v1/embeddings", dimensions: int = 1536, post: Callable = _post, wait: Callable[[float], None] = time.sleep):
        if not key:
            raise ValueError("a key is needed")
        self.name, self.model, self.key, self.url, self.dimensions, self.batch, self.post, self.wait = f"hosted:{model}", model, key, url, dimensions, 100, post, wait

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        for attempt in range(5):
            try:
                reply = self.post(self.url, {"model": self.model, "input": list(texts)}, {"Authorization": f"Bearer {self.key}"}, 60.0)
                return [d["embedding"] for d in sorted(reply["data"], key=lambda d: d["index"])]
            except urllib.error.HTTPError as e:
                if e.code != 429 or attempt == 4:
                    raise
                self.wait(2**attempt * (1 + random.random() / 4))
        raise AssertionError

    @staticmethod
    def cost(n: int) -> float:
        """Dollars for n texts of about 100 tokens."""
        return n * 100 / 1e6 * 0.02


def embed(texts: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """texts(id, text): (id, embedding), and the new rows (hash, backend, embedding) for the cache.

    Each distinct text that the cache doesn't have is sent once, in batches of the embedder's size.
    """
    hashed = texts.select("id", F.sha1("text").alias("hash"), "text")
    wanted = hashed.select("hash", "text").dropDuplicates(["hash"])
    known = cache.where(F.col("backend") == embedder.name).select("hash", "embedding") if cache is not None else None
    if known is not None:
        wanted = wanted.join(known, "hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), embedder.batch):
                part = frame.iloc[at : at + embedder.batch]
                yield pd.DataFrame({"hash": part["hash"], "backend": embedder.name, "embedding": embedder(part["text"].tolist())})

    from loomgraph.session import written

    new = written(wanted.mapInPandas(run, "hash string, backend string, embedding array<double>"), "embeddings")
    every = new.select("hash", "embedding") if known is None else known.union(new.select("hash", "embedding"))
    return hashed.select("id", "hash").join(every, "hash").select("id", "embedding"), new


CACHE = "embeddings"


def load_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows (hash, backend, embedding) kept in a folder; None if there are none or they can't be read."""
    try:
        found = spark.read.parquet(f"{folder}/{CACHE}")
        return found.select("hash", "backend", "embedding") if found.take(1) else None
    except AnalysisException:
        return None


def save_cache(new: DataFrame, folder: str) -> None:
    """Adds new rows to those in a folder."""
    new.write.mode("append").parquet(f"{folder}/{CACHE}")


def usable(embedder: Embedder | None) -> Embedder | None:
    """The embedder, or None (that is, TF-IDF), with a warning, if it is a service that doesn't answer."""
    if embedder is not None and hasattr(embedder, "available") and not embedder.available():
        warnings.warn(f"{embedder.name} doesn't answer: TF-IDF is used", stacklevel=2)
        return None
    return embedder
