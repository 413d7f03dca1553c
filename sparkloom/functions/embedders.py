"""Embedders: what turns text into vectors. The hashing one needs no model and runs as column expressions."""

from __future__ import annotations

import json
import os
import urllib.request
import warnings
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from . import vectors as V

# The hosts that count as this machine, and the setting that allows others.
LOOPBACK = ("127.0.0.1", "localhost", "0.0.0.0", "::1")
ALLOW_REMOTE = "SPARKLOOM_ALLOW_REMOTE"
#: Where models answer, if not at the usual place, and the embedder and the reranker's model if none is named.
MODEL_URL, EMBEDDER, RERANK_MODEL = "SPARKLOOM_MODEL_URL", "SPARKLOOM_EMBEDDER", "SPARKLOOM_RERANK_MODEL"


def model_url() -> str:
    return os.environ.get(MODEL_URL, "http://127.0.0.1:11434")


class Embedder(Protocol):
    """name, dim, and embed(df with id and text) to id and embedding array<float>; dim_is_exact: dim is known before
    the first text."""

    name: str
    dim: int
    dim_is_exact: bool

    def embed(self, df: DataFrame) -> DataFrame: ...


class HashEmbedder:
    dim_is_exact = True

    def __init__(self, dim: int = V.DEFAULT_DIM):
        self.name, self.dim = f"hash-{dim}", dim

    def embed(self, df: DataFrame) -> DataFrame:
        slots = V.hash_embed(df.select("id", X.tokenize("text").alias("tokens")), "id", self.dim)
        both = df.select("id").join(slots, "id", "left")
        return both.select("id", V.dense(F.coalesce("slots", F.create_map().cast("map<int,double>")), self.dim).alias("embedding"))


class LocalHttpEmbedder:
    """A model behind HTTP on this machine; its width is known after the first answer only. Executors ask the model on
    their own machines, one text at a time."""

    dim_is_exact = False
    TIMEOUT_S = 60

    def __init__(self, model: str, url: str | None = None):
        self.name, self.dim, self.url = f"http-{model}", 0, check_host(url or model_url())

    def embed(self, df: DataFrame) -> DataFrame:
        url, model, timeout = self.url.rstrip("/"), self.name.removeprefix("http-"), self.TIMEOUT_S

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [ask_embedding(url, model, t or "", timeout) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], names=["id", "embedding"])

        out = df.select("id", "text").mapInArrow(run, f"id {dict(df.dtypes)['id']}, embedding array<float>")
        if not self.dim_is_exact:
            self.dim, self.dim_is_exact = len(ask_embedding(url, model, "width", timeout)), True
        return out


def ask(url: str, body: dict, timeout: float) -> dict:
    """The JSON answer to a JSON question."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def ask_embedding(url: str, model: str, text: str, timeout: float) -> list[float]:
    try:
        return [float(x) for x in ask(f"{url}/api/embeddings", {"model": model, "prompt": text}, timeout)["embedding"]]
    except OSError as e:
        raise RuntimeError(f"no embedding model answers at {url} ({e}); start one, or use the hash embedder") from e
    except (KeyError, TypeError, ValueError) as e:
        raise RuntimeError(f"what answers at {url} gives no embedding ({e!r}); is {model!r} an embedding model?") from e


def check_host(url: str) -> str:
    """The url if its host is this machine, or others are allowed by the environment; exact names only."""
    host = urlparse(url).hostname
    if host in LOOPBACK:
        return url
    if os.environ.get(ALLOW_REMOTE) == "1":
        warnings.warn(f"texts are sent to {host}, which is not this machine", stacklevel=2)
        return url
    raise ValueError(f"{host} is not this machine; set {ALLOW_REMOTE}=1 to send texts there")


def get_embedder(name: str | None = None) -> Embedder:
    """hash, hash-<dim> or http-<model>; from the environment if no name is given."""
    name = name or os.environ.get(EMBEDDER, "hash")
    if name == "hash":
        return HashEmbedder()
    if name.startswith("hash-") and name[5:].isdigit():
        return HashEmbedder(int(name[5:]))
    if name.startswith("http-"):
        return LocalHttpEmbedder(name[5:])
    raise ValueError(f"unknown embedder {name!r}")
