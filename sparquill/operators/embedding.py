"""Embeddings of chunks: batches of texts to a model, all or nothing for each document."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_folder

BATCH = 24
Model = Callable[[list[str]], np.ndarray]


def hashed_words(dimensions: int = 64) -> Model:
    """A model without weights: words counted in slots by the first eight hex digits of their MD5."""

    def run(texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions] += 1
        return out

    return run


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def embed(texts: list[str], model: Model, dimensions: int, kind: str = "passage", prefixed: bool = False) -> np.ndarray:
    """Unit vectors of one batch; models that want it see "query: " or "passage: " before each text."""
    asked = [f"{kind}: {x}".strip() if prefixed else x.strip() for x in texts]
    got = np.asarray(model(asked), float)
    if got.shape[0] != len(texts):
        raise ValueError(f"{len(texts)} texts gave {got.shape[0]} vectors")
    if got.ndim != 2 or got.shape[1] != dimensions:
        raise ValueError(f"vectors have {got.shape[1:]} numbers, not {dimensions}")
    return _unit(got)


def embed_chunks(chunks: DataFrame, model: Model, name: str, dimensions: int, by: str = "document_id", text: str = "content", batch: int = BATCH, prefixed: bool = False) -> DataFrame:
    """Chunks with ``embedding``, ``embedding_model`` and ``warning``.

    A batch that fails leaves its chunks without vectors and the others go on; a
    document with such a chunk then has no vector at all, and says why. Vectors are
    written once to the shared folder, as a model is dear. A blank text is a text.
    """
    spark = chunks.sparkSession
    schema = T.StructType([*chunks.schema, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("warning", T.StringType())])

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                try:
                    part["embedding"] = list(embed([x or "" for x in part[text]], model, dimensions, "passage", prefixed))
                    part["warning"] = None
                except Exception as e:  # a model's failure must not end the others
                    part["embedding"], part["warning"] = None, f"no embeddings: {e}"
                yield part

    at = f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}"
    chunks.mapInPandas(run, schema).write.parquet(at)
    made = spark.read.schema(schema).parquet(at)
    bad = made.where("warning IS NOT NULL").groupBy(F.col(by).alias("_bad")).agg(F.min("warning").alias("_why"))
    d = made.join(bad, F.col(by).eqNullSafe(F.col("_bad")) & F.col("_why").isNotNull(), "left")
    whole = F.col("_why").isNull()
    return d.select(*chunks.columns, F.when(whole, F.col("embedding")).alias("embedding"), F.when(whole, F.lit(name)).alias("embedding_model"), F.col("_why").alias("warning"))


@dataclass(frozen=True)
class Config:
    provider: str
    model: str
    dimensions: int
    batch: int = BATCH


#: Defaults of the settings (fixed values).
PROVIDER, MODEL, DIMENSIONS = "local", "intfloat/multilingual-e5-small", 384


def config(settings: dict[str, str]) -> Config | None:
    """The model that settings name, none where vectors are switched off or the provider isn't known or has no key."""
    said = lambda k, default: (settings.get(k) or default).strip()
    if said("vector_search_enabled", "true").lower() in ("0", "false", "no", "off"):
        return None
    provider = said("provider", PROVIDER).lower()
    if provider not in ("local", "remote") or (provider == "remote" and not said("api_key", "")):
        return None
    number = lambda k, default: int(said(k, str(default))) if said(k, str(default)).isdigit() else default
    return Config(provider, said("model", MODEL), number("dimensions", DIMENSIONS), max(1, number("batch", BATCH)))
