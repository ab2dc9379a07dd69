"""Quality by nearest-neighbour votes in a latent-semantic space.

A document is a vector of hashed byte n-grams (weighted by inverse document frequency) and of terms for its shape
(repeated words and lines, capitals, signs). The leading eigenvectors of the labelled sample's term products span the
latent space. The labelled vectors are broadcast, at most ``bound`` of them; every document's cosine with each is
computed exactly, block by block, and its nearest neighbours' labels are weighted by similarity.

Defined results: a null text counts as empty, and empty texts are scored like others. A null label or id is not learned
from; of repeated labels the higher counts. Equal similarities go to the labelled row of smaller id. With nothing
learned the score is 0.5. Long texts are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import bounded_sample, fold
from rangeloom.llm.grams import gram_counts, shape_terms

ORDERS, BITS = (1, 2, 3), 11
RANK, NEIGHBOURS, POWER, BLOCK = 64, 15, 8, 512
GRAMS_SHARE, SHAPES_SHARE = 0.5, 1.0
PARTS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    idf: tuple[np.ndarray, np.ndarray]  # of n-grams and of shape terms
    axes: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled x rank, of length one
    labels: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of n-gram shares, and shape terms."""
    grams = np.array([gram_counts(t or "", ORDERS, BITS, False) for t in texts], "float32")
    return np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1)), np.array([shape_terms(t or "") for t in texts], "float32")


def weighted(parts: tuple[np.ndarray, np.ndarray], idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.concatenate([share * _unit(p * w) for share, p, w in zip((GRAMS_SHARE, SHAPES_SHARE), parts, idf)], axis=1)


def fit(docs: DataFrame, labels: DataFrame, bound: int = 4096) -> Model | None:
    """Learn from at most about ``bound`` labelled rows outside the held-out fold; None if there are none."""
    own = labels.select(F.col("doc_id"), F.col("quality").alias("label")).dropna().filter(fold("doc_id", PARTS) != HELD_OUT)
    sample = bounded_sample(own, "doc_id", bound).groupBy("doc_id").agg(F.max("label").alias("label"))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, shapes = terms(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in grams]), pa.array([x.tobytes() for x in shapes])], ["doc_id", "label", "grams", "shapes"])

    schema = f"doc_id {dict(found.dtypes)['doc_id']}, label {dict(found.dtypes)['label']}, grams binary, shapes binary"
    rows = found.mapInArrow(run, schema).toArrow().to_pandas().sort_values(["doc_id", "grams"], ignore_index=True)
    if rows.empty:
        return None
    parts = tuple(np.frombuffer(b"".join(rows[c]), "float32").reshape(len(rows), -1) for c in ("grams", "shapes"))
    idf = tuple(np.log((1 + len(rows)) / (1 + (p > 0).sum(0))).astype("float32") for p in parts)
    x = weighted(parts, idf)
    _, vectors = np.linalg.eigh(x.T.astype("float64") @ x)
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :RANK], "float32")
    return Model(idf, axes, _unit(x @ axes), rows["label"].to_numpy("float32"))


def vote(latent: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors, for a block of documents."""
    cosine = latent @ model.vectors.T
    near = np.argsort(-cosine, axis=1, kind="stable")[:, :NEIGHBOURS]
    weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype("float64") ** POWER + 1e-12
    return np.clip((weight * model.labels[near]).sum(1) / weight.sum(1), 0, 1)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of each document."""
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1)
            out = [vote(_unit(weighted(terms(texts.slice(k, BLOCK).to_pylist()), m.idf) @ m.axes), m) for k in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out or [np.zeros(0)]))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = F.coalesce(fold("doc_id", PARTS) == HELD_OUT, F.lit(False))
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
