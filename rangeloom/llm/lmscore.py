"""Cross-entropy difference: a target and a background n-gram model over one vocabulary score each document.

Both models are bigram models of the same form over the ids of one tokenizer: the bigram share is smoothed towards the
unigram share, and that towards the uniform one (Dirichlet priors). Counts are exact and taken over all documents
(background) and all documents marked as target. Unigram counts are bounded by the vocabulary and are broadcast; bigram
counts grow with the corpus and stay distributed. Documents are dealt into chunks of about CHUNK tokens; a chunk hands
on each of its bigrams once with its counts, they are summed over all chunks by a shuffle, and the sums return to the
chunks, which look up their documents' bigrams in them. A bigram, however common, has one row a chunk at most (two if a
chunk's file is split). A document's score is the mean over its tokens of target loss minus background loss, in nats:
the lower, the more it resembles the target.

Defined results: a null or empty text, or one that leaves no token, has no tokens and scores 0. With no target at all,
both smoothed models are still defined. A null id or mark is no target; of repeated marks the highest counts. Long texts are
read whole; repeated rows count each time. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm.bpe import load
from rangeloom.llm.common import written

#: Tokens after which a chunk of documents is closed, weight of the unigram model in a bigram share, and of the uniform one below it.
CHUNK, PRIOR, FLOOR = 1 << 20, 50.0, 0.1


@dataclass(frozen=True)
class Model:
    """Counts of one model: by id, and by place in a table of pairs of neighbours."""

    single: np.ndarray
    pair: np.ndarray

    def losses(self, before: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Negative log probability of each token given the one before; places are those of the pairs."""
        n, size = self.single.sum(), len(self.single)
        own = (self.single[ids] + FLOOR) / (n + FLOOR * size)
        return -np.log((self.pair[places] + PRIOR * own) / (self.single[before] + PRIOR))


@dataclass(frozen=True)
class Texts:
    """The tokens of many documents in a row: each token's id, the id before it (start at a document's begin), and the documents' lengths."""

    ids: np.ndarray
    before: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, held: list[bytes], kind: str, start: int) -> Texts:
        ids = np.frombuffer(b"".join(held), kind).astype("int64")
        lengths = np.array([len(h) for h in held], "int64") // np.dtype(kind).itemsize
        before = np.concatenate([[start], ids[:-1]]) if len(ids) else ids
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = start
        return cls(ids, before, lengths)

    def pairs(self, size: int) -> np.ndarray:
        """A number for each token and the one before it, different for different pairs."""
        return self.before * size + self.ids


def _vocabulary(path: str | None) -> tuple[int, int, str]:
    """Number of ids, the id that starts a document, and the type that holds an id."""
    bpe = load(path)
    size = len(bpe.text_of)
    return size, bpe.special["<|startoftext|>"], "<u2" if size <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, marks: DataFrame, path: str | None = None) -> DataFrame:
    """chunk, doc_id, target and ids of documents (doc_id, text), written; marks (doc_id, target): target where not 0."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, kind = load(path), _vocabulary(path)[2]
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t), "<u4").astype(kind).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n, width = TaskContext.get().partitionId() << 32, 0, np.dtype(_vocabulary(path)[2]).itemsize
        for batch in batches:
            own = []
            for ids in batch.column(2):
                if n >= CHUNK:
                    chunk, n = chunk + 1, 0
                own.append(chunk)
                n += len(ids.as_buffer()) // width
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], ["chunk", "doc_id", "target", "ids"])

    marked = marks.filter("doc_id IS NOT NULL AND target IS NOT NULL").groupBy("doc_id").agg(F.max("target").alias("target"))
    ids = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary")
    # marks grow with the corpus: never broadcast, so that the plan is the same at every size
    rows = ids.join(marked.hint("merge"), "doc_id", "left").select("doc_id", (F.coalesce("target", F.lit(0)) != 0).alias("target"), "ids")
    return written(rows.mapInArrow(deal, "chunk long, doc_id long, target boolean, ids binary"))


def single_counts(rows: DataFrame, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Target and background counts by id; the id that starts documents counts once for each that has tokens."""
    size, start, kind = _vocabulary(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), "int64")
        for batch in batches:
            held: tuple[list[bytes], list[bytes]] = ([], [])
            for target, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[target].append(ids)
            for own in (0, 1):
                total[own] += np.bincount(np.frombuffer(b"".join(held[own]), kind), minlength=size)
                total[own, start] += sum(map(bool, held[own]))
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[1, at]), pa.array(total.sum(0)[at])], ["id", "target", "background"])

    sums = rows.select("target", "ids").mapInArrow(count, "id int, target long, background long").groupBy("id").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    found = sums.toArrow().to_pandas()  # one row an id at most
    out = np.zeros((2, size))
    for k, name in enumerate(("target", "background")):
        out[k, found["id"].to_numpy("int64")] = found[name].to_numpy("float64")
    return out[0], out[1]


def pair_counts(rows: DataFrame, path: str | None = None) -> DataFrame:
    """For each chunk, its pairs of neighbours (as Texts.pairs numbers them) with their target and background counts over all chunks."""
    size, start, kind = _vocabulary(path)

    def total(chunk: int, held: list[bytes], targets: list[bool]) -> Iterator[pa.RecordBatch]:
        texts = Texts.of(held, kind, start)
        pairs = texts.pairs(size)
        found, background = np.unique(pairs, return_counts=True)
        own, n = np.unique(pairs[np.repeat(np.array(targets, bool), texts.lengths)], return_counts=True)
        target = np.zeros(len(found), "int64")
        target[np.searchsorted(found, own)] = n
        for k in range(0, len(found), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[part]), chunk)), pa.array(found[part]), pa.array(target[part]), pa.array(background[part])], ["chunk", "pair", "target", "background"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, targets = None, [], []
        for batch in batches:
            for chunk, target, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if chunk != at and held:
                    yield from total(at, held, targets)
                    held, targets = [], []
                at = chunk
                held.append(ids)
                targets.append(target)
        if held:
            yield from total(at, held, targets)

    own = rows.select("chunk", "target", "ids").mapInArrow(count, "chunk long, pair long, target long, background long")
    same = Window.partitionBy("pair")
    return own.select("chunk", "pair", F.sum("target").over(same).alias("target"), F.sum("background").over(same).alias("background"))


def score(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means) and score of each document of encoded rows."""
    size, start, kind = _vocabulary(path)
    shared = rows.sparkSession.sparkContext.broadcast(single_counts(rows, path))

    def run(_: tuple[pa.Scalar, ...], docs: pa.Table, counts: pa.Table) -> pa.Table:
        texts = Texts.of(docs["ids"].to_pylist(), kind, start)
        known, first = np.unique(counts["pair"].to_numpy(), return_index=True)
        places = first[np.searchsorted(known, texts.pairs(size))]
        means = []
        for single, name in zip(shared.value, ("target", "background")):
            ends = np.concatenate([[0.0], np.cumsum(Model(single, counts[name].to_numpy()).losses(texts.before, texts.ids, places))])
            at = np.cumsum(texts.lengths)
            means.append((ends[at] - ends[at - texts.lengths]) / np.maximum(texts.lengths, 1))
        return pa.table([docs["doc_id"], pa.array(texts.lengths), *map(pa.array, means), pa.array(means[0] - means[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return rows.select("chunk", "doc_id", "ids").groupBy("chunk").cogroup(pair_counts(rows, path).groupBy("chunk")).applyInArrow(run, schema)


def cross_entropy_difference(docs: DataFrame, marks: DataFrame, path: str | None = None) -> DataFrame:
    """Count both models over all documents and score each of them."""
    return score(encoded(docs, marks, path), path)
