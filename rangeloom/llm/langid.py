"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; each of its bits has a binary classifier, a linear one over hashed n-grams whose weights
are the log ratio of the n-gram shares on both sides of the bit. A text's margins are decoded by the loss of each
codeword, weighted by how well the bit told the sample apart; the codeword of least loss wins, and a text whose best
two codewords are close is flagged as ambiguous.

Learning takes about ``per_language`` documents of each language at most (chosen by a hash of the id) from those with a
language and outside the held-out fold; every language that has one is learned. The driver holds one row of n-gram shares
for each language.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and is the only kind that is rejected;
with no language learned, everything is ``und``. A null id is in no fold: it is scored, not held out, never learned
from. Long texts are read whole. Repeated rows get equal answers; ties go to the first language in order. An empty table
gives no rows. Other columns are kept by the stage and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.llm.common import fold, free_names
from rangeloom.llm.grams import gram_counts

ORDERS, BITS = (1, 2, 3), 14
PARTS, HELD_OUT = 4, 2
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # cells x bits
    loss_weights: np.ndarray  # bits


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """k codewords of +1 and -1: every split of the languages for few, else the best of some random codes."""
    if k <= 7:
        columns = [(1, *rest) for rest in product((1, -1), repeat=max(k - 1, 0)) if -1 in rest] or [(1,) * k]
        return np.array(columns, "float64").T
    rng, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, 10 * int(np.ceil(np.log2(k)))))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = min((code.shape[1] - code @ code.T)[np.triu_indices(k, 1)])
        if apart > distance:
            best, distance = code, apart
    return best


def fit(docs: DataFrame, per_language: int = 1500) -> Model:
    """Learn from documents (doc_id, text, lang) outside the held-out fold."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", PARTS) != HELD_OUT))
    counts = known.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not counts:
        return Model((), np.zeros((0, 1)), np.zeros((1 << BITS, 1)), np.ones(1))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LETTER.search(text):
                    own = gram_counts(text, ORDERS, BITS, True)
                    # each document counts alike, so that a few long ones do not set the shares
                    total[lang] = total.get(lang, 0) + own / own.sum()
        for lang, cells in total.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(cells[at])], ["lang", "cell", "share"])

    rows = sample.select("lang", "text").mapInArrow(count, "lang string, cell int, share double").groupBy("lang", "cell").agg(F.sum("share").alias("share")).toArrow().to_pandas()
    names = tuple(sorted(set(rows["lang"])))
    if not names:
        return Model((), np.zeros((0, 1)), np.zeros((1 << BITS, 1)), np.ones(1))
    shares = np.zeros((len(names), 1 << BITS))
    place = {name: k for k, name in enumerate(names)}
    shares[rows["lang"].map(place), rows["cell"]] = rows["share"].round(12)
    shares /= shares.sum(1, keepdims=True)
    code = codewords(len(names))
    side = [np.where(code == s, 1.0, 0.0).T @ shares / np.maximum((code == s).sum(0)[:, None], 1) for s in (1, -1)]
    weights = np.log((side[0] + 1e-6) / (side[1] + 1e-6)).T
    margins = (shares @ weights) * code  # of an average document of each language
    weights = weights / np.maximum(np.abs(margins).mean(0), 1e-9)
    margins = (shares @ weights) * code
    loss_weights = np.maximum(margins.min(0), 0.05)
    return Model(names, code, weights.astype("float32"), loss_weights / loss_weights.sum())


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Index of the codeword of least weighted logistic loss, and each language's share of the evidence."""
    loss, step = np.empty((len(margins), len(model.code))), max(1, 4_000_000 // model.code.size)
    for k in range(0, len(margins), step):
        z = margins[k : k + step, None, :] * model.code[None, :, :]
        loss[k : k + step] = np.log1p(np.exp(-4 * np.clip(z, -8, 8))) @ model.loss_weights
    evidence = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    return loss.argmin(1), evidence / evidence.sum(1, keepdims=True)


def predict(docs: DataFrame, model: Model, ambiguous_below: float = 0.6, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs (text and further columns, all kept) with the language, its share of the evidence, and ambiguity, by these names.

    Where no language was learned, texts with a letter are 'und' and ambiguous; those without one are 'und' only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            at = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
            unlearned = np.zeros(len(texts), bool)
            unlearned[at] = not m.languages
            if at and m.languages:
                margins = []
                for k in at:
                    cells = gram_counts(texts[k], ORDERS, BITS, True).astype("float32")
                    margins.append(cells @ m.weights / cells.sum())
                best, evidence = decode(np.array(margins, "float64"), m)
                for k, b, e in zip(at, best, evidence):
                    lang[k], score[k] = m.languages[b], e[b]
            unsure = (score > 0) & (score < ambiguous_below) | unlearned
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*batch.schema.names, *names])

    types = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, types))]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", PARTS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with a letter, whether or not a language could be learned; those without one are rejected."""
    names = tuple(free_names(docs.columns, "lang_pred", "score", "ambiguous"))
    return predict(docs, fit(docs), names=names).filter((F.col(names[0]) != "und") | F.col(names[2])).select(*docs.columns)
