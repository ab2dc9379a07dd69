"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer (a trie of word beginnings and whole words) turns words into symbols: insult, threat, target,
negation, reported speech, clause end. Three small transducers follow, each composed with the one before: negation and
reported speech mark the insults and threats of their clause, and the target transducer marks those aimed at someone.
They run over the symbols from the left and then from the right, so that what stands behind an insult or threat marks it
as well as what stands before. What leaves the grammar are matched clauses: those with an insult, and those with a threat
that has a target, each with its marks and the weight of its insults and threats.

A document's score is a logistic function of what its matched clauses weigh by kind. The signs of the coefficients are
fixed: insults, aimed insults and aimed threats cannot lower a score, negation and reported speech cannot raise it. Each
coefficient is drawn towards a stated prior, so that a kind of clause of which the labelled rows hold no case still counts.

Insult entries and their weights are learned from labelled rows outside the held-out fold, about ``bound`` of them at
most. Documents that share their smallest shingle hash and label count once there, so that copies cannot make their words
look toxic. A beginning enters the lexicon when the likelihood ratio of its document counts is large, a longer one only
where it tells more than the shorter; its weight is the log ratio of its rates among the words of toxic and other rows.

Defined results: a null or empty text has no match and gets the score of such documents. A null label or id is not
learned from; of repeated labels the higher counts. With nothing learned the score is 0. Long texts are read whole. An
empty table gives no rows. Other columns are kept by the stage and ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.llm.common import bounded_sample, discard, fold, free_names, written

PARTS, HELD_OUT, THRESHOLD = 4, 2, 0.3
TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")
#: Letters of a beginning; least likelihood ratio and least weight of an entry.
PREFIXES, LEAST_RATIO, LEAST_WEIGHT = range(4, 9), 25.0, 1.5
#: Weight of a threat of the fixed list, as of an insult that is some fifty times as frequent in toxic text.
THREAT = 4.0
#: Words kept in a worker's table of looked-up words before it is emptied.
KEPT = 300_000
#: Stems of threatening verbs and the endings that make their forms (- is none).
THREATS = {
    "kill destroy": "- s ing ed",
    "punish": "- es ing ed",
    "hurt": "- s ing",
    "beat": "- s ing en",
    "töt getöt zerstör": "en e est st et t ete eten te ten",
    "schlag geschlag": "en e t",
    "schläg": "st t",
    "schlug": "- st en",
    "tu frapp": "er e es ent ez ons é és ée ées ant erai eras era erons erez eront",
    "détrui": "re s t sent sez sons sant te ts tes rai ras ra rons rez ront",
    "mat golpe": "ar o as a amos an é ó aron aré arás ará aremos arán ando ado ados ada adas",
    "destru": "ir yo yes ye imos yen í yó yeron iré irás irá iremos irán yendo ido idos ida idas",
}
#: Fixed seed words of the grammar; insults are learned.
SEEDS = {
    "threat": [stem + end.replace("-", "") for stems, ends in THREATS.items() for stem in stems.split() for end in ends.split()],
    "target": "you your yours yourself he him his himself she her hers herself they them their us du dich dir dein deine ihr euch euer er ihn ihm sie uns tu toi te vous votre il elle lui ils elles leur nous tú te usted ustedes él ella ellos ellas les nos".split(),
    "negation": "not no never nobody nothing neither nor without cannot nicht kein keine keinen nie niemals niemand ohne pas jamais aucun aucune personne sans nunca jamás nadie ninguno ninguna sin".split(),
    "reported": "said says say saying told tells tell wrote writes write quoted quotes claimed claims called calls sagte sagt sagen schrieb schreibt behauptete behauptet nannte dit disait disent écrit écrivait affirmait affirme dijo dice dicen decía escribió escribe afirmó afirma".split(),
}

Arcs = dict[tuple[str, str], tuple[str, str]]


@dataclass(frozen=True)
class Fst:
    """A deterministic transducer: (state, symbol) leads to (state, symbol out); symbols without an arc pass through."""

    start: str
    arcs: Arcs
    states: frozenset[str]

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Fst, second: Fst, symbols: list[str]) -> Fst:
    """The transducer that feeds what the first emits to the second."""
    arcs: Arcs = {}
    for a in first.states:
        for b in second.states:
            for symbol in symbols:
                to_a, out = first.step(a, symbol)
                to_b, out = second.step(b, out)
                arcs[f"{a}/{b}", symbol] = (f"{to_a}/{to_b}", out)
    return Fst(f"{first.start}/{second.start}", arcs, frozenset(f"{a}/{b}" for a in first.states for b in second.states))


MARKS = "-~+"


def marked(symbol: str, mark: str) -> str:
    """The symbol with one more mark; marks stand in one order, and none twice."""
    return symbol.rstrip(MARKS) + "".join(m for m in MARKS if m in symbol or m == mark)


def scope(opener: str, mark: str, events: list[str]) -> Fst:
    """From an opening symbol to the clause's end, the events (whatever marks they have) get one more mark."""
    arcs: Arcs = {("out", opener): ("in", opener), ("in", "end"): ("out", "end")}
    arcs |= {("in", s): ("in", marked(s, mark)) for s in events}
    return Fst("out", arcs, frozenset(("out", "in")))


def grammar() -> Fst:
    """Negation, then reported speech, then target, composed; it takes in what it gives out, so that it can run both ways."""
    events = [e + n + r + t for e in ("insult", "threat") for n in ("", "-") for r in ("", "~") for t in ("", "+")]
    symbols = [*events, "target", "negation", "reported", "end"]
    steps = [scope("negation", "-", events), scope("reported", "~", events), scope("target", "+", events)]
    return reduce(lambda a, b: compose(a, b, symbols), steps)


def both_ways(symbols: list[str], fst: Fst) -> list[str]:
    """The symbols after a run from the left and one from the right over what that gave."""
    for way in (1, -1):
        state, out = fst.start, []
        for symbol in symbols[::way]:
            state, found = fst.step(state, symbol)
            out.append(found)
        symbols = out[::way]
    return symbols


#: Kinds of matched clause: with an insult or an aimed threat, each with the clause's marks.
KINDS = [f"insult{n}{r}{t}" for n in ("", "-") for r in ("", "~") for t in ("", "+")] + [f"threat{n}{r}+" for n in ("", "-") for r in ("", "~")]


@dataclass
class Lexicon:
    """The lexical transducer: word -> (symbol, weight). Longer entries are those that add weight to their beginning."""

    insults: dict[str, float]
    known: dict[str, tuple[str, float] | None] = field(default_factory=dict)
    fixed: dict[str, str] = field(default_factory=lambda: {w: kind for kind, words in SEEDS.items() for w in words} | {e: "end" for e in ENDS})

    def look_up(self, word: str) -> tuple[str, float] | None:
        weight = max((self.insults[p] for p in [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)] if p in self.insults), default=0.0)
        if weight:
            return "insult", weight
        return (self.fixed[word], THREAT) if word in self.fixed else None

    def symbols(self, text: str) -> tuple[list[tuple[str, float]], int]:
        """The symbols of a text in turn (other words leave none) and its number of words and ends."""
        words, known = TOKENS.findall(text.lower()), self.known
        if len(known) >= KEPT:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = self.look_up(word)
        return [s for s in map(known.__getitem__, words) if s], len(words)


def clauses(text: str | None, lexicon: Lexicon, fst: Fst) -> tuple[list[dict[str, float]], int, int]:
    """The matched clauses, each with the weight of its events by kind; the number of all clauses, and of words."""
    found: list[dict[str, float]] = [{}]
    symbols, words = lexicon.symbols(text or "")
    if not any(s in ("insult", "threat") for s, _ in symbols):
        return [], 1 + sum(s == "end" for s, _ in symbols), words
    for symbol, (_, weight) in zip(both_ways([s for s, _ in symbols], fst), symbols):
        if symbol == "end":
            found.append({})
        elif symbol in _KNOWN:
            found[-1][symbol] = found[-1].get(symbol, 0.0) + weight
    return [c for c in found if c], len(found), words


_KNOWN = frozenset(KINDS)
#: What a document's matched clauses weigh, the sign of each coefficient, and its prior.
FEATURES = {
    "insults": (1, 0.5),
    "aimed insults": (1, 0.5),
    "aimed threats": (1, 2.5),
    "negated": (-1, -0.5),
    "reported": (-1, -0.5),
    "strongest clause": (1, 0.0),
    "matched clauses": (1, 0.0),
    "weight a clause": (1, 0.0),
    "weight a hundred words": (1, 0.5),
}


def matches(text: str | None, lexicon: Lexicon, fst: Fst) -> np.ndarray:
    """The FEATURES of a text, on a logarithmic scale."""
    found, n, words = clauses(text, lexicon, fst)
    total = [sum(c.values()) for c in found]
    part = lambda test: sum(w for c in found for kind, w in c.items() if test(kind))
    insults, threats = part(lambda k: k[0] == "i"), part(lambda k: k[0] == "t")
    aimed = part(lambda k: k[0] == "i" and "+" in k)
    whole = insults + threats
    return np.log1p([insults, aimed, threats, part(lambda k: "-" in k), part(lambda k: "~" in k), max(total, default=0.0), len(found), whole / n, 100 * whole / max(words, 1)])


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    weights: np.ndarray
    bias: float


def _shingle_mark(words: list[str]) -> int:
    return min((crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))), default=0)


def _labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    own = labels.select("doc_id", F.col("toxic").alias("label")).dropna().filter(fold("doc_id", PARTS) != HELD_OUT)
    sample = bounded_sample(own, "doc_id", bound).groupBy("doc_id").agg(F.max("label").alias("label"))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by the sample

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_shingle_mark(TOKENS.findall(t.lower())) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(marks, pa.int64())], ["text", "label", "mark"])

    return found.select("text", "label").mapInArrow(mark, "text string, label int, mark long").groupBy("mark", "label").agg(F.min("text").alias("text"))


def _ratio(bad: float, good: float, share: float) -> float:
    """Likelihood ratio of counts against a share of bad ones."""
    n = bad + good
    return 2 * sum(k * np.log(k / (n * p)) for k, p in ((bad, share), (good, 1 - share)) if k)


def learn_insults(labelled: DataFrame) -> dict[str, float]:
    """Word beginnings and whole words (with $) whose documents are toxic far more often than others.

    The rows that meet the least ratio are as many as the sample's words at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in TOKENS.findall(text.lower()) if w not in ENDS]
                own: dict[str, int] = {}
                for w in words:
                    for term in (w + "$", *(w[:n] for n in PREFIXES if len(w) >= n)):
                        own[term] = own.get(term, 0) + 1
                own[""] = len(words)
                side = int(label > 0)
                for term, n in own.items():
                    sums = total.setdefault(term, [0, 0, 0, 0])
                    sums[side] += 1
                    sums[2 + side] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in range(4))], ["term", "clean", "toxic", "clean_uses", "toxic_uses"])

    terms = labelled.select("text", "label").mapInArrow(count, "term string, clean long, toxic long, clean_uses long, toxic_uses long")
    terms = written(terms.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "clean_uses", "toxic_uses")]))
    all_rows = terms.filter("term = ''").first()
    if not all_rows or not all_rows["toxic"] or not all_rows["clean"]:
        return {}
    t, c, share = F.col("toxic"), F.col("clean"), all_rows["toxic"] / (all_rows["toxic"] + all_rows["clean"])
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    ratio = 2 * (part(t, (t + c) * share) + part(c, (t + c) * (1 - share)))
    weight = F.log((F.col("toxic_uses") + 0.5) / (all_rows["toxic_uses"] + 1)) - F.log((F.col("clean_uses") + 0.5) / (all_rows["clean_uses"] + 1))
    rows = terms.select("term", "toxic", "clean", ratio.alias("ratio"), weight.alias("weight")).filter((F.col("term") != "") & (F.col("ratio") >= LEAST_RATIO) & (F.col("weight") >= LEAST_WEIGHT)).collect()
    discard(terms)
    kept: dict[str, tuple[float, int, int]] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        word = r["term"].rstrip("$")
        above = [kept[word[:k]] for k in PREFIXES if word[:k] != r["term"] and word[:k] in kept]
        if all(r["weight"] > w and _ratio(r["toxic"], r["clean"], b / (b + g)) >= LEAST_RATIO for w, b, g in above):
            kept[r["term"]] = r["weight"], r["toxic"], r["clean"]
    return {term: w for term, (w, _, _) in kept.items()}


def _logistic(x: np.ndarray, y: np.ndarray, signs: np.ndarray, prior: np.ndarray, ridge: float = 2.0, steps: int = 4000) -> np.ndarray:
    """Weights and bias (last), the weights of the given signs, by accelerated projected gradient steps."""
    x = np.column_stack([x, np.ones(len(x))])
    signs, centre, keep = np.r_[signs, 0], np.r_[prior, 0.0], np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    rate = 1 / (0.25 * np.linalg.eigvalsh(x.T @ x)[-1] + ridge)
    w = ahead = centre
    momentum = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (p - y) + keep * (ahead - centre))
        new = np.where(signs * new < 0, 0.0, new)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return w


def fit(docs: DataFrame, labels: DataFrame, bound: int = 8000) -> Model | None:
    """Learn lexicon and weights from at most about ``bound`` labelled rows; None if there are none."""
    labelled = written(_labelled(docs, labels, bound))
    insults = learn_insults(labelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, fst = Lexicon(insults), grammar()
        for batch in batches:
            found = [matches(t, lexicon, fst).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    rows = labelled.select("text", "label").mapInArrow(features, "label int, x array<double>").toArrow().to_pandas()
    if rows.empty:
        return None
    x = np.array(rows["x"].tolist())
    order = np.lexsort((*x.T, rows["label"]))  # the same sums whatever order the rows came in
    signs, prior = (np.array(v, float) for v in zip(*FEATURES.values()))
    w = _logistic(x[order], (rows["label"].to_numpy()[order] > 0).astype(float), signs, prior)
    return Model(insults, w[:-1], float(w[-1]))


def predict(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs (text and further columns, all kept) with the score by this name."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, fst = shared.value, grammar()
        lexicon = Lexicon(m.insults)
        for batch in batches:
            z = [float(matches(t, lexicon, fst) @ m.weights + m.bias) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -30, 30))))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    held_out = F.coalesce(fold("doc_id", PARTS) == HELD_OUT, F.lit(False))
    found = predict(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays under the threshold."""
    (name,) = free_names(docs.columns, "score")
    return predict(docs, fit(docs, labels), name).filter(F.col(name) < THRESHOLD).select(*docs.columns)
