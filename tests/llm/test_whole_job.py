"""Tests of what a review found cut short: each fails on the code before its change."""

from collections import Counter

import numpy as np
import pytest

from rangeloom.llm import langid, lmscore, topk, toxicity
from rangeloom.llm.bpe import load

from helpers import docs, words

pytest.importorskip("public_tokenizers")


def test_bigrams_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK", 500)  # many chunks, so that sums meet from several
    rows = [(1, None), (2, ""), (None, "no id"), (8, "same"), (8, "same")] + [(100 + k, " ".join(words(k, 150, 60 if k % 2 else 6000))) for k in range(120)]
    marks = docs(spark, [(100 + k, k % 2) for k in range(120)] + [(None, 1), (101, 0), (8, None)], "doc_id long, target int")
    out = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs(spark, rows), marks).collect()}
    bpe = load()
    size, start = len(bpe.text_of), bpe.special["<|startoftext|>"]
    ids = [(i, np.frombuffer(bpe.encode(t), "uint32").tolist()) for i, t in rows]
    single, pair = (Counter(), Counter()), (Counter(), Counter())
    for i, a in ids:
        for k in (0, 1) if i is not None and i >= 100 and i % 2 else (1,):
            single[k].update([start, *a] if a else [])
            pair[k].update(zip([start, *a], a))

    def loss(k, a):
        n = sum(single[k].values())
        own = lambda x: (single[k][x] + lmscore.FLOOR) / (n + lmscore.FLOOR * size)
        return np.mean([-np.log((pair[k][b, x] + lmscore.PRIOR * own(x)) / (single[k][b] + lmscore.PRIOR)) for b, x in zip([start, *a], a)])

    assert len(out) == 124 and out[1]["n_tokens"] == out[2]["n_tokens"] == 0 and out[1]["score"] == 0
    for i, a in ids:
        if a:
            assert out[i]["n_tokens"] == len(a)
            assert (out[i]["target_loss"], out[i]["background_loss"]) == pytest.approx((loss(0, a), loss(1, a)), abs=1e-9)
            assert out[i]["target_loss"] > 0 and out[i]["background_loss"] > 0
    assert lmscore.cross_entropy_difference(docs(spark, []), marks).count() == 0


def test_clauses_are_marked_from_both_sides(spark):
    fst, lexicon = toxicity.grammar(), toxicity.Lexicon({"fool$": 2.0, "clod": 1.0})
    at = lambda text: {kind for clause in toxicity.clauses(text, lexicon, fst)[0] for kind in clause}
    assert at("I will kill you") == {"threat+"} and at("Killing you. He kills") == {"threat+"}
    assert at("ich töte dich nicht") == {"threat-+"} and at("te matarán a ellos") == {"threat+"}
    assert at("a fool you are") == {"insult+"} and at("fool, she said") == {"insult~+"} and at("you. fool. you") == {"insult"}
    assert at("I will kill") == set() and at("I will kill. you") == set()
    # two insults in a clause are one matched clause with the weight of both
    one, two = (toxicity.clauses(t, lexicon, fst) for t in ("fool clod", "fool. clod"))
    assert one == ([{"insult": 3.0}], 1, 2) and two == ([{"insult": 2.0}, {"insult": 1.0}], 2, 3)

    rows, labels = [], []
    for k in range(300):
        bad = k % 3 == 0
        own = words(k, 40, 4000)
        rows.append((k, " ".join(own[:20]) + (". I will kill you. " if bad else ". I will kill. You will see. ") + " ".join(own[20:])))
        labels.append((k, int(bad)))
    out = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs(spark, rows), docs(spark, labels, "doc_id long, toxic int")).collect()}
    assert all(out[k] == int(k % 3 == 0) for k in range(300))


def test_nothing_learned_rejects_no_text(spark):
    rows = [(1, "some words here", None), (2, "andere Worte", None), (3, "12 34 !!", None), (4, "", None), (5, None, None)]
    df = docs(spark, rows, "doc_id long, text string, lang string")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {1, 2}
    assert {r["doc_id"]: (r["lang_pred"], r["ambiguous"]) for r in langid.identify(df).collect()} == {k: ("und", k < 3) for k in range(1, 6)}


def test_top_k_of_strongly_negative_scores(spark):
    # all bounds are tight and all scores equal; the smallest ids come last, in a second tile
    n = topk.CANDIDATE_TILE + 1000
    candidates = spark.createDataFrame([(k, [-1024] * 16) for k in range(n, 0, -1)], "vec_id long, v array<long>").coalesce(1)
    queries = spark.createDataFrame([(0, [256] * 16)], "vec_id long, v array<long>")
    out = topk.top_k(queries, candidates).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(k, -4194304) for k in range(1, 6)]
