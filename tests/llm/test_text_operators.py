import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rangeloom.llm import jaccard, langid, quality, toxicity
from rangeloom.llm.bpe import bpe_digest, encode_documents, load
from rangeloom.llm.grams import gram_counts, shape_terms
from rangeloom.llm.packing import best_fit, pack, pack_documents, swap_search

from helpers import docs, groups, words

public_tokenizers = pytest.importorskip("public_tokenizers")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello, World's 42nd day! It'LL do."), (5, "<|endoftext|>a<|startoftext|>"), (6, "İstanbul ΑΣ ﬁ é 日本語 😀\x1c\x85x"), (7, "a" * 5000 + " " + "é" * 300), (None, "no id"), (8, "same"), (8, "same"), (9, "… don’t — “quote” ½ ² 12345")]


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x180)] + list("ſKΣςЖ日ก​‍𝒜½Ⅷ") + ["<|endoftext|>", "'ll", "İ", "ing", "the"]
    rows = ODD + [(100 + k, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for k in range(400)]
    got = bpe_digest(docs(spark, rows)).collect()
    expected = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert bpe_digest(docs(spark, [])).count() == 0
    full = {r["doc_id"]: r for r in encode_documents(docs(spark, ODD[:5])).collect()}
    assert full[1]["ids"] == [] and full[4]["decoded"] == LIBRARY.decode(full[4]["ids"], skip_special_tokens=False)


def test_cuts_are_certain():
    bpe = load()
    symbols = [bpe.within[b] for b in "ab~zq".encode()]
    fragments = bpe.fragments(symbols)
    assert sum(fragments, []) == symbols
    for a, b in zip(fragments, fragments[1:]):
        assert a[-1] << 20 | b[0] not in bpe.inside


def test_packing(spark):
    rows = ODD + [(1000 + k, " ".join(words(k, 1 + 37 * k % 900))) for k in range(150)] + [(5000, "x y z " * 3000)]
    out = pack_documents(docs(spark, rows), length=512, shard=60).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 512).all()
    places = out.sort_values(["sequence_id", "offset"])
    assert (places.groupby("sequence_id").length.cumsum() - places.length == places.offset).all()
    by_id = dict(rows[-60:])
    for i in list(by_id)[::7]:
        ids = np.array([*LIBRARY.encode(by_id[i], add_special_tokens=False).ids, 1], "<u4")
        own = out[out.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[:-1] == 512).all() and list(own.start) == list(range(0, len(ids), 512))
        assert list(own.ids_crc32) == [zlib.crc32(ids[k : k + 512].tobytes()) for k in range(0, len(ids), 512)]
    assert len(out[out.doc_id == 8]) == 2 and out.doc_id.isna().sum() == 1
    assert out.sequence_id.nunique() <= 1.01 * out.length.sum() / 512 + 1
    assert pack_documents(docs(spark, [])).count() == 0


def test_swap_search_empties_bins():
    sizes = np.array([60, 55, 45, 42, 40, 39, 38, 36, 35, 10])
    before = [[0], [1], [2, 3], [4, 5], [6, 7], [8, 9]]
    after = swap_search([list(b) for b in before], sizes, 100)
    assert sorted(sum(after, [])) == list(range(10)) and all(sizes[b].sum() <= 100 for b in after) and len(after) < len(before)
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 100, 60))[::-1]
        bins = pack(sizes, 100)
        assert sorted(sum(bins, [])) == list(range(60)) and all(sizes[b].sum() <= 100 for b in bins) and len(bins) <= len(best_fit(sizes, 100))


TEXTS = {"xx": ["lorem ipsum dolor", "dolor sit amet ipsum", "ipsum lorem amet"], "yy": ["kwak zwik brrn", "brrn kwak tokk", "zwik tokk kwak"], "zz": ["óñá éíú ñañá", "ñañá óñá úíé", "éíú úíé óñá"]}


def test_language(spark):
    rows = [(k, " ".join(random.Random(k).choices(TEXTS[lang], k=6)), lang) for k in range(120) for lang in [list(TEXTS)[k % 3]]]
    rows += [(500, None, "xx"), (501, "12 34 !!", None), (502, "", None), (503, "kwak zwik tokk " * 4000, None), (None, "lorem ipsum", "xx")]
    df = docs(spark, rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert [out[k]["lang_pred"] for k in (500, 501, 502, 503)] == ["und", "und", "und", "yy"] and out[500]["score"] == 0
    assert all(out[k]["lang_pred"] == lang for k, _, lang in rows[:120])
    assert out[7]["held_out"] == (zlib.crc32(b"7") % 4 == 2) and out[None]["held_out"] is False
    clash = df.selectExpr("*", "'own' AS lang_pred", "7 AS score")
    kept = langid.keep_identified(clash)
    assert kept.columns == clash.columns and kept.count() == len(rows) - 3 and {r["lang_pred"] for r in kept.collect()} == {"own"}
    assert langid.identify(df.limit(0)).count() == 0
    unlearned = langid.identify(df.selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}


def test_codewords():
    for k in (1, 2, 3, 5, 9, 20):
        code = langid.codewords(k)
        assert len(code) == k and (k == 1 or min(int((code[a] != code[b]).sum()) for a in range(k) for b in range(a)) >= 1)


def _labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(400):
        own = words(k, 60, 4000)
        bad = k % 4 == 0
        if bad:
            for at in rng.sample(range(60), 4):
                own[at] = rng.choice(["blorkface", "snargle" + rng.choice(["a", "o", "ix"]), "grumph"])
        rows.append((k, " ".join(own).replace("we", "we.") + ".", 1))
        labels.append((k, 0 if k % 5 == 0 else 1, int(bad)))
    rows += [(900, None, 1), (901, "", 1), (902, "you snargleix. " * 2000, 1), (None, "blorkface", 1)]
    labels += [(None, 1, 1), (901, None, None), (3, 1, 0), (7777, 1, 1)]
    return docs(spark, rows, "doc_id long, text string, score int"), docs(spark, labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    df, labels = _labelled(spark)
    out = {r["doc_id"]: r for r in toxicity.classify(df, labels).collect()}
    assert all(out[k]["predicted"] == int(k % 4 == 0) for k in range(400))
    assert out[902]["predicted"] == 1 and out[None]["predicted"] in (0, 1) and out[900]["predicted"] == out[901]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[10]["held_out"] == (zlib.crc32(b"10") % 4 == 2)
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and {r["score"] for r in kept.collect()} == {1}
    assert toxicity.classify(df.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.classify(df, labels.limit(0)).collect()} == {0.0}


def kinds_of(text, lexicon, fst):
    """The kinds of all matched clauses of a text."""
    return {kind for clause in toxicity.clauses(text, lexicon, fst)[0] for kind in clause}


def test_grammar():
    fst, lexicon = toxicity.grammar(), toxicity.Lexicon({"fool$": 2.0, "clod": 1.0})
    at = lambda text: kinds_of(text, lexicon, fst)
    assert at("What a fool") == {"insult"} and at("you fool") == {"insult+"} and at("cloddish") == {"insult"}
    assert at("he is not a fool. clod") == {"insult-+", "insult"}
    assert at("she said you fool") == {"insult~+"} and at("stones were said: fool") == {"insult"}
    assert at("I will kill you") == at("you I will kill") == {"threat+"} and at("fools") == set()


def test_grammar_equals_a_plain_matcher():
    """The composed transducer against sets of a clause's symbols, over random symbols."""
    rng, fst = random.Random(6), toxicity.grammar()
    for _ in range(300):
        symbols = rng.choices(["insult", "threat", "target", "negation", "reported", "end"], weights=[3, 3, 1, 1, 1, 2], k=rng.randint(0, 25))
        expected, at = [], 0
        for clause in " ".join(symbols).split("end"):
            own = clause.split()
            marks = "".join(m for m, s in (("-", "negation"), ("~", "reported"), ("+", "target")) if s in own)
            expected += [s + marks if s in ("insult", "threat") else s for s in own] + ["end"]
        assert toxicity.both_ways(symbols, fst) == expected[:-1]


def test_marks_move_the_score_one_way(spark):
    df, labels = _labelled(spark)
    model = toxicity.fit(df, labels)
    signs = np.array([s for s, _ in toxicity.FEATURES.values()])
    assert (signs * model.weights >= 0).all()
    rows = [(1, "he is a grumph"), (2, "he is not a grumph"), (3, "she said he is a grumph"), (4, "a grumph"), (5, "I will kill you"), (6, "I will not kill you"), (7, "a calm day")]
    score = {r["doc_id"]: r["score"] for r in toxicity.predict(docs(spark, rows), model).collect()}
    assert score[1] > score[4] and score[1] > score[2] and score[1] > score[3] and score[5] > score[6] > score[7]
    again = toxicity.predict(docs(spark, [(1, rows[0][1]), (1, rows[0][1]), (9, "he is a grumph")]), model).collect()
    assert len(again) == 3 and {r["score"] for r in again} == {score[1]}


def test_quality(spark):
    df, labels = _labelled(spark)
    rows = [(k, (t or "").upper() + "!!!" if k is not None and k % 5 == 0 and k < 400 else t) for k, t, _ in df.collect()]
    out = {r["doc_id"]: r for r in quality.classify(docs(spark, rows), labels).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([out[k]["predicted"] == int(k % 5 != 0) for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[held[0]]["held_out"]
    assert quality.classify(docs(spark, []), labels).count() == 0
    assert {r["score"] for r in quality.classify(docs(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_grams():
    assert gram_counts("ab", (1, 2), 12, True).sum() == 4 + 3 and gram_counts("", (1, 2, 3), 12, False).sum() == 3
    assert (gram_counts("AB!", (1, 2), 12, True) == gram_counts("ab?", (1, 2), 12, True)).all()
    assert shape_terms("").sum() == shape_terms("x " * 9999).sum() == 9


def brute_jaccard(rows):
    ids, sets = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None:
            ids[i] = None
            s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
            sets.setdefault(i, set()).add(s)
    flat = [(i, s) for i, own in sets.items() for s in own if s]
    links = [(i, j) for a, (i, s) in enumerate(flat) for j, t in flat[:a] if 100 * len(s & t) >= 80 * len(s | t)]
    return groups(links, ids), {i: len(next(iter(s))) for i, s in sets.items()}


def test_jaccard(spark):
    rng = random.Random(8)
    rows = list(ODD)
    for base in range(12):
        own = words(base, [3, 5, 6, 9, 14, 30, 60, 120, 250, 500, 900, 40][base])
        for k in range(14):
            new = list(own)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                at = rng.randrange(len(new) + 1)
                new[at:at] = [f"n{rng.random()}"] if rng.random() < 0.4 else []
                if at < len(new) and rng.random() < 0.7:
                    new[at] = f"r{rng.random()}"
            rows.append((1000 + 20 * base + k, (" \n".join(new)).upper() if k % 3 == 0 else "\t".join(new)))
    rows += [(3000 + k, " ".join(words(99, 60) + words(k, 60 + k))) for k in range(30)]
    expected, sizes = brute_jaccard(rows)
    out = jaccard.jaccard_components(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["component_id"], r["n_shingles"]) == (expected[r["doc_id"]], sizes[r["doc_id"]]), r
    kept = jaccard.keep_first(docs(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, n int")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({i for i in expected.values()}) and len(kept) == len(set(expected.values())) + 1
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def near_copies(seed, length, n, changes):
    rng, own = random.Random(seed), words(seed, length, 10**6)
    out = []
    for k in range(n):
        new = list(own)
        for at in rng.sample(range(length), changes):
            new[at] = f"r{seed}x{k}x{at}"
        out.append(" ".join(new))
    return out


@pytest.mark.parametrize("hot,part,block", [(256, 2048, 256), (4, 6, 5)])
def test_jaccard_of_groups_and_repeated_ids(spark, monkeypatch, hot, part, block):
    """Large groups of near copies, a group just under the threshold, and ids with several texts; small parts force every route."""
    for name, value in (("HOT", hot), ("PART", part), ("BLOCK", block), ("DENSE", 1 if part < 100 else 64), ("FLUSH", 3000), ("UNIT", 2000)):
        monkeypatch.setattr(jaccard, name, value)
    rows = [(k, t) for k, t in enumerate(near_copies(1, 100, 40, 1) + near_copies(2, 100, 30, 2) + near_copies(3, 60, 25, 3))]
    rows += [(500 + k, "\n".join([near_copies(4, 40, 1, 0)[0], " ".join(words(900 + k, 90, 10**6))])) for k in range(30)]
    a, b, c = (" ".join(words(70 + k, 30, 10**6)) for k in range(3))
    rows += [(603, a), (605, a), (605, b), (607, b), (609, ""), (609, c), (601, c), (605, a), (610, "  ")]
    expected, _ = brute_jaccard(rows)
    clash = docs(spark, [(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, component_id string")
    out = jaccard.jaccard_components(clash).collect()
    assert len(out) == len(rows) and all(r["component_id"] == expected[r["doc_id"]] for r in out)
    assert expected[607] == 603 and expected[609] == 601
    kept = jaccard.keep_first(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_lists_are_covered():
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.choice(60, rng.integers(2, 12), replace=False)) for _ in range(200)]
    groups_found = [set(g.tolist()) for g in jaccard.gathered_lists(lists, 20)]
    assert all(any(set(x.tolist()) <= g for g in groups_found) for x in lists) and all(len(g) <= 20 for g in groups_found)


def test_pigeonhole_never_misses():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 7, 9, 12, 20, 33, 80, 300, 1500]:
        for _ in range(40):
            common = rng.integers(0, 1 << 63, n, dtype="uint64")
            a = np.unique(np.r_[common, rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1), dtype="uint64")])
            b = np.unique(np.r_[common, rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1), dtype="uint64")])
            if jaccard.linked(a, b):
                assert len(np.intersect1d(jaccard.entries(a), jaccard.entries(b)))
                x, y = (np.unpackbits(np.frombuffer(jaccard.parity(s), "uint8")) for s in (a, b))
                assert (x != y).sum() <= len(np.setxor1d(a, b))
