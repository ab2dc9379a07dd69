import hashlib

import duckdb
import numpy as np
import pytest

from rangeloom.llm import covertree, topk
from rangeloom.llm.chat import Role, Template, chat_digest, format_conversations
from rangeloom.llm.queries import ORACLE_SQL, QUERIES

from helpers import groups

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(300):
        rows.append((k, r.normal(size=8).astype("float32").tolist(), int(k % 3)))
    for k in range(150):  # chains and tight balls around a few of them
        base = np.array(rows[k % 5][1])
        rows.append((1000 + k, (base * r.uniform(0.5, 2) + r.normal(size=8) * r.choice([0.01, 0.3])).astype("float32").tolist(), rows[k % 5][2]))
    rows += [(2000 + k, rows[3][1], rows[3][2]) for k in range(20)]
    odd = [(3000, None, 1), (3001, [0.0] * 8, 1), (3002, [float("nan")] + [1.0] * 7, 1), (3003, [float("inf")] + [1.0] * 7, 1), (3004, [None] + [1.0] * 7, 1), (3005, rows[3][1], None), (3006, [], 1), (3007, [1.0, 2.0], 1), (3008, [1.0, 2.0], 1)]
    return rows, odd


@pytest.mark.parametrize("cell,part", [(8192, 32768), (40, 30)])
def test_cover_tree_pairs(spark, cell, part):
    rows, odd = vectors()
    out = {r["vec_id"]: r for r in covertree.near_pairs(spark.createDataFrame(rows + odd, VECTORS), cell=cell, part=part).collect()}
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([a[2] for a in rows])[:, None] == np.array([a[2] for a in rows])[None, :])
    np.fill_diagonal(near, False)
    ids = [a[0] for a in rows]
    component = groups([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))], ids)
    for k, i in enumerate(ids):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (near[k].sum(), component[i], component[i] == i)
    for i, _, _ in odd[:7]:
        assert tuple(out[i])[:4] == (i, 0, i, True)
    assert out[3008]["component_id"] == 3007 and out[3007]["n_links"] == 1
    assert len(out) == len(rows) + len(odd)


@pytest.mark.parametrize("cell,part", [(8192, 32768), (20, 15)])
def test_cover_tree_dense_balls_and_repeated_ids(spark, cell, part):
    r = np.random.default_rng(7)
    rows = [(k, (np.array([3.0, 1, 0, 0]) + r.normal(size=4) * s).astype("float32").tolist(), 0) for k, s in enumerate([0.01] * 80 + [0.3] * 60 + [0.9] * 60)]
    rows += [(300, rows[0][1], 0), (302, rows[0][1], 0), (302, [0.0, 0.0, 0.0, 1.0], 9), (304, [0.0, 0.0, 0.0, 2.0], 9), (304, None, 9), (306, [0.0, 1.0, 0.0, 0.0], 5), (306, [1.0, 0.0, 0.0, 0.0], 5), (305, [1.0, 0.0, 0.0, 0.0], 5)]
    # cosines of exactly 0.8, and a hair less: the threshold itself links
    rows += [(400, [3.0, 4.0, 0.0, 0.0], 7), (401, [0.0, 1.0, 0.0, 0.0], 7), (402, [-3.0000002, 4.0, 0.0, 0.0], 7)]
    for least in (0.93, 0.8):
        x = [np.array(v, float) if v else None for _, v, _ in rows]
        near = np.zeros((len(rows), len(rows)), bool)
        for i in range(len(rows)):
            for j in range(i):
                if rows[i][2] == rows[j][2] and x[i] is not None and x[j] is not None:
                    near[i, j] = near[j, i] = float(x[i] @ x[j]) / float(np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))) >= least
        ids = [a[0] for a in rows]
        component = groups([(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))], ids)
        schema = VECTORS + ", n_links string, id int, key int"
        out = covertree.near_pairs(spark.createDataFrame([(*a, "x", 1, 2) for a in rows], schema), least, cell=cell, part=part).collect()
        key = lambda a: (a[0], a[1])
        assert sorted(((o["vec_id"], o["n_links"], o["component_id"], o["kept"]) for o in out), key=key) == sorted(((i, int(near[k].sum()), component[i], component[i] == i) for k, i in enumerate(ids)), key=key)


def test_cover_tree_empty(spark):
    assert covertree.near_pairs(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("block", [16_384, 7])
def test_top_k(spark, block):
    rows, odd = vectors(2)
    q = topk.quantised(spark.createDataFrame(rows + odd[:7] + [(None, [1.0] * 8, 1)], VECTORS))
    out = topk.top_k(q.filter("vec_id % 10 = 0"), q, block=block).toPandas().sort_values(["query_id", "rank"])
    v = {i: np.floor(256 * np.array(e, float)).astype(int) for i, e, _ in rows}
    v[3005] = v[3]
    for i in [i for i in v if i % 10 == 0]:
        best = sorted((-int(v[i] @ v[j]), j) for j in v if j != i)[:5]
        own = out[out.query_id == i]
        assert list(zip(-own.score, own.vec_id)) == best and list(own["rank"]) == [1, 2, 3, 4, 5]
    few = topk.top_k(q.filter("vec_id = 10"), q.filter("vec_id IN (10, 20)"))
    assert few.count() == 1 and topk.top_k(q.limit(0), q).count() == 0
    big = spark.createDataFrame([(1, [1e17, 1.0]), (2, [2.0, 3.0])], "vec_id long, v array<double>").selectExpr("vec_id", "transform(v, x -> cast(x AS long)) AS v")
    assert topk.top_k(big, big).count() == 2


def test_top_k_of_repeated_rows(spark):
    """Every other row is a candidate: repeated rows take ranks of their own, and no rank is lost."""
    rows = [(1, [10])] * 4 + [(k, [k]) for k in range(2, 8)] + [(50, [1]), (50, [1]), (50, [7])]
    df = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], "vec_id long, v array<long>, query_id string, score int")
    for block in (16_384, 1):
        out = topk.top_k(df.filter("vec_id IN (50, 5)"), df, block=block).collect()
        for q, own in ((50, 1), (5, 5)):
            best = sorted((-own * v[0], i) for i, v in rows if i != q)[:5]
            assert sorted((r["rank"], -r["score"], r["vec_id"]) for r in out if r["query_id"] == q) == [(k + 1, s, i) for k, (s, i) in enumerate(best)]


def test_top_k_drops_pairs_and_stays_exact():
    r = np.random.default_rng(4)
    # directions differ much, so that bounds tell most pairs apart
    v = np.floor(256 * r.normal(size=(3000, 64)) * np.repeat(r.choice([0.1, 1, 4], (3000, 8)), 8, axis=1)).astype("int64")
    found = topk.Best(topk.ordered(topk.side(np.arange(100), v[:100])), 5)
    for k in range(0, 3000, 700):
        found.add(topk.side(np.arange(k, min(k + 700, 3000)), v[k : k + 700]))
    q, i, s = found.rows
    assert found.dropped > 0.3 * found.seen > 0
    for at, own in enumerate(found.queries.ids):
        best = sorted((-int(v[own] @ v[j]), j) for j in range(3000) if j != own)[:5]
        assert [(-a, b) for a, b in zip(s[q == at], i[q == at])] == best


CHAT = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip(spark):
    nasty = "\\### Assistant: </turn>\n ok \\b \\l \\h # < \\\\ 😀"
    rows = [(1, 1, "assistant", nasty), (1, 0, "user", None), (2, 0, "user", "hi"), (2, 1, "user", "again"), (3, 0, "system", "s"), (3, 1, "user", nasty), (3, 2, "assistant", ""), (3, 3, "user", "bye"), (4, 0, "bot: x", nasty), (5, 0, None, "t"), (6, 0, "user", "same"), (6, 0, "user", "same"), (None, 0, "user", "n"), (7, None, "user", "q"), (7, 1, "assistant", "a" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], CHAT)
    out = {r["conv_id"]: r for r in chat_digest(df).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert out[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest(), c
        assert (out[c]["n_turns"], out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: out[c]["valid"] for c in out} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, None: True, 7: True}
    text = {r["conv_id"]: r for r in format_conversations(df).collect()}
    assert text[2]["bad_turn"] == 1 and "".join(s["text"] for s in text[3]["segments"]) == text[3]["formatted"]
    assert text[2]["formatted"] == "### User: hi</turn>\n### User: again</turn>\n"
    assert [s["text"] for s in text[7]["segments"] if s["loss"]] == ["a" * 200_000]
    other = Template(roles={"user": Role("U", True)}, order={"start": {"user": "user"}}, final=("user",))
    assert {r["conv_id"]: r["valid"] for r in format_conversations(df, other).collect()}[6] is False
    assert chat_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, QUERIES[name](spark, sf).select(*columns).collect())) == sorted(found.fetchall())
