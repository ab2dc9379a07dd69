import random

import corpus_pipeline
from rangeloom.llm.bpe import load

from helpers import DOCS, words
from test_text_operators import brute_jaccard


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        own = words(k, 50, 5000)
        if k % 4 == 0:
            for at in rng.sample(range(50), 4):
                own[at] = rng.choice(["blorkface", "grumphly", "snarglish"])
        rows.append((k, " ".join(own), "en" if k % 2 else "fr", "s", 1))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(300, rows[1][1], "en", "s", 1), (301, rows[1][1] + " more", "en", "s", 1), (302, "123 !!", None, "s", 1), (303, None, None, "s", 1), (304, rows[5][1], "en", "s", 1), (304, rows[5][1], "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {name: stage for name, stage in corpus_pipeline.STAGES}
    one = kept["language"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {r[0] for r in rows} - {r["doc_id"] for r in one.collect()} == {302, 303}
    two = kept["toxicity"](spark, one, str(tmp_path))
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == {r[0] for r in rows if r[0] not in (302, 303) and (r[0] >= 300 or r[0] % 4)}
    three = kept["near_duplicates"](spark, two, str(tmp_path))
    left = [(r["doc_id"], r["text"]) for r in two.collect()]
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(brute_jaccard(left)[0].values())) and three.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    texts, bpe = dict(left), load()
    expected = {r["doc_id"]: len(bpe.encode(texts[r["doc_id"]])) // 4 + 1 for r in three.collect()}
    assert out.groupby("doc_id").length.sum().to_dict() == expected and (out.groupby("sequence_id").length.sum() <= 4096).all()
    assert corpus_pipeline.ORACLE_SQL is None
