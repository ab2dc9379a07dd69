import numpy as np

#: Words of letters only, so that every operator sees different words.
LETTERS = str.maketrans("0123456789", "aeioubdgkm")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    return [f"w{k}".translate(LETTERS) for k in r.integers(0, vocabulary, n)]


def groups(links, ids):
    """The smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
