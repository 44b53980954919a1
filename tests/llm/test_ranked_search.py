import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortsmith.llm import ranked_search


def terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    joined = {}
    for item, text in items:
        joined.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in joined.items():
        ranking = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                for w, r in wanted.items() if w in c
            )
            if score > 0:
                ranking.append((-score, i is None, i))
        ranking.sort(key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(ranking[:top], 1)]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def check(spark, docs, items, **how):
    got = ranked_search.rank(
        spark.createDataFrame([(*d, "x", 1) for d in docs],
                              "doc_id long, text string, term string, rank int").repartition(3),
        spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, text string, n double"),
        **how,
    )
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    found = sorted((tuple(r) for r in got.collect()),
                   key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == brute(docs, items, **how)
    return found


def collection(seed, n_docs, vocabulary):
    chance = random.Random(seed)
    names = [f"w{k}" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    docs = [(i, " ".join(chance.choices(names, weights, k=chance.randrange(1, 60))))
            for i in range(n_docs)]
    items = [(i, " ".join(chance.choices(names, k=chance.randrange(1, 30)))) for i in range(12)]
    return docs, items


def test_rankings_equal_brute_force(spark):
    docs, items = collection(1, 400, 80)
    assert check(spark, docs, items)
    check(spark, docs, items, top=3)


def test_more_than_64_terms_and_several_blocks(spark, monkeypatch):
    docs, items = collection(2, 200, 300)
    items.append((99, " ".join(f"w{k}" for k in range(200))))
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 50)
    check(spark, docs, items)


def test_ties_copies_and_odd_rows(spark):
    docs = [
        (5, "Alpha beta"), (3, "ALPHA-beta!"), (None, "alpha beta"), (3, "alpha beta"),
        (7, None), (8, ""), (9, " ?! "), (10, "gamma " * 50_000 + "alpha"), (11, "éa É9"),
        *[(k, "beta beta gamma") for k in range(20, 60)],
    ]
    items = [(1, "alpha beta"), (2, None), (3, ""), (4, "nowhere"), (None, "gamma É9"),
             (5, "beta"), (5, "beta alpha"), (6, "beta"), (6, "beta")]
    found = check(spark, docs, items)
    assert [r[2] for r in found if r[0] == 1][:4] == [3, 3, 5, None]


@pytest.mark.parametrize("n_docs, n_items", [(0, 3), (30, 0), (0, 0)])
def test_empty_tables(spark, n_docs, n_items):
    docs, items = collection(3, 30, 10)
    assert check(spark, docs[:n_docs], items[:n_items]) == brute(docs[:n_docs], items[:n_items])


def test_masks_are_finished_early(monkeypatch):
    """Few documents are scored, and the ranking is still the one of all documents."""
    import pyarrow as pa
    n, weights = 5000, np.array([5000, 30], np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([10] * n),
         pa.array([[0, 1] if i % 50 == 0 else [1] for i in range(n)], pa.list_(pa.int32())),
         pa.array([[1, 1] if i % 50 == 0 else [1] for i in range(n)], pa.list_(pa.int32()))],
        names=["id", "n", "term", "tf"],
    )
    some = ranked_search.Batch(batch, weights, n, 10 * n)
    scored = []
    real = ranked_search.Batch.scores
    monkeypatch.setattr(ranked_search.Batch, "scores",
                        lambda self, docs, value: scored.append(len(docs)) or real(self, docs, value))
    best = ranked_search.best_of(some, np.array([0, 1]), np.ones(2, np.int64), weights, 20, [])
    assert [b[2] for b in best] == list(range(0, 1000, 50))
    assert sum(scored) == 100
