import hashlib
import math
import random

import numpy as np
import pytest

from cohortsmith.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(
        x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], None
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in kept]
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in vectors] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def near(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(v, books[p])[1] for v in cut[p]]
            moved = []
            for k, old in enumerate(books[p]):
                own = [v for v, o in zip(cut[p], of) if o == k]
                moved.append([sum(c) // len(own) for c in zip(*own)] if own else old)
            books[p] = moved
    out = []
    for i, r in enumerate(kept):
        found = [near(cut[p][i], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]))
    totals = {}
    for row in out:
        totals[row[3]] = totals.get(row[3], 0) + row[2]
    sha = hashlib.sha256(
        ",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, totals[label], sha) for i, c, e, label in out), sha


def check(spark, rows, **how):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = vector_codes.compress(table, **how)
    found = sorted((str(r[0]), *r[1:]) for r in map(tuple, got.collect()))
    assert found == brute(rows, **how)[0]
    return got


def vectors(seed, n, dim, spread=0.3):
    chance = random.Random(seed)
    return [(i, [float(np.float32(chance.gauss(0, spread))) for _ in range(dim)], i % 3)
            for i in range(n)]


def test_codes_equal_brute_force(spark):
    check(spark, vectors(1, 300, 16), entries=20)
    check(spark, vectors(2, 120, 28), entries=9, rounds=2)  # parts of 7, padded to 8
    got = check(spark, vectors(3, 60, 4))  # parts of one component, fewer rows than entries
    assert [f.dataType.simpleString() for f in got.schema] == [
        "bigint", "string", "bigint", "bigint", "string"]


def test_ties_repeated_and_odd_rows(spark):
    same = [0.5, -0.25, 0.125, 1.0, 0.0, 0.0, 2.0, -2.0]
    rows = [(k, same, None if k % 2 else 1) for k in range(12)]
    rows += [(3, [0.0] * 8, 1), (3, [0.0] * 8, 1), (None, [1.0] * 8, None),
             (50, None, 1), (51, [None, *same[1:]], 1), (52, [float("nan"), *same[1:]], 1),
             (53, [float("inf"), *same[1:]], 2), (54, [-float("inf")] * 8, 2),
             (55, [1e6] * 8, 2), (56, [-1e6, 3.0, *same[2:]], None)]
    check(spark, rows, entries=5)
    check(spark, rows, entries=3, rounds=0)


def test_large_components_are_exact(spark):
    check(spark, [(i, [i * 1e5 + d for d in range(8)], 0) for i in range(15)], entries=4)


def test_empty_and_short_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress(empty).collect() == []
    useless = spark.createDataFrame([(1, None, 1, "", 0)], SCHEMA)
    assert vector_codes.compress(useless).collect() == []
    short = spark.createDataFrame(
        [(1, [], 0, "", 0), (2, [1.0], 0, "", 0), (3, [1.0, 0.0, 0.0, 0.0, 2.0], 0, "", 0)], SCHEMA)
    got = vector_codes.compress(short).orderBy("vec_id").collect()
    assert [(r["code"], r["error"]) for r in got] == [
        ("00000000", 0), ("01000000", 0), ("01000200", 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(short, entries=300)


def test_transform_keeps_distances_and_orders_by_sequency():
    rows = np.arange(30, dtype=np.int64).reshape(3, 10) ** 2 % 17
    found = vector_codes.transform(rows)
    assert found.shape == (3, 16)
    assert ((found[0] - found[1]) ** 2).sum() == 16 * ((rows[0] - rows[1]) ** 2).sum()
    order = vector_codes._sequency(8)
    matrix = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    changes = [(np.diff(matrix[i]) != 0).sum() for i in order]
    assert changes == list(range(8))
