import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import simhash
from cohortsmith.llm.components import components

SCHEMA = "doc_id long, text string, fp string, label string"


def closed(nodes, near):
    """Smallest node reachable, by brute force."""
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components(spark):
    chance = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)]
    links += [(chance.randrange(40), chance.randrange(40)) for _ in range(25)]
    links += links[:5] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(links, "u long, v long")).collect()}
    pairs = {frozenset(x) for x in links}
    want = closed({n for x in links for n in x}, lambda a, b: frozenset((a, b)) in pairs)
    assert {n: want[n] for n in got} == got
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_fingerprint_equals_sql_hash(spark):
    text = "The quick brown fox jumps OVER the lazy dog É again and again"
    words = text.replace("T", "t").replace("OVER", "over").split()
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [r[0] % 2**64 for r in spark.createDataFrame(
        [(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("groups", [range(2, 3), range(3, 4), range(4, 5), range(5, 6)])
def test_links_equal_all_pairs(spark, groups, monkeypatch):
    monkeypatch.setattr(simhash, "GROUPS", groups)
    chance = random.Random(len(groups) + groups[0])
    fps = {0, 1, 3}
    for _ in range(25):
        base = chance.getrandbits(64)
        fps.add(base)
        for _ in range(chance.randrange(12)):
            base ^= sum(1 << b for b in chance.sample(range(64), chance.randrange(1, 6)))
            fps.add(base)
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    got = {r["fp"]: r["label"] for r in simhash.link_fingerprints(
        spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = closed(signed, lambda a, b: bin((a ^ b) % 2**64).count("1") <= 4)
    families = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert families(got) == families(want)


def test_rows(spark):
    docs = spark.createDataFrame(
        [(5, "a b c d e f", "", ""), (3, "A B c d e f", "", ""), (9, None, "", ""),
         (8, "", "", ""), (None, "", "", ""), (7, "w " * 100_000, "", ""), (3, "other", "", "")],
        SCHEMA,
    )
    got = simhash.near_copies(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got.collect()}
    assert by[5, next(f for i, f in by if i == 5)] == 3
    assert by[9, "0" * 16] == by[8, "0" * 16] == by[None, "0" * 16] == 8
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 3, 7, 8]
    assert simhash.near_copies(docs.limit(0)).collect() == []


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame(
        [(i, f"text {i % 3} of some words", "a", "b", 1) for i in range(9)],
        "doc_id long, text string, gone string, Gone_ string, fp int")
    kept = simhash.drop_near_copies(docs, distance=0)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]


def test_links_that_are_stars_take_no_round(spark, rows, monkeypatch):
    from cohortsmith.llm import components as linked

    written = []
    real = linked.materialize
    monkeypatch.setattr(
        linked, "materialize", lambda df, label: written.append(label) or real(df, label)
    )
    stars = spark.createDataFrame([(5, 1), (1, 6), (9, 2), (9, 2), (3, 3)], "u long, v long")
    assert rows(linked.components(stars)) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]
    assert len(written) == 1
    path = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 30), (40, 35)],
                                 "u long, v long")
    found = {k: 0 for k in range(21)} | {k: 30 for k in (30, 35, 40)}
    assert rows(linked.components(path)) == sorted(found.items())
