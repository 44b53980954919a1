import random

import pytest

from cohortsmith.llm import bwt, suffix_dedup

SCHEMA = "doc_id long, text string, key string, id string"


def by_hand(docs, length=50):
    """(n_bytes, n_removed, n_spans, kept) per row; NULL ids last."""
    last = float("inf")
    rank = [last if i is None else i for i, _ in docs]
    texts = [(t or "").encode() for _, t in docs]
    first = {}
    for i, t in zip(rank, texts):
        for j in range(len(t) - length + 1):
            w = t[j : j + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in zip(rank, texts):
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if first[t[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        out.append((
            len(t), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)),
            bytes(c for c, g in zip(t, gone) if not g),
        ))
    return out


def key(row):
    return [(v is not None, v) for v in row]


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
@pytest.mark.parametrize("shard", [5, 20, 1000])
def test_merged_intervals_are_the_equal_windows(depth, shard):
    chance = random.Random(depth * 100 + shard)
    for alphabet in (b"ab", b"ab\x00\xff"):
        for _ in range(40):
            strings = [
                bytes(chance.choices(alphabet, k=chance.randrange(25)))
                for _ in range(chance.randrange(1, 14))
            ]
            got, want = {}, {}
            for owner, at, group in zip(*bwt.merge(strings, depth, shard)):
                got.setdefault(int(group), set()).add((int(owner), int(at)))
            for n, s in enumerate(strings):
                for j in range(len(s) - depth + 1):
                    want.setdefault(s[j : j + depth], set()).add((n, j))
            assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def corpus(seed):
    chance = random.Random(seed)
    passage = "".join(chance.choices("abcdé ", k=120))
    base = "".join(chance.choices("etaoin shrdlu", k=400))
    docs = [(None, None), (3, ""), (4, "x" * 49), (5, "x" * 50), (6, "x" * 200), (7, "x" * 120)]
    for i in range(10, 60):
        kind = i % 5
        if kind == 0:
            text = base
        elif kind == 1:
            at = chance.randrange(400)
            text = base[:at] + "Q" + base[at + 1 :]
        elif kind == 2:
            text = "".join(chance.choices("abc", k=30)) + passage + "".join(chance.choices("xyz", k=40))
        else:
            text = "".join(chance.choices("etaoin shrdlu\n", k=chance.randrange(300)))
        docs.append((i, text))
    docs += [(11, docs[7][1]), (11, base), (None, base), (None, passage)]
    return docs


@pytest.mark.parametrize("per_bucket, seen", [(20_000, 1 << 20), (3, 5)])
def test_equals_brute_force(spark, per_bucket, seen, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHORS_PER_RANGE", 200)
    monkeypatch.setattr(suffix_dedup, "SEEN", seen)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 2_000 if seen == 5 else 1 << 20)
    docs = corpus(per_bucket)
    frame = spark.createDataFrame([(i, t, "k", None) for i, t in docs], SCHEMA).repartition(3)
    got = suffix_dedup.remove_repeats(frame, per_bucket=per_bucket)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text"]
    found = sorted(
        [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()], key=key
    )
    expected = [(i, *rest) for (i, _), rest in zip(docs, by_hand(docs))]
    assert found == sorted(expected, key=key)


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).collect() == []
    chance = random.Random(1)
    long = "".join(chance.choices("abcdefgh ", k=2_500_000))
    frame = spark.createDataFrame([(1, long, "", ""), (2, "zz" + long[9000:9100], "", "")], SCHEMA)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got[1]["n_removed"] == 0
    assert (got[2]["n_removed"], bytes(got[2]["kept_text"])) == (100, b"zz")


def test_texts_that_meet_in_one_key_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    chance = random.Random(17)
    passage = "".join(chance.choices("abcdef ", k=80))
    docs = [(i, "".join(chance.choices("abcdef ", k=60)) + (passage if i % 4 == 0 else ""), "x")
            for i in range(40)]
    docs += [(100 + i, docs[i][1], "y") for i in range(0, 40, 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, key string")
    plain = sorted(map(tuple, suffix_dedup.remove_repeats(frame).collect()))
    monkeypatch.setattr(
        suffix_dedup, "short_key", lambda sha: F.pmod(F.xxhash64(sha), F.lit(7).cast("long")))
    assert sorted(map(tuple, suffix_dedup.remove_repeats(frame).collect())) == plain
    assert sum(r[2] for r in plain) > 0


def test_what_meets_at_a_frequent_anchor_grows_with_tasks_only(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 3_000)
    chance = random.Random(3)
    passage = "".join(chance.choices("abcdef ", k=90)).encode()
    docs = [(i, bytes(chance.choices(b"uvwxyz", k=60)) + passage) for i in range(300)]
    docs += [(i % 3, docs[i % 3][1]) for i in range(200)]
    frame = spark.createDataFrame(docs, "key long, text binary").repartition(2).cache()
    met, answered = {}, set()
    for row in suffix_dedup.asked_anchors(frame, 50, 4).collect():
        kind = "<u4" if row["group"] < 4 else "<u8"
        for key_, n in zip(np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["counts"], "<u4")):
            if row["group"] >= 4:
                answered.add(int(key_))
        if row["group"] < 4:
            for a in np.frombuffer(row["anchors"], kind).tolist():
                met[row["group"], a] = met.get((row["group"], a), 0) + 1
    # A task asks once for an anchor that every text has.
    everywhere = None
    for _, text in docs:
        full = suffix_dedup._address(suffix_dedup.runs([text], 50, suffix_dedup.GRAM)[3], 4)
        own = {divmod(a, 1 << 32) for a in full.tolist()}
        everywhere = own if everywhere is None else everywhere & own
    assert len(everywhere) >= 2 and all(met[a] <= 2 for a in everywhere)
    found = {r["key"]: len(r["found"]) // 8 for r in
             suffix_dedup.repeated_anchors(frame, 50, 4).collect()}
    assert set(found) == set(range(300)) and answered <= set(found)
    assert min(found.values()) >= 2
    frame.unpersist()


def test_only_what_the_result_reads_stays_on_disk(spark):
    import os
    import time

    from cohortsmith import session

    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
        files = blocks.diskBlockManager().getAllFiles()
        return {
            name for i in range(files.size())
            if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")
        }

    docs = [(i, t, "k", None) for i, t in corpus(9)]
    frame = spark.createDataFrame(docs, SCHEMA)
    shared = session.scratch_path(spark).removeprefix("file:")
    tables, files = set(os.listdir(shared)), shuffled()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    result = suffix_dedup.remove_repeats(frame)
    left = {name.split("-")[0] for name in set(os.listdir(shared)) - tables}
    assert left == {"lows", "cover"}
    for _ in range(40):  # files go in the background
        if shuffled() <= files:
            break
        time.sleep(0.25)
    assert shuffled() <= files
    assert spark.conf.get(name, None) == setting
    assert result.count() == len(docs)


def test_rows_of_a_range_do_not_grow_with_the_slices(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 500)
    chance = random.Random(11)
    docs = [(i, bytes(chance.choices(b"uvwxyz", k=400))) for i in range(200)]
    frame = spark.createDataFrame(docs, "key long, text binary").repartition(2)
    rows = suffix_dedup.asked_anchors(frame, 50, 20).collect()
    each = Counter(row["group"] for row in rows)
    assert set(each) == set(range(20)) and max(each.values()) <= 2
    # Nothing is lost: every anchor of every text asks once.
    asked = sum(len(row["anchors"]) // 4 for row in rows)
    have = sum(len(set(suffix_dedup.runs([text], 50, suffix_dedup.GRAM)[3].tolist()))
               for _, text in docs)
    assert asked == have
