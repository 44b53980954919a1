import math
import random
from collections import defaultdict

import pytest

from cohortsmith.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string"


def fair_targets(sizes, weights=(1, 2, 3), most=3.0):
    """Share, cap and reshare until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**target, **share}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def corpus(seed, n=600):
    chance = random.Random(seed)
    sources = ["a", "b", "Z", "é", None, "tiny"]
    out = []
    for i in range(n):
        source = "a" if i % 3 == 0 else chance.choice(sources[:-1])
        if i >= n - 2:
            source = "tiny"
        out.append((i, "w " * int(chance.expovariate(1 / 40)), source, "x"))
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    docs = corpus(5)
    got = mixing.sample_copies(spark.createDataFrame(docs, SCHEMA)).collect()
    return docs, {r["doc_id"]: r for r in got}


def test_targets_equal_repeated_sharing(mixed):
    docs, got = mixed
    sizes = defaultdict(int)
    for _, text, source, _ in docs:
        sizes[source] += len(text.split())
    expected = fair_targets(sizes)
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))
    for i, text, source, _ in docs:
        assert got[i]["size"] == len(text.split())
        assert got[i]["source_size"] == sizes[source]
        assert got[i]["target"] == pytest.approx(expected[source], abs=1e-6)


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 200},
    {"a": 100, "b": 200, "c": 300},
    dict.fromkeys("abcdef", 100),
    {"a": 10, "b": 20, "c": 30, "d": 500},
    {"a": 500, "b": 20, "c": 30, "d": 10, None: 0},
])
def test_targets_of_sources_that_tie(spark, sizes):
    """Equal sizes by weight, at the first level that fits and below it."""
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    for most in (3.0, 1.5):
        got = mixing.allocate(sources, (1.0, 2.0, 3.0), most).collect()
        expected = fair_targets(sizes, most=most)
        assert {r["source"]: r["target"] for r in got} == pytest.approx(expected)
        assert sum(r["target"] for r in got) == pytest.approx(sum(sizes.values()))


def test_equal_sources_are_taken_whole(spark):
    docs = [(i, "w " * 10, "abcdef"[i % 6], "x") for i in range(60)]
    got = mixing.sample_copies(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sum(r["taken"] for r in got) >= 0.95 * 600


def test_taken_words_come_near_the_targets(mixed):
    docs, got = mixed
    taken = defaultdict(int)
    for i, _, source, _ in docs:
        row = got[i]
        ratio = row["target"] / row["source_size"]
        assert row["copies"] in (int(ratio + 1e-9), int(ratio + 1e-9) + 1) or not row["size"]
        assert row["taken"] == row["copies"] * row["size"] <= 3 * row["size"]
        taken[source] += row["taken"]
    for i, _, source, _ in docs:
        target = got[i]["target"]
        assert taken[source] <= target + 1e-6
        assert taken[source] >= 0.97 * target or source == "tiny"


def test_reruns_and_partitions_agree(spark, rows, mixed, monkeypatch):
    docs, got = mixed
    again = spark.createDataFrame(docs[::-1], SCHEMA).repartition(7)
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 5)
    assert rows(mixing.sample_copies(again)) == rows(
        spark.createDataFrame(list(got.values()))
    )


def test_prefix_by_rank_is_the_brute_force_prefix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 3)
    chance = random.Random(3)
    data = [
        (chance.choice(["p", None]), chance.randrange(1, 30), chance.random(), 200.0)
        for _ in range(80)
    ]
    frame = spark.createDataFrame(data, "source string, size long, rank double, budget double")
    for row in mixing._largest_prefix(frame, 80).collect():
        words, edge = 0, None
        for _, size, rank, budget in sorted(
            (d for d in data if d[0] == row["of"]), key=lambda d: d[2]
        ):
            if words + size > budget:
                break
            words, edge = words + size, rank
        assert row["words"] == words
        inside = [d for d in data if d[0] == row["of"] and d[2] <= row["edge"]]
        assert sum(d[1] for d in inside) == words


def test_appeal_changes_odds_not_the_size(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "'one two three' AS text", "IF(id % 2 = 0, 'a', 'b') AS source",
        "id % 4 < 2 AS good",
    )
    got = mixing.sample_copies(
        docs, weights=(1.0, 3.0), appeal=F.when(F.col("good"), 4.0).otherwise(1.0)
    ).join(docs.select("doc_id", "good"), "doc_id")
    share = {
        r["good"]: r["n"]
        for r in got.where("source = 'a'").groupBy("good").agg(F.avg("copies").alias("n")).collect()
    }
    assert share[True] > 1.5 * share[False]
    assert sum(share.values()) / 2 == pytest.approx(0.5, abs=0.01)


def test_empty_null_and_repeated(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.sample_copies(empty).collect() == []
    odd = spark.createDataFrame(
        [(1, "a b", "q", ""), (1, "a b", "q", ""), (None, "a", "z", ""), (2, None, "k", ""),
         (3, "", None, ""), (4, "z", None, ""), (5, "w " * 200_000, "long", "")],
        SCHEMA,
    )
    got = mixing.sample_copies(odd).collect()
    assert len(got) == 7
    assert all(r["copies"] <= 3 for r in got)
    assert [r["taken"] for r in got if not r["size"]] == [0, 0]
    pair = [r["copies"] for r in got if r["doc_id"] == 1]
    assert pair[0] == pair[1]


def test_copies_equal_a_plain_pareto_sample(spark):
    """Ranks from the same random numbers, then plain loops: prefix, and fill until nothing fits."""
    from pyspark.sql import functions as F

    from cohortsmith.llm.tables import uniform

    docs = [d for d in corpus(9, 300) if d[2] != "tiny"]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: r for r in mixing.sample_copies(frame, appeal=mixing.substance).collect()}
    sized = frame.select(
        "doc_id", uniform(20, F.col("doc_id"), mixing.word_count(F.col("text")), F.col("source"))
        .alias("u"))
    u = {r["doc_id"]: r["u"] for r in sized.collect()}
    sizes = defaultdict(int)
    for _, text, source, _ in docs:
        sizes[source] += len(text.split())
    unequal = 0
    for source, target in fair_targets(sizes).items():
        whole = int(target / sizes[source] + 1e-12)
        budget = target - whole * sizes[source]
        share = budget / sizes[source]
        own = []
        for i, text, of, _ in docs:
            size = len(text.split())
            if of == source and size:
                odds = math.log2(size + 2) * share / (1 - share) if share else 0
                own.append((u[i] / (1 - u[i]) / odds if odds else None, i, size))
        extra = set()
        queue = sorted(o for o in own if o[0] is not None)
        while queue := [o for o in queue if o[1] not in extra and o[2] <= budget]:
            for _, i, size in queue:
                if size > budget:
                    break
                extra.add(i)
                budget -= size
        for _, i, size in own:
            assert got[i]["copies"] == whole + (i in extra), (source, i)
        unequal += len(extra)
    assert unequal > 20


def test_texts_stay_where_they_are(spark):
    docs = spark.createDataFrame(corpus(5, 100), SCHEMA)
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_few_rounds_and_plans(spark, monkeypatch):
    """What is written does not grow with the documents that did not fit in turn."""
    written = []
    real = mixing.materialize
    monkeypatch.setattr(
        mixing, "materialize", lambda df, label: written.append(label) or real(df, label)
    )
    frame = spark.createDataFrame([d for d in corpus(9, 300) if d[2] != "tiny"], SCHEMA)
    mixing.sample_copies(frame, appeal=mixing.substance)
    assert written == ["sizes", "mix", "mix"]


def test_rows_that_are_equal_do_not_stop_their_source(spark):
    """Two equal rows that do not fit together leave room for later ones that do."""
    docs = [(1, "w " * 40, "a", "")] * 2 + [(i, "w " * 3, "a", "") for i in range(2, 12)]
    docs += [(100 + i, "w " * 11, "b", "") for i in range(10)]
    got = mixing.sample_copies(spark.createDataFrame(docs, SCHEMA)).collect()
    own = [r for r in got if r["source"] == "a"]
    # Source a has 110 words and takes 220 / 3, less than the equal rows' 80.
    assert sum(r["taken"] for r in own) == 30
