import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import language, toxicity

def categories():
    return {"odd": F.col("odd") == 1, "toxic": F.col("toxic") == 1}


def labelled(spark, n=1200):
    chance = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = chance.choices([f"word{k}" for k in range(200)], k=60)
        bad, odd = i % 7 == 0, i % 3 == 0
        if bad:
            words[chance.randrange(60)] = "vile" + chance.choice("abc")
        if odd:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "x", "y"))
        labels.append((i, int(odd), int(bad)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, p_toxic string, id string"),
        spark.createDataFrame(labels, "doc_id long, odd int, toxic int"),
    )


def test_chain_on_unseen_labels(spark):
    docs, labels = labelled(spark)
    chain = toxicity.fit(docs, labels.where("doc_id < 1000"), categories())
    got = toxicity.classify(docs, chain).join(labels, "doc_id").where("doc_id >= 1000")
    wrong = got.where((F.col("p_toxic") >= 0.5) != (F.col("toxic") == 1)).count()
    assert wrong <= 2
    kept = toxicity.reject(docs, chain)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - toxicity.classify(docs, chain).where("p_toxic >= 0.5").count()


def test_bounded_sample_keeps_the_shares_of_the_labels(spark):
    """Labels that words do not explain: probabilities near the share, at any sample."""
    chance = random.Random(8)
    docs, labels = [], []
    for i in range(2000):
        docs.append((i, " ".join(chance.choices([f"word{k}" for k in range(30)], k=5)), "x", "y"))
        labels.append((i, int(i % 10 < 2), int(i % 10 == 0)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, p_toxic string, id string")
    labels = spark.createDataFrame(labels, "doc_id long, odd int, toxic int")
    for sample in (2000, 300):
        chain = toxicity.fit(docs, labels, categories(), sample=sample)
        share = toxicity.classify(docs, chain).agg(F.avg("p_odd"), F.avg("p_toxic")).first()
        assert abs(share[0] - 0.2) < 0.06
        assert abs(share[1] - 0.1) < 0.04


def test_odd_rows_and_missing_labels(spark):
    docs, labels = labelled(spark, 30)
    odd = spark.createDataFrame(
        [(None, None, "", ""), (1, "", "", ""), (1, " ", "", ""), (2, "a " * 300_000, "", "")],
        docs.schema,
    )
    for known in (labels, labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        chain = toxicity.fit(docs, known, categories())
        got = toxicity.classify(odd, chain).collect()
        assert len(got) == 4
        assert [r["p_toxic"] for r in got[:3]] == [0.0, 0.0, 0.0]
        assert toxicity.reject(odd.limit(0), chain).count() == 0


def test_language(spark):
    chance = random.Random(2)
    stems = {"aa": ["kla", "mori", "tes"], "bb": ["xun", "qeo", "wyz"]}
    rows = []
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join("".join(chance.choices(stems[lang], k=3)) for _ in range(30)),
                     lang, "x"))
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame(rows, schema)
    model = language.fit(docs.where("doc_id < 80"))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("doc_id >= 80 AND lang <> lang_pred").count() == 0
    odd = spark.createDataFrame(
        [(1, None, None, ""), (2, "12 !?", None, ""), (3, "", None, ""), (None, "kla mori " * 90_000, "", "")],
        schema,
    )
    found = language.identify(odd, model).collect()
    assert [r["lang_pred"] for r in found] == ["und", "und", "und", "aa"]
    assert [r["score"] for r in found[:3]] == [0, 0, 0] and 0 < found[3]["score"] <= 1
    strange = spark.createDataFrame([(1, "ßßß ŋŋŋ þþþ", None, "")], schema)
    assert language.identify(strange, model).first()["rejected"]
    untaught = language.fit(docs.limit(0))
    assert language.identify(docs.limit(2), untaught).first()["lang_pred"] == "und"
    assert language.identify(odd.limit(0), model).collect() == []


def test_a_mark_without_a_letter_has_no_language(spark):
    _, has_letter = language.sequences(["❤\ufe0f", "12 \u0301 !", "", "❤\ufe0f kla", "e\u0301"])
    assert has_letter.tolist() == [False, False, False, True, True]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(i, "kla mori tes", "aa") for i in range(9)], schema)
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, "❤\ufe0f", None)], schema)
    assert tuple(language.identify(odd, model).first())[:3] == (1, "und", 0.0)


def test_copies_of_a_labelled_document_count_once(spark, monkeypatch):
    docs, labels = labelled(spark, 200)
    many = docs.unionByName(spark.range(3000).selectExpr(
        "5L AS doc_id", "IF(id % 2 = 0, 'one text', 'another text') AS text", "'' AS p_toxic",
        "'' AS id"))
    seen = []
    real = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain",
                        lambda ids, *rest: seen.append(len(ids)) or real(ids, *rest))
    toxicity.fit(many, labels, categories(), sample=60)
    toxicity.fit(docs.limit(0), labels, categories())
    assert seen[0] <= 120 and seen[1] == 0


def dense_chain(ids, x, labels, weight):
    """The chain on a dense 0/1 matrix by plain loops: coefficients per category."""
    n, out, before = len(ids), [], []

    def chosen(rows, y):
        scored = []
        for f in range(x.shape[1]):
            inside = sum(x[i, f] for i in rows if y[i])
            outside = sum(x[i, f] for i in rows if not y[i])
            n1, n0 = max(sum(y[i] for i in rows), 1), max(sum(1 - y[i] for i in rows), 1)
            rate = (inside + outside) / len(rows)
            z = (inside / n1 - outside / n0) / max(rate * (1 - rate), 1e-12) ** 0.5 / (
                1 / n1 + 1 / n0) ** 0.5
            if max(inside, outside) >= toxicity.SEEN_IN and z:
                scored.append((-abs(z), f))
        return sorted(f for _, f in sorted(scored)[: toxicity.FEATURES])

    def solved(rows, words, y, mass):
        table = np.array([[*x[i, words], *[b[i] for b in before], 1.0] for i in rows])
        target, mass = np.array([y[i] for i in rows], float), np.array([mass[i] for i in rows])
        ridge = np.array([toxicity.RIDGE] * (table.shape[1] - 1) + [1e-6])
        beta = np.zeros(table.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(table @ beta, -40, 40)))
            gradient = table.T @ (mass * (target - p)) - ridge * beta
            information = (table.T * (mass * p * (1 - p))) @ table + np.diag(ridge)
            beta = beta + np.clip(np.linalg.solve(information, gradient), -4, 4)
        return beta

    mass = weight * n / weight.sum()
    for k in range(labels.shape[1]):
        y = labels[:, k]
        words = chosen(range(n), y)
        out.append((words, solved(range(n), words, y, mass)))
        unseen = np.zeros(n)
        for f in range(toxicity.FOLDS):
            train = [i for i in range(n) if ids[i] % toxicity.FOLDS != f]
            own = chosen(train, y)
            beta = solved(train, own, y, mass)
            for i in range(n):
                if ids[i] % toxicity.FOLDS == f:
                    row = np.array([*x[i, own], *[b[i] for b in before], 1.0])
                    unseen[i] = 1 / (1 + np.exp(-row @ beta))
        unseen = np.clip(unseen, 1e-4, 1 - 1e-4)
        before.append(np.log(unseen / (1 - unseen)))
    return out


def test_chain_equals_dense_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 6)
    rng = np.random.default_rng(3)
    n = 150
    x = (rng.random((n, 12)) < 0.3).astype(float)
    labels = np.column_stack([
        (x[:, 0] + x[:, 3] + rng.random(n) > 1.2), (x[:, 1] + x[:, 0] + rng.random(n) > 1.4)
    ]).astype(int)
    ids, weight = rng.integers(0, 10**9, n), rng.choice([1.0, 2.5], n)
    row, feature = np.nonzero(x)
    chain = toxicity.fit_chain(
        ids, row.astype(np.int32), feature.astype(np.uint32), labels, ["a", "b"], weight)
    for link, (words, beta) in zip(chain.links, dense_chain(ids, x, labels, weight)):
        assert chain.features[link.words].tolist() == words
        assert link.weights == pytest.approx(beta, abs=2e-3)


def test_rows_without_ids_are_drawn_by_their_text(spark):
    chance = random.Random(4)
    stems = {"aa": ["kla", "mori", "tes"], "bb": ["xun", "qeo", "wyz"], "cc": ["ahu", "jip"]}
    rows = [(None, "".join(chance.choices(stems[lang], k=9)) + f" {i}", lang)
            for i in range(900) for lang in [["aa", "bb", "cc"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample=60)
    assert sorted(set(model.languages)) == ["aa", "bb", "cc"]
    repeated = docs.unionByName(spark.range(5000).selectExpr(
        "7L AS doc_id", "'klamoritesklamori' AS text", "'aa' AS lang"))
    assert sorted(set(language.fit(repeated, sample=60).languages)) == ["aa", "bb", "cc"]


def counted_by_loops(text):
    """Hashed sequences of one text, symbol by symbol."""
    symbols = []
    for c in " " + text.lower() + " ":
        code = ord(c) if language.in_sequences(c) else 32
        if code != 32 or not symbols or symbols[-1] != 32:
            symbols.append(code)
    counts = [0] * language.BUCKETS
    for i in range(len(symbols)):
        for k in range(min(language.ORDERS, i + 1)):
            value = 0
            for j in range(k + 1):
                value = (value * 0x9E3779B97F4A7C15 + symbols[i - j] + 1) % 2**64
            if k or symbols[i] != 32:
                counts[value * 0xD6E8FEB86659FD93 % 2**64 >> 52] += 1
    return counts


def test_predictions_equal_dense_cosines(spark):
    chance = random.Random(9)
    stems = {"aa": ["kla", "mori", "tes"], "bb": ["xun", "qeo", "wyz"]}
    texts = ["".join(chance.choices(stems[lang], k=12)) for lang in ["aa", "bb"] * 60]
    docs = spark.createDataFrame(
        [(i, t, ["aa", "bb"][i % 2]) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string")
    model = language.fit(docs)
    texts += ["Kla  mori!", "é1xun", "a"]
    names, scores, _ = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        vector = [math.log(1 + c) * w for c, w in zip(counted_by_loops(text), model.idf)]
        length = math.sqrt(sum(v * v for v in vector))
        cosines = [
            sum(a * b for a, b in zip(vector, c)) / length / math.sqrt(sum(b * b for b in c))
            for c in model.centres.tolist()
        ]
        best = int(np.argmax(cosines))
        assert model.languages[best] == name
        assert score == pytest.approx(min(max(cosines[best], 0), 1), abs=1e-9)
