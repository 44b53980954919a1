import random
import re
from collections import Counter

from cohortsmith.llm import quality

SCHEMA = "doc_id long, text string, kept string, lines string"


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {
        i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)
    }
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def counts(row):
    return (
        row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"],
        row["n_repeat_words"],
    )


def test_counts_equal_brute_force(spark):
    chance = random.Random(1)
    texts = ["", " \n\t\x0b ", "a", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n y\ny",
             "é 😀|<>&% #", " a b a b a b a b", "w " * 60_000]
    texts += [
        " ".join(chance.choices("abc", k=chance.randrange(60)))
        + chance.choice(["", "\n", "\n\nz z z"])
        for _ in range(150)
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = quality.judge(docs).collect()
    assert len(got) == len(texts)
    for row in got:
        assert counts(row) == by_hand(texts[row["doc_id"]]), texts[row["doc_id"]][:80]
        assert row["base_failed"] == (
            row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]
        )


def test_windows_of_equal_hash_are_told_apart_by_their_words(spark, monkeypatch):
    hashed = quality.F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: hashed(*c) % 5)
    chance = random.Random(4)
    texts = [" ".join(chance.choices("abcdefgh", k=n)) for n in (3, 4, 40, 200)]
    texts.append(" ".join(f"w{i}" for i in range(500)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    for row in quality.judge(docs).collect():
        assert counts(row) == by_hand(texts[row["doc_id"]])


def test_lines_go_and_documents_that_lose_too_much(spark):
    prose = "\n".join(
        " ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8)
    )
    menu = "Home | News | Sport | Contact | About | Log in"
    noise = " ".join(f"tok{i}%%%" for i in range(90))
    shout = " ".join(f"BUY{i}!!" for i in range(90))
    docs = spark.createDataFrame(
        [
            (1, prose, "", ""), (2, f"{menu}\n{prose}\nNext page\nAll Rights Reserved.", "", ""),
            (3, f"{prose}\n{noise}", "", ""), (4, f"{shout}\n{prose[:300]}", "", ""),
            (5, None, "", ""), (5, None, "", ""), (None, "short.", None, None),
        ],
        SCHEMA,
    )
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(docs).collect()}
    assert got[1, 96]["kept"] and got[1, 96]["clean_text"] == prose
    second = next(r for k, r in got.items() if k[0] == 2)
    assert second["kept"] and second["clean_text"] == prose and second["n_lines_removed"] == 3
    third, fourth = (next(r for k, r in got.items() if k[0] == i) for i in (3, 4))
    assert not third["kept"] and not third["base_failed"] and third["clean_text"] == prose
    assert not fourth["kept"]
    assert not got[5, 0]["kept"] and got[5, 0]["base_failed"]
    assert not got[None, 1]["kept"]


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_shuffle(spark):
    plan = quality.judge(spark.createDataFrame([(1, "a", "", "")], SCHEMA))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
