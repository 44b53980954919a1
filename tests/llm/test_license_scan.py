import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortsmith.llm import license_scan
from cohortsmith.llm.license_scan import Optional, Region, Word
from cohortsmith.llm.license_texts import TEMPLATES
from cohortsmith.llm.words import words

SMALL = [
    ("a", 'x y<<beginOptional>> z <<beginOptional>>q<<endOptional>> r<<endOptional>> end'),
    ("b", 'x <<var;name="who";words="0-2">> y'),
    ("c", 'y <<var;name="n";words="1-2";match="[0-9]+">><<beginOptional>> z<<endOptional>>'),
    ("d", '<<beginOptional>>q<<endOptional>> r <<var;name="any";words="2-3">> end'),
]


def ends(nodes, ws, i):
    """All places right after a match of the nodes from word i on, by plain recursion."""
    if not nodes:
        return {i}
    node, rest = nodes[0], nodes[1:]
    if isinstance(node, Word):
        return ends(rest, ws, i + 1) if i < len(ws) and ws[i] == node.text else set()
    if isinstance(node, Optional):
        return ends(rest, ws, i) | {e for j in ends(node.inner, ws, i) for e in ends(rest, ws, j)}
    assert isinstance(node, Region)
    import re
    out, j = set(), i
    for n in range(node.high + 1):
        if n >= node.low:
            out |= ends(rest, ws, j)
        if j >= len(ws) or (node.match and not re.fullmatch(node.match, ws[j])):
            break
        j += 1
    return out


def brute(templates, ws):
    found = []
    for label, markup in templates:
        through = -1
        for i in range(len(ws)):
            if i > through and (reached := ends(license_scan.parse(markup), ws, i)):
                through = max(reached) - 1
                found.append((label, True, i, through))
    return sorted(found, key=lambda p: (p[2], p[3], p[1], p[0]))


def test_words_are_the_pattern():
    import re
    texts = ["A-b c", "", None, "émile Ünï\x00q", "end", "start", "９9 _x_", " "]
    found, through = words(pa.array(texts))
    split, begin = [], 0
    for end in through:
        split.append(found.to_pylist()[begin:end])
        begin = end
    want = [
        re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
            c.lower() if c.isascii() else c for c in t or "")) for t in texts
    ]
    assert split == want
    some, through = words(pa.array(texts).slice(3, 3))
    assert some.to_pylist() == want[3] + want[4] + want[5]


def test_places_equal_plain_recursion():
    chance = random.Random(4)
    texts = [
        " ".join(chance.choices(["x", "y", "z", "q", "r", "end", "7", "w"], k=chance.randrange(40)))
        for _ in range(600)
    ]
    scanner = license_scan.Scanner(SMALL, {})
    _, places = scanner.places(pa.array(texts))
    for text, found in zip(texts, places):
        assert sorted(found, key=lambda p: (p[2], p[3], p[1], p[0])) == brute(SMALL, text.split())


def test_forgetting_changes_nothing(monkeypatch):
    chance = random.Random(5)
    text = " ".join(chance.choices(["x", "y", "z", "q", "r", "end", "7"], k=3000))
    want = license_scan.Scanner(SMALL, {}).places(pa.array([text]))[1]
    monkeypatch.setattr(license_scan, "REMEMBERED", 3)
    assert license_scan.Scanner(SMALL, {}).places(pa.array([text]))[1] == want


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_shipped_templates_accept_their_own_wording(number):
    label, markup = TEMPLATES[number]

    def spell(nodes, full):
        out = []
        for node in nodes:
            if isinstance(node, Word):
                out.append(node.text)
            elif isinstance(node, Optional):
                out += spell(node.inner, full) if full else []
            else:
                out += ["7"] * (node.high if full else node.low)
        return out

    scanner = license_scan.Scanner(TEMPLATES, {})
    for full in (True, False):
        text = spell(license_scan.parse(markup), full)
        n, places = scanner.places(pa.array(["lead in " + " ".join(text).upper() + " rest"]))
        whole = [p for p in places[0] if p[0] == label and p[3] > len(text)]
        assert whole, (label, full, places)
        # One mandatory word less or changed, and the template no longer matches.
        mandatory = spell(license_scan.parse(markup), False)
        broken = [*mandatory[:-1], "otherwise"]
        if mandatory[-1] != "7":
            _, places = license_scan.Scanner([TEMPLATES[number]], {}).places(
                pa.array([" ".join(broken)]))
            assert places[0] == []


@pytest.mark.parametrize("markup", [
    "a <<endOptional>>", "<<beginOptional>> a", "a <<what>>", '<<var;words="0-3">> a',
    "<<beginOptional>>a<<endOptional>>", 'a <<var;words="3-1">>',
])
def test_bad_templates_are_refused(markup):
    with pytest.raises(ValueError):
        license_scan.compiled([("x", markup)])


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [
            (1, None, "p", 0), (2, "", "p", 0), (None, "-- !", "p", 0),
            (3, "MIT-licensed? The MIT\nLicense; cc by", "p", 0),
            (3, "MIT-licensed? The MIT\nLicense; cc by", "p", 0),
            (4, "word " * 300_000 + "Released under the MIT License.", "p", 0),
            (5, "mit", None, None), (6, "license", None, None),
        ],
        "doc_id long, text string, places string, n_words int",
    )
    got = license_scan.digest(license_scan.scan(docs)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got if r["doc_id"] != 4] == [
        (None, 0, 0, None, None, "", "", 0.0), (1, 0, 0, None, None, "", "", 0.0),
        (2, 0, 0, None, None, "", "", 0.0),
        *[(3, 7, 2, 3, 5, "cc-by,mit", "cc-by,mit", 0.5)] * 2,
        (5, 1, 0, None, None, "", "", 0.0), (6, 1, 0, None, None, "", "", 0.0),
    ]
    assert tuple(got[-3]) == (4, 300_005, 1, 300_003, 300_003, "mit", "mit", 1.0)
    assert license_scan.scan(docs.limit(0)).collect() == []
    covered = license_scan.scan(docs.where("doc_id = 3"), templates=[]).first()["covered"]
    assert covered == pytest.approx(4 / 7)
    assert [f.dataType.simpleString() for f in license_scan.digest(license_scan.scan(docs)).schema
            ] == ["bigint", "bigint", "bigint", "bigint", "bigint", "string", "string", "double"]
    assert license_scan.scan(docs.withColumn("x", F.lit(1)), phrases={}).where(
        "size(places) > 0").count() == 1
