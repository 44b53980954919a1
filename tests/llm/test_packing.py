import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortsmith.llm import packing
from cohortsmith.llm.queries import tokenizer_path
from cohortsmith.llm.tokens import encoder

SCHEMA = "doc_id long, text string, id string, length string"

TEXTS = [
    "", None, " \n\t ", "a<|endoftext|>b c", "don't I'LL 12 345 a_b (x) ...",
    "naïve café ΣΑΣ İstanbul ß Ǆ x y z w ​ zeró ẹ́ 中文字 ١٢ ₂² ½ 🎉 "
    "a\x85b a\x1cb \x00 \x7f ẞ ŉ ſ é ﻿", "word " * 3000, "x" * 30_000,
]


def test_ids_equal_the_library():
    encode = encoder(tokenizer_path())
    chance = random.Random(4)
    syllables = ["ße", "éa", "the", "TION", "ño", "!?", "1", "'s", "-"]
    made = [
        " ".join("".join(chance.choices(syllables, k=3)) for _ in range(50))
        for _ in range(40)
    ]
    for texts in (TEXTS, made, made[::-1]):
        ids, ends = encode(pa.array(texts, pa.string()))
        reference = encode.library.encode_batch(
            [t or "" for t in texts], add_special_tokens=False
        )
        starts = [0, *ends[:-1]]
        for a, b, expected in zip(starts, ends, reference):
            assert ids[a:b].tolist() == expected.ids


def check_places(pieces, window):
    """Gapless sequences of up to ``window``; returns the share of padding."""
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    padding = total = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window
        total += end
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding / (total + padding)


def test_round_trip(spark):
    chance = random.Random(7)
    texts = TEXTS + [
        " ".join(chance.choices(["the", "of", "Tion", "ea", "é"], k=chance.randrange(1, 900)))
        for _ in range(300)
    ]
    docs = spark.createDataFrame(
        [(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA
    ).repartition(3)
    got = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    library = encoder(tokenizer_path()).library
    by_doc = defaultdict(list)
    for p in got:
        by_doc[p["doc_id"]].append(p)
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        assert p["length"] == len(p["ids"])
    for i, text in enumerate(texts):
        ids = []
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == len(ids)
            ids += p["ids"]
        assert ids == library.encode(text or "", add_special_tokens=False).ids + [1]
        assert {p["doc_tokens"] for p in by_doc[i]} == {len(ids)}
    check_places(got, packing.WINDOW)


def test_ranges_do_not_change_validity(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_RANGE", 3)
    docs = spark.createDataFrame(
        [(1, "same text", "", "")] * 40 + [(None, f"t {'a ' * i}", "", "") for i in range(40)],
        SCHEMA,
    )
    got = packing.pack(docs, tokenizer_path()).collect()
    assert len(got) == 80
    check_places(got, packing.WINDOW)


def test_empty_table(spark):
    got = packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path())
    assert got.collect() == []
    assert got.columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]


@pytest.mark.parametrize("n, most", [(1, 1.0), (200, 0.1), (20_000, 0.002)])
def test_plan_places_every_piece_with_little_padding(n, most):
    chance = np.random.default_rng(n)
    lengths = np.minimum(np.exp(chance.normal(5.5, 1.5, n)).astype(int) + 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    entries, sequences = packing.plan(histogram)
    pieces = []
    for e in entries.to_dict("records"):
        for i in range(e["pieces"]):
            block = e["block"] + i
            pieces.append({
                "sequence_id": e["sequence"] + block // e["every"], "length": e["length"],
                "offset": e["offset"] + block % e["every"] * e["step"],
            })
    assert sorted(p["length"] for p in pieces) == sorted(lengths.tolist())
    assert {p["sequence_id"] for p in pieces} == set(range(sequences))
    assert check_places(pieces, 2048) <= most


def test_least_squares_finds_an_exact_cover():
    histogram = np.zeros(2049, np.int64)
    histogram[[1500, 548, 700, 1348]] = [1000, 1000, 300, 300]
    rows = packing.combinations(histogram, 2048)[0]
    counts = packing.nonnegative_counts(rows, histogram)
    found = {tuple(r): round(c) for r, c in zip(rows.tolist(), counts) if c > 0.5}
    assert found == {(1500, 548, 0): 1000, (1348, 700, 0): 300}


def test_equal_rows_are_numbered_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_RANGE", 10)
    docs = spark.range(300).selectExpr("1L AS doc_id", "'one two three' AS text")
    pieces = packing.pack(docs, tokenizer_path()).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == 300
    check_places(pieces, 2048)
