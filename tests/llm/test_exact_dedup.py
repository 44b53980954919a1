import hashlib

from cohortsmith.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept string, sha string"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_nulls_repeated_rows_and_clashing_names(spark, rows):
    docs = spark.createDataFrame(
        [
            (1, "a", "x", None), (1, "a", "x", None), (None, "a", "y", "s"),
            (2, None, "z", "t"), (3, "", None, None), (4, "b" * 300_000, "w", "u"),
        ],
        SCHEMA,
    )
    got = rows(exact_dedup.mark_copies(docs))
    long = "b" * 300_000
    assert got == sorted(
        [
            (1, 1, 3, True, _sha("a")), (1, 1, 3, False, _sha("a")),
            (None, 1, 3, False, _sha("a")), (2, 3, 2, False, _sha("")),
            (3, 3, 2, True, _sha("")), (4, 4, 1, True, _sha(long)),
        ],
        key=lambda r: [(v is not None, v) for v in r],
    )
    assert rows(exact_dedup.drop_copies(docs)) == [
        (1, "a", "x", None), (3, "", None, None), (4, long, "w", "u"),
    ]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.mark_copies(docs).collect() == []
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_a_full_filter_changes_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"text {i % 700}", "", "") for i in range(1000)], SCHEMA
    )
    expected = rows(exact_dedup.mark_copies(docs))
    monkeypatch.setattr(exact_dedup, "SLOT_BITS", 7)
    assert rows(exact_dedup.mark_copies(docs)) == expected
    assert sum(r[3] for r in expected) == 700


def test_texts_without_copies_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"t{i % 90}", "", "") for i in range(100)], SCHEMA)
    texts = docs.select("doc_id", "text")
    words = exact_dedup.repeated_slots(texts, "text").count()
    assert 0 < words <= 20  # two slots for each of the ten repeated texts


def test_large_group_of_copies(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, 'same', CAST(id AS STRING)) AS text"
    )
    got = exact_dedup.mark_copies(docs)
    assert got.count() == 3000
    assert got.where("kept").count() == 2001
    assert got.where("text_sha256 = sha2('same', 256)").select(
        "keep_id", "group_size"
    ).distinct().collect() == [(2997, 1000)]


def test_filter_grows_with_the_texts_up_to_its_limit():
    from cohortsmith.llm.exact_dedup import slot_bits

    assert [slot_bits(n) for n in (0, 10**6, 10**7, 10**9, 10**12)] == [26, 26, 28, 30, 30]
