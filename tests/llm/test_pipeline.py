"""The whole pipeline on planted rows, each stage against plain Python."""

import os
import random
from collections import Counter, defaultdict

import pyarrow as pa

import corpus_pipeline
from cohortsmith.llm.queries import tokenizer_path
from cohortsmith.llm.tokens import encoder
from cohortsmith.session import scratch_path


def planted():
    """Documents, labels, and the ids that are toxic, exact and near copies."""
    chance = random.Random(12)
    names = [f"word{k}" for k in range(3000)]
    docs, labels, toxic = [], [], set()
    for i in range(240):
        words = chance.choices(names, k=200)
        if i % 5 == 0:
            words[::20] = ["vile"] * 10
            toxic.add(i)
        docs.append((i, " ".join(words), "abc"[i % 3]))
        labels.append((i, int(i % 3 > 0), int(i % 5 == 0)))
    exact = {1, 2, 3}  # of equal texts the largest id stays
    docs += [(1000 + i, docs[i][1], docs[i][2]) for i in sorted(exact)]
    near = {2004, 2006, 2007}  # of near copies the smallest id stays
    docs += [(2000 + i, docs[i][1] + " more", docs[i][2]) for i in (4, 6, 7)]
    return docs, labels, toxic, exact, near


def test_run_equals_plain_python_stage_by_stage(spark, tmp_path, monkeypatch):
    docs, labels, toxic, exact, near = planted()
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    read = []

    def watched(stage):
        def call(spark, frame, folder):
            read.append(frame)
            return stage(spark, frame, folder)
        return call

    monkeypatch.setattr(
        corpus_pipeline, "STAGES", [(n, watched(s)) for n, s in corpus_pipeline.STAGES]
    )
    before = set(os.listdir(scratch_path(spark)))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of all that was written only the stages' results are left.
    written = set(os.listdir(scratch_path(spark))) - before
    assert len(written) == 5 and all(name.startswith("stage-") for name in written)
    results = [[tuple(r) for r in f.select("doc_id", "text", "source").collect()] for f in read]
    expected = docs
    assert sorted(results[0]) == sorted(expected)
    for result, gone in zip(results[1:4], (toxic, exact, near)):
        expected = [d for d in expected if d[0] not in gone]
        assert sorted(result) == sorted(expected)

    # The mix: weights 1, 2, 3 over three sources of about equal size, none at its limit.
    size = defaultdict(int)
    for _, text, source in expected:
        size[source] += len(text.split())
    copies = Counter(results[4])
    assert set(copies) <= set(expected)
    for source, weight in zip("abc", (1, 2, 3)):
        target = sum(size.values()) * weight / 6
        whole = int(target / size[source])
        own = [d for d in expected if d[2] == source]
        assert all(copies[d] in (whole, whole + 1) for d in own)
        taken = sum(copies[d] * len(d[1].split()) for d in own)
        assert target - 250 <= taken <= target + 1e-6

    # Packing: every token of every copy once, sequences without gaps.
    texts = list(copies)
    _, ends = encoder(tokenizer_path())(pa.array([t[1] for t in texts], pa.string()))
    tokens = Counter()
    for doc, a, b in zip(texts, [0, *ends[:-1]], ends):
        tokens[doc[0]] += copies[doc] * (int(b) - int(a) + 1)
    found, sequences = Counter(), defaultdict(list)
    for p in packed:
        found[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert found == tokens
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
