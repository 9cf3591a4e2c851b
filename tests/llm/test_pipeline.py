import os
from collections import Counter

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline
from shelfwise.llm import bpe, mixing, quality
from shelfwise.llm.queries import piece_pattern, vocabulary
from tests.llm.test_neardup import brute as components
from tests.llm.test_substrings import WORD
from tests.llm.test_substrings import brute as passages

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        kept.append((docs, out))
        docs = out
        if k < 4:
            assert out.columns == columns

    before, after = kept[0]
    judged = quality.score_quality(before, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in judged if r.score >= 0.3)

    before, after = kept[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, name in components(rows, 80).items() if i == name)

    before, after = kept[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    got = {r.doc_id: len(WORD.findall(r.text)) for r in after.collect()}
    assert got == {i: n - gone for i, n, gone, _ in passages(rows, 13) if not gone or gone < n}
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = kept[3]
    taken = Counter()
    for r in after.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert +taken == Counter({r.doc_id: r.taken for r in mixing.plan_mix(before).collect() if r.taken})

    before, after = kept[4]
    library = tiktoken.Encoding("own", pat_str=piece_pattern(), mergeable_ranks=bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in before.collect())
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in after.collect()) == want


def test_stages_bear_odd_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (3, "word " * 20, "en", "a", 100), (3, "word " * 20, "en", "a", 100), (4, "x", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, DATA)
        assert some.count() <= len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect()) == [1, 2, 3, 4]


def test_stages_bear_columns_of_any_name(spark):
    """Columns named as those that operators add, and repeated rows, go through; the columns stay in order."""
    names = ["_id", "_file", "row", "nth", "file", "kept", "n", "part", "unit", "_row", "_turns", "score", "log_bytes", "source_size"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "en", f"s{i % 2}", 0, *[f"{c}{i}" for c in names]) for i in range(6)]
    rows += [rows[0], (None, rows[1][1], *rows[1][2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        for r in out.collect():
            if r.doc_id is not None:
                assert [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names], name
    assert corpus_pipeline.token_stage(spark, docs, DATA).count() == len(rows)
