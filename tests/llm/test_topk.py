import math
import random

import numpy as np
import pytest

from shelfwise.llm import topk


def brute(rows, k, every):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in valid if i % every == 0}:
        query = min(v for i, v in valid if i == q)
        best = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in valid if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "clusters"])
def test_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    point = {"spread": lambda: [rng.uniform(-1, 1) for _ in range(6)], "ties": lambda: [float(rng.randrange(2)) for _ in range(4)], "clusters": lambda: [rng.choice([0.9, -0.9]) + rng.gauss(0, 0.01) for _ in range(6)]}[kind]
    rows = [(i, point()) for i in range(400)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += [(1000, None), (1050, [None] * 6), (1100, [math.nan] * 6), (1150, [math.inf] * 6), (None, point()), (7, rows[3][1]), (50, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 5, 50)


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, -0.001])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df).collect()} == {(0, 1, 1, 256 * 128 - 128)}
    assert topk.top_k(df.where("vec_id = 0")).count() == 0
    assert topk.top_k(df.limit(0)).count() == 0


def test_scores_beyond_exact_floats(spark):
    big = [3.0e5, 2.0e5 + 1 / 256]
    df = spark.createDataFrame([(0, big), (1, [3.0e5, 2.0e5]), (2, [3.0e5, 2.0e5 + 1 / 256]), (3, [3.0e5 + 1 / 256, 2.0e5])], "vec_id long, embedding array<double>")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert {tuple(r) for r in topk.top_k(df).collect()} == brute(rows, 5, 50)


def test_starting_scores_are_reached():
    rng = np.random.default_rng(2)
    sample, ids = np.floor(rng.normal(size=(40, 4)) * 200), np.arange(40)
    start = topk.starting_scores(sample[:3], ids[:3], sample, ids, 5)
    assert [float(x) for x in start] == [sorted(float(q @ v) for j, v in enumerate(sample) if j != i)[-5] for i, q in enumerate(sample[:3])]
    assert (topk.starting_scores(sample[:2], ids[:2], sample[:3], ids[:3], 5) == -1e300).all()


def test_elimination_leaves_out_most_of_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 200
    vectors = centres[rng.integers(20, size=2000)] + rng.normal(size=(2000, 16))
    pivots = vectors[topk.spread_pivots(vectors[:500], 24)]
    table, q = topk.distances(vectors, pivots), vectors[0]
    apart = np.abs(table - topk.distances(q[None], pivots)[0]).max(axis=1)
    bound = ((vectors**2).sum(axis=1) + q @ q - apart**2) / 2
    assert (bound + 1e-3 >= vectors @ q).all()
    fifth = np.sort(vectors @ q)[-5]
    assert (bound >= fifth).mean() < 0.5


def test_the_driver_gets_the_sample_alone_and_no_row_is_joined(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 16)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    seen, first = [], topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda rows, at: seen.append((at.rsplit("/", 1)[1], rows)) or first(rows, at))
    found = topk.top_k(df)
    [low] = [rows for name, rows in seen if name == "sample"]
    assert low.count() == 16 and "Filter" in low._jdf.queryExecution().optimizedPlan().toString()  # of few rows, not of each task's best
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert {tuple(r) for r in found.collect()} == brute(rows, 5, 50)


def test_a_few_ids_repeated_fill_the_sample(spark):
    rows = [(i % 3, [float(i), 1.0]) for i in range(6000)]
    valid = spark.createDataFrame(rows, "id long, vector array<double>")
    assert len(topk._sample(valid, 6000, topk.work_dir(spark) + "/sample")) == topk.SAMPLE


def test_queries_of_several_blocks_and_tasks(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("QUERY_BLOCK", 3), ("QUERIES", 7), ("FEW_QUERIES", 9)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(rng.randrange(1, 5))]) for i in range(300)]
    wide = [(i, v + [0.0] * (4 - len(v))) for i, v in rows]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect()
    assert len(got) == 30 * 5 and {tuple(r) for r in got} == brute(wide, 5, 10)
