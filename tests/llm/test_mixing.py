import random
from collections import Counter

import pytest

from shelfwise.llm import mixing
from tests.llm.helpers import against_sql, frame

SCHEMA = "doc_id long, text string, source string, size string, target int"


def rows(seed, n, sources):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", " \t", "w " * rng.randrange(1, 60)]), rng.choice(sources), "x", 1) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None, "é", "Z"], ["hot"] * 20 + ["s1", "s2", "s3"]])
def test_plan_equals_sql(spark, sources):
    docs, twin = frame(spark, SCHEMA, rows(len(sources), 300, sources) + [(None, "a b", "a", "x", 1), (7, "q " * 40, "a", "x", 1), (7, "q " * 40, "a", "x", 1)])
    got, want = against_sql(mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken"), mixing.ORACLE, documents=twin)
    assert got == want


def test_plan_is_the_global_order_cut_at_the_budget(spark):
    data = rows(8, 400, ["a", "b", "b", "c", None]) + [(900, "l " * 5000, "b", "x", 1)]
    docs, _ = frame(spark, SCHEMA, data)
    plan = mixing.plan_mix(docs).collect()
    copies = sorted((r.finish + k * r.source_size / r.target, r.source is None, r.source or "", r.doc_id, k, r.size) for r in plan if r["size"] for k in range(3))
    budget, served, want = sum(r["size"] for r in plan), 0, Counter()
    for _, _, _, doc_id, _, size in copies:
        served += size
        if served > budget:
            break
        want[doc_id] += size
    assert {r.doc_id: r.taken for r in plan if r.taken} == dict(want)


def test_each_source_comes_near_its_target_and_all_of_it_is_spent(spark):
    docs, _ = frame(spark, SCHEMA, rows(5, 2000, ["a", "b", "b", "b", "c"]))
    plan = mixing.plan_mix(docs).toPandas()
    largest = plan["size"].max()
    for _, own in plan.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= largest
    assert 0 <= plan["size"].sum() - plan.taken.sum() <= largest * 3
    assert (plan.taken <= 3 * plan["size"]).all()


def test_the_mix_holds_every_row_as_often_as_planned(spark):
    data = rows(6, 200, ["a", "b", "b", "b"]) + [(9, "z " * 30, "a", "x", 1)] * 2
    docs, _ = frame(spark, SCHEMA, data)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    planned = Counter()
    for r in mixing.plan_mix(docs).collect():
        planned[r.doc_id] += r.taken
    assert +words == +planned


def test_no_rows_and_no_words(spark):
    docs, _ = frame(spark, SCHEMA, [(1, None, "a", "x", 1), (2, "", None, "x", 1)])
    assert mixing.plan_mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.plan_mix(docs).collect()] == [0, 0]
    assert mixing.mix(docs).count() == 0
