import random

import pyarrow as pa
import pytest

from shelfwise.llm import lexical
from tests.llm.helpers import against_sql, frame

DOCS, ITEMS = "doc_id long, text string, n int, bag string", "item_id long, text string, term string"


def corpus(rng, n=400):
    words = ["Wind", "wasser", "éa", "Éa", "x1", "42", "langes-Wort", "日本", "verylongwordbeyondeightbytes", "verylongwordbeyondeightbytez", "k"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
    rows = [(i, text(), 0, "b") for i in range(n)]
    rows += [(1000 + i, "wind WIND, wasser!", 0, "b") for i in range(120)]  # one large class
    rows += [(2000, None, 0, "b"), (2001, "", 0, "b"), (2002, " .,\t\n\x00", 0, "b"), (None, "wind", 0, "b"), (3, "wind wasser", 1, None), (3, "wind wasser", 1, None)]
    rows += [(3000, "wind " * 50_000, 0, "b"), (3001, "w" * 100_000, 0, "b"), (3002, "nothing asked", 0, "b")]
    rng.shuffle(rows)
    items = [(0, "wind wind Wasser", "t"), (1, "éa É", "t"), (1, "日本 verylongwordbeyondeightbytez", "t"), (2, "absent", "t"), (3, None, "t"), (None, "wind", "t"), (4, "k 42 x1 langes", "t"), (4, "k 42 x1 langes", "t")]
    return rows, items


@pytest.mark.parametrize("terms, cells", [(1 << 20, 1 << 21), (3, 10)])
def test_equals_sql(spark, monkeypatch, terms, cells):
    monkeypatch.setattr(lexical, "TERMS", terms)
    monkeypatch.setattr(lexical, "CELLS", cells)
    rows, items = corpus(random.Random(5))
    docs, docs_twin = frame(spark, DOCS, rows)
    asked, asked_twin = frame(spark, ITEMS, items)
    got, want = against_sql(lexical.ranked_search(docs.repartition(5), asked), lexical.ORACLE, documents=docs_twin, benchmark=asked_twin)
    assert got == want and len(want) >= 150


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(0, "a")], "doc_id long, text string"), spark.createDataFrame([(0, "a")], "item_id long, text string")
    assert [tuple(r) for r in lexical.ranked_search(docs, items).collect()] == [(0, 1, 0, 287 * (10**9 // 3000))]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("false"), items.where("false"))):
        assert lexical.ranked_search(d, i).count() == 0


def test_equal_hashes_are_compared_whole(monkeypatch, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"term_no": pa.array([0, 1], pa.int64()), "term": ["alpha", "a-term-beyond-sixteen-bytes"]}), tmp_path / "x.parquet")
    monkeypatch.setattr(lexical, "word_hashes", lambda data, starts, ends: (ends - starts).astype("uint64"))
    known = lexical.Vocabulary(str(tmp_path))
    text = b"alpha omega a-term-beyond-sixteen-bytez a-term-beyond-sixteen-bytes"
    import numpy as np

    ends = np.array([5, 11, 39, 67])
    rows, numbers = known.look_up(np.frombuffer(text, np.uint8), np.array([0, 6, 12, 40]), ends)
    assert rows.tolist() == [0, 3] and numbers.tolist() == [0, 1]
    pq.write_table(pa.table({"term_no": pa.array([0, 1], pa.int64()), "term": ["alpha", "omega"]}), tmp_path / "x.parquet")
    rows, numbers = lexical.Vocabulary(str(tmp_path)).look_up(np.frombuffer(text, np.uint8), np.array([0, 6, 12, 40]), ends)
    assert rows.tolist() == [0, 1] and numbers.tolist() == [0, 1]
