import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        if i is not None:
            for s in range(len(words) - window + 1):
                key = tuple(words[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words, gone = WORD.findall(text or ""), set()
        for s in range(len(words) - window + 1):
            if i is not None and first[tuple(words[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É!", "日本"]
    passages = [rng.choices(words, k=rng.choice([12, 13, 14, 26, 50, 90])) for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += rng.choices(words, k=rng.randrange(0, 30)) + rng.choice(passages)[rng.randrange(3) :]
        rows.append((i * 3 % 1000 - 50, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [rows[5], (2000, rows[7][1]), (2001, None), (2002, ""), (2003, "x " * 13), (2004, "x " * 40), (None, rows[7][1]), (5000, "long " * 60_000), (5001, "long " * 100)]
    return rows


@pytest.mark.parametrize("seed, window", [(1, 13), (2, 13), (3, 2), (4, 30), (5, 50)])
def test_equals_brute_force(spark, seed, window):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, unit int")
    docs = docs.withColumns({"row": F.lit(1), "spans": F.lit("x")}).repartition(7)
    got = sorted((tuple(r) for r in substrings.repeat_digests(docs, window).collect()), key=repr)
    assert got == brute(rows, window)


def test_words_whose_polynomial_hashes_meet(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))  # such words and their complements
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, " ".join([a] * 13)), (2, " ".join([b] * 13))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.repeat_digests(docs).collect()] == [0, 0]


def test_columns_nulls_and_no_rows(spark):
    text = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([("a", 1, text, None), ("b", 2, f"new {text} end", 5), ("c", 3, None, 5)], "part string, doc_id long, text string, n_removed int")
    got = {r.row.part: r for r in substrings.remove_repeats(docs).collect()}
    assert got["a"].row.text == text and got["a"].row.n_removed is None
    assert tuple(got["b"].row) == ("b", 2, "new end", 5) and [tuple(s) for s in got["b"].spans] == [(1, 21)]
    assert {r.row.text for r in substrings.remove_repeats(docs.replace(f"new {text} end", f"\nnew\t{text}  end ")).collect()} == {text, "\nnew\tend ", None}
    assert got["c"].row.text is None and got["c"].n_words == 0
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_levels():
    assert substrings.lengths(13) == [7, 13]
    assert substrings.lengths(50) == [7, 13, 25, 50]
    assert substrings.lengths(2) == [1, 2]
